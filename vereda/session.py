"""Session construction and the settings every plan relies on."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def build(app: str = "vereda", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew handling and UTC; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Checkpoints go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """Single-JVM session used by the tests and the benchmark."""
    n = cpus or os.cpu_count() or 4
    return build(
        master=f"local[{n}]",
        **{
            "spark.sql.shuffle.partitions": n,
            "spark.driver.memory": memory,
            "spark.sql.warehouse.dir": "/tmp/vereda-warehouse",
        },
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs above this size are never moved to spread them.
SPREAD_BYTES = 64 << 20


def spread(df, spark: SparkSession | None = None):
    """Deal a small input out to all cores, for work that is heavy per row.

    A small file is read by one task however many cores there are. The size is
    the optimizer's own estimate; larger inputs have splits enough and are
    returned as they are, so this never shuffles big data.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = (spark or df.sparkSession).sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SPREAD_BYTES else df


# Bytes of input that one task gets when each of its rows is heavy work.
DEAL_BYTES = 4 << 20


def deal(df, key: str, spark: SparkSession | None = None):
    """Deal rows that each become heavy work out by a unique key, in parts of bounded size, at least one for each core.

    A file is read by as many tasks as it has row groups; narrow rows cost little to move, their work does not wait for
    one task, and a task's share stays the same as the input grows.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = (spark or df.sparkSession).sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-size // DEAL_BYTES)), key)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only in a single-process session that names none."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    if configured is None:
        import tempfile
        configured = tempfile.mkdtemp(prefix="vereda-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's tables below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df, spark: SparkSession | None = None):
    """Cut lineage through the shared folder named by `spark.checkpoint.dir`."""
    shared_folder(spark or df.sparkSession)
    return df.checkpoint(eager=True)
