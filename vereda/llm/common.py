"""What the operators share: stored intermediates, word splitting, safe column names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(WORD.encode("ascii"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; a temporary one only in a single-process session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vereda-llm-"))
    return spark.sparkContext.getCheckpointDir()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Intermediate tables as Parquet in the shared folder, so that lost executors cost no recomputation.

    `put` writes and rereads a table under a tag; `drop` deletes one as soon as a later table replaces it. batch: most rows of
    an Arrow batch while a table is written, None for the session's value; it bounds memory, not results.
    """

    def __init__(self, spark: SparkSession, name: str, batch: int | None = None):
        self.spark, self.batch = spark, batch
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, tag: str, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(_BATCH)
        try:
            if self.batch is not None:
                self.spark.conf.set(_BATCH, min(self.batch, int(before)) if int(before) > 0 else self.batch)
            df.write.mode("overwrite").parquet(f"{self.root}/{tag}")
        finally:
            self.spark.conf.set(_BATCH, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{tag}")

    def drop(self, *tags: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: F.Column | str) -> F.Column:
    """The words of a text as an array; NULL and blank texts give an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def text_class(text: F.Column | str) -> F.Column:
    """128 bits naming a text: equal texts have equal names. NULL reads as the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def exact_ids(docs: DataFrame, *columns: str | F.Column) -> DataFrame:
    """doc_id as text beside other columns, for pandas code: whole numbers beside NULLs would become floating point there."""
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *columns)
