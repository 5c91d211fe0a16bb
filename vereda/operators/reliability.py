"""Operational metrics over an event log, and the log's own reader and writer.

An event is (component, ts, failed, latency). Mean time between failures and
mean time to recovery need no pairing of rows: gaps between consecutive
failures telescope to (last - first) / (n - 1), and since outages alternate
start, end, start, end, the sum of their lengths is the sum of ends minus the
sum of starts. Everything is a plain aggregation once each row knows the state
of the row before it.
"""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

SCHEMA = ("ts TIMESTAMP, event STRING, component STRING, elapsed_ms DOUBLE, context STRING, "
          "error STRING, reason STRING, fallback_to STRING, message STRING")
COMPONENTS = ("llm", "embeddings", "sql", "rag_pipeline", "keyword_extractor")


def seconds(ts: Column) -> Column:
    """Seconds with microseconds, from a timestamp of either kind."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def summary(events: DataFrame) -> DataFrame:
    """Per component: requests, failures, fallbacks, rates, mean latency."""
    request = F.col("event").isin("success", "failure")
    g = events.groupBy("component").agg(
        F.count_if(request).alias("requests"),
        F.count_if(F.col("event") == "failure").alias("failures"),
        F.count_if(F.col("event") == "fallback").alias("fallbacks"),
        F.round(F.avg(F.when(request, F.col("elapsed_ms"))), 4).alias("avg_latency_ms"))
    rate = F.when(F.col("requests") == 0, F.lit(1.0)).otherwise(
        (F.col("requests") - F.col("failures")) / F.col("requests"))
    return g.withColumn("success_rate", F.round(rate, 6)).withColumn("failure_rate", F.round(1 - rate, 6))


def mtbf(events: DataFrame) -> DataFrame:
    """Mean seconds between consecutive failures, NULL below two failures."""
    failed = events.filter(F.col("event") == "failure").select("component", seconds(F.col("ts")).alias("s"))
    return failed.groupBy("component").agg(
        F.count("*").alias("failures"),
        F.round(F.when(F.count("*") > 1, (F.max("s") - F.min("s")) / (F.count("*") - 1)), 4).alias("mtbf_s"))


def outage_marks(events: DataFrame, block: Column | None = None) -> DataFrame:
    """Rows where an outage starts ('start') or ends ('end').

    Requests of a component are scanned in blocks of one minute by default.
    """
    req = events.filter(F.col("event").isin("success", "failure")).select(
        "component", "ts", "event", "event_id")
    prev = scan.previous(req, ["component"], ["ts", "event_id"], F.col("event"), "before",
                         block if block is not None else F.date_trunc("minute", "ts"))
    mark = (F.when((F.col("event") == "failure") & (F.coalesce("before", F.lit("success")) == "success"), "start")
            .when((F.col("event") == "success") & (F.col("before") == "failure"), "end"))
    return prev.withColumn("mark", mark).filter(F.col("mark").isNotNull())


def mttr(events: DataFrame) -> DataFrame:
    """Closed outages and their mean seconds per component."""
    m = outage_marks(events).withColumn("s", seconds(F.col("ts")))
    starts, ends = F.col("mark") == "start", F.col("mark") == "end"
    g = m.groupBy("component").agg(
        F.count_if(starts).alias("n_start"), F.count_if(ends).alias("n_end"),
        F.sum(F.when(starts, F.col("s"))).alias("s_start"), F.sum(F.when(ends, F.col("s"))).alias("s_end"),
        F.max(F.when(starts, F.col("s"))).alias("last_start"))
    return _closed(g).select(
        "component", F.col("n_end").alias("outages"),
        F.round(F.when(F.col("n_end") > 0, F.col("down") / F.col("n_end")), 4).alias("mttr_s"))


def _closed(g: DataFrame) -> DataFrame:
    is_open = F.col("n_start") > F.col("n_end")
    started = F.coalesce("s_start", F.lit(0.0)) - F.when(is_open, F.col("last_start")).otherwise(0.0)
    return (g.withColumn("open_since", F.when(is_open, F.col("last_start")))
            .withColumn("down", F.coalesce("s_end", F.lit(0.0)) - started))


def availability(events: DataFrame, now: Column) -> DataFrame:
    """1 - downtime / (now - first failure); an open outage counts up to `now`.

    `now` is in seconds. Components without downtime have availability 1.
    """
    m = outage_marks(events).withColumn("s", seconds(F.col("ts")))
    starts, ends = F.col("mark") == "start", F.col("mark") == "end"
    g = m.groupBy("component").agg(
        F.count_if(starts).alias("n_start"), F.count_if(ends).alias("n_end"),
        F.sum(F.when(starts, F.col("s"))).alias("s_start"), F.sum(F.when(ends, F.col("s"))).alias("s_end"),
        F.max(F.when(starts, F.col("s"))).alias("last_start"), F.min(F.when(starts, F.col("s"))).alias("first_failure"))
    c = _closed(g)
    down = F.col("down") + F.coalesce(now - F.col("open_since"), F.lit(0.0))
    window = now - F.col("first_failure")
    value = F.when((down == 0) | (window <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - down / window))
    everyone = events.filter(F.col("event").isin("success", "failure")).select("component").distinct()
    return everyone.join(c.select("component", F.round(value, 6).alias("availability")), "component", "left").select(
        "component", F.coalesce("availability", F.lit(1.0)).alias("availability"))


# --- recording --------------------------------------------------------------------


class Recorder:
    """Buffers events on the driver and appends them to a JSON-lines folder.

    Writing never raises: a log that cannot be written must not stop a job.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path, self.buffer = spark, path, []

    @contextmanager
    def request(self, component: str, context: str = ""):
        start = time.perf_counter()
        try:
            yield
        except Exception as exc:
            self.add("failure", component, elapsed_ms=(time.perf_counter() - start) * 1e3, context=context, error=str(exc))
            raise
        self.add("success", component, elapsed_ms=(time.perf_counter() - start) * 1e3, context=context)

    def fallback(self, component: str, reason: str, fallback_to: str = ""):
        self.add("fallback", component, reason=reason, fallback_to=fallback_to)

    def info(self, component: str, message: str):
        self.add("info", component, message=message)

    def add(self, event: str, component: str, **extra):
        import datetime as dt
        row = {"ts": dt.datetime.now(dt.timezone.utc), "event": event, "component": component}
        row.update({k: v for k, v in extra.items() if v not in (None, "")})
        self.buffer.append(row)

    def flush(self) -> bool:
        rows = list(self.buffer)
        try:
            if rows:
                self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(self.path)
            del self.buffer[:len(rows)]
            return True
        except Exception:  # noqa: BLE001
            return False


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
