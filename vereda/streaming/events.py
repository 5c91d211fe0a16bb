"""The event metrics as a stream (an extension; the batch form is the reference).

Counts and latencies per component and window come from a watermarked
aggregation; outages come from keyed state that remembers whether a component
is down and since when.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTAGE = "component string, started timestamp, ended timestamp, seconds double"


def windowed_summary(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, failures and mean latency per component and window."""
    request = F.col("event").isin("success", "failure")
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window), "component").agg(
        F.count_if(request).alias("requests"), F.count_if(F.col("event") == "failure").alias("failures"),
        F.round(F.avg(F.when(request, F.col("elapsed_ms"))), 4).alias("avg_latency_ms"))
    return g.select(F.col("window.start").alias("start"), "component", "requests", "failures", "avg_latency_ms")


def outages(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Closed outages, emitted when the first success after a failure arrives.

    Rows of one trigger are ordered by time within a component before they
    update its state.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        down_since = state.get[0] if state.exists else None
        rows = [pdf[["ts", "event"]] for pdf in batches]
        out = []
        if rows:
            for ts, event in pd.concat(rows).sort_values("ts").itertuples(index=False):
                if event == "failure" and down_since is None:
                    down_since = ts
                elif event == "success" and down_since is not None:
                    start = pd.Timestamp(down_since)
                    out.append((key[0], start, ts, (ts - start).total_seconds()))
                    down_since = None
        state.update((down_since,))
        if out:
            yield pd.DataFrame(out, columns=["component", "started", "ended", "seconds"])

    requests = events.filter(F.col("event").isin("success", "failure")).select("component", "ts", "event").withWatermark("ts", late)
    return requests.groupBy("component").applyInPandasWithState(
        step, OUTAGE, "down_since timestamp", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there now into Parquet and stop."""
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
