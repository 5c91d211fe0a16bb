"""Segmented ingest as a stream: every micro-batch writes two layouts, and a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import rules as R


def write_batch(docs: DataFrame, batch: int, root: str, chunker: Callable[[DataFrame], DataFrame], between: Callable[[int], None] | None = None) -> None:
    """Chunks of a micro-batch by kind and by collection, below folders named by the batch.

    A batch that failed after the first layout is run again under the same number: both layouts are overwritten, so a
    repetition adds no rows. `between` is called between the two writes.
    """
    chunks = chunker(docs)
    chunks.write.mode("overwrite").partitionBy("kind").parquet(f"{root}/typed/batch={batch}")
    if between is not None:
        between(batch)
    stored = docs.sparkSession.read.schema(chunks.schema).parquet(f"{root}/typed/batch={batch}")
    (stored.withColumn("collection", R.collection_of_type("kind")).write.mode("overwrite").partitionBy("collection")
     .parquet(f"{root}/collections/batch={batch}"))


def start(docs: DataFrame, root: str, chunker: Callable[[DataFrame], DataFrame], between: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start the ingest of a stream of documents (with `kind`); it takes what is there and stops."""
    writer = docs.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    return writer.foreachBatch(lambda df, batch: write_batch(df, batch, root, chunker, between)).start()


def collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Chunks of one collection over all batches; only its partitions are read."""
    return spark.read.parquet(f"{root}/collections").filter(F.col("collection") == name)
