"""Documents as they come: each micro-batch appends its postings and lengths; ranking is over all that is there.

A batch's files bear its number and are overwritten when it is tried again, so a restart adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from impactspark.operators import index


def ingest(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True, mode: str = "plain") -> StreamingQuery:
    """Index a stream docs(doc_id, text) under path."""

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rows = index.token_rows(batch, mode)
            index.postings(rows).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
            index.doc_lengths(batch, None if mode == "plain" else rows).write.mode("overwrite").parquet(f"{path}/doc_lengths/batch={number}")
        finally:
            batch.unpersist()

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, path: str, mode: str = "plain", **options) -> index.Index:
    """The index over all batches so far, of the mode they were taken in; frequencies, lengths and bounds are of the whole."""
    posts = index.union_postings(spark.read.parquet(f"{path}/postings").drop("batch"))
    lengths = spark.read.parquet(f"{path}/doc_lengths").groupBy("doc_id").agg(F.sum("length").alias("length"))
    return index.Index(posts, lengths, index.quantized(index.scored(posts, lengths, **options)), None, mode)
