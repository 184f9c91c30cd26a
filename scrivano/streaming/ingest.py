"""Continuous intake: new documents are cut into chunks and inserted where absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.operators import chunks, lines, store

SCHEMA = "doc_id string, text string"


def watch(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def upsert_passages(batch: DataFrame, path: str) -> int:
    p = chunks.passages(lines.lines(lines.documents(batch)))
    return store.append(p.select("id", "text", F.col("chunk_id").cast("long").alias("pos"), "doc_id"), path)


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Passages of every micro-batch go to the store at ``path``; a batch replayed after a failure adds nothing twice."""
    w = stream.writeStream.foreachBatch(lambda b, _: upsert_passages(b, path) and None).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
