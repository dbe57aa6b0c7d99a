"""Streaming: a file stream that reconciles each micro-batch with the base, and sliding health counts with late data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kbforge.operators import kb


def health_stream(errors: DataFrame, late: str = "1 hour", width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Sliding counts per severity of a stream (ts, severity)."""
    w = errors.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "severity").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "severity", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "2 seconds") -> DataFrame:
    """Drops repeats that arrive within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def index_stream(spark: SparkSession, docs: DataFrame, store: kb.Store, checkpoint: str, to_rows) -> StreamingQuery:
    """Each micro-batch of documents (file_path, content, ...) is classified against the committed base and committed as a whole.

    Equal contents within a batch collapse to the last path. to_rows(new_docs) gives the base rows of documents to be indexed.
    """

    def step(batch: DataFrame, _: int) -> None:
        b = batch.withColumn("content_hash", kb.content_hash(F.col("content")))
        one = b.groupBy("content_hash").agg(F.max_by(F.struct(*b.columns), "file_path").alias("d")).select("d.*")
        at = datetime.now().isoformat(timespec="seconds")
        with store.lock():  # from reading to committing, so that no writer's rows are lost
            base = store.read()
            if base is None:
                store.write(to_rows(one))
                return
            c = store.scratch(kb.classify(one, base, cap=None), "classified")
            fresh = to_rows(c.where("action in ('new', 'changed')").drop("action"))
            store.write(kb.reconcile(base, c, at).unionByName(fresh))

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
