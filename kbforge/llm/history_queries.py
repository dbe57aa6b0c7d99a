"""Queries of deduplication against history (4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.llm import history
from kbforge.runtime import Scratch, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch in turn is checked against the index of all that came before it, and appended."""
    h = history.History(spark, Scratch(spark, "index").path("h"))
    h.add(history.accepted(table(spark, sf_dir, "knowledge_base")))
    incoming = table(spark, sf_dir, "incoming_docs").select("in_id", "batch_id", "content")
    batches = [r[0] for r in incoming.select("batch_id").distinct().collect()]  # numbers of the batches
    found = [h.check(history.numbered(incoming.where(F.col("batch_id").eqNullSafe(F.lit(b))))) for b in sorted(batches, key=lambda b: (b is None, b or 0))]
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "id long, match string")
    return out.select(F.pmod("id", F.lit(history.BATCH)).alias("in_id"), "match")


def queries() -> dict:
    return {"p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return {}
