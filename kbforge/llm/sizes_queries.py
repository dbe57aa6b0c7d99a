"""Queries of percentiles (3), packing (8) and mixing (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.llm import mixing, packing, percentiles
from kbforge.llm.tokens import token_count
from kbforge.runtime import Scratch, table


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(table(spark, sf_dir, "traces"), ["operation_type", "log_day"], "duration_ms").withColumnRenamed("value", "duration_ms")


def p3_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(table(spark, sf_dir, "traces"), ["operation_type"], "duration_ms").withColumnRenamed("value", "duration_ms")


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable form: counts per type, day and value cell."""
    return percentiles.summary(table(spark, sf_dir, "traces"), ["operation_type", "log_day"], "duration_ms")


def p3_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the percentiles per type, from day summaries merged over days."""
    return percentiles.from_summary(percentiles.merge(p3_summary(spark, sf_dir), ["operation_type"]), ["operation_type"])


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens"))
    return Scratch(spark, "sizes").cut(d)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (or its pieces) in a numbered container, for each container kind."""
    sizes = [(r["container"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_sizes").where("capacity_tokens > 0").collect()]  # a fixed table
    d = sized_documents(spark, sf_dir)
    out = None
    for name, capacity in sizes:
        one = packing.pack(d, ["doc_id"], "tokens", capacity).select(F.lit(name).alias("container"), F.lit(capacity).alias("capacity"), "doc_id", "piece", F.col("piece_size").alias("tokens"), "bin")
        out = one if out is None else out.unionByName(one)
    return out


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, share of room filled, and the fewest containers that any packing needs."""
    p = p8_packed(spark, sf_dir).groupBy("container", "capacity").agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    return p.select("container", "bins", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sized_documents(spark, sf_dir).withColumnRenamed("doc_id", "record")
    return mixing.mix(d, table(spark, sf_dir, "mix_targets")).withColumnRenamed("record", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


_RANKS = """r AS (SELECT {g}, duration_ms, row_number() OVER (PARTITION BY {g} ORDER BY duration_ms) AS k, count(*) OVER (PARTITION BY {g}) AS n FROM traces WHERE duration_ms IS NOT NULL),
p AS (SELECT unnest([500, 900, 950, 990]) AS permille)"""


def _rank_sql(g: str) -> str:
    return f"WITH {_RANKS.format(g=g)} SELECT {g}, CAST(permille AS INTEGER) AS permille, n, duration_ms FROM r, p WHERE k = greatest(1, (permille * n + 999) // 1000)"


P3_SUMMARY_SQL = """WITH s AS (SELECT operation_type, log_day, duration_ms, abs(duration_ms) AS a, greatest(length(bin(abs(duration_ms))) - 7, 0) AS sh FROM traces WHERE duration_ms IS NOT NULL),
c AS (SELECT operation_type, log_day, CASE WHEN duration_ms < 0 THEN -((a >> sh) << sh) ELSE ((a >> sh) << sh) END AS cell, CAST(1 AS BIGINT) << sh AS width FROM s)
SELECT operation_type, log_day, cell, width, count(*) AS n FROM c GROUP BY ALL"""


def queries() -> dict:
    return {f.__name__: f for f in (p3_percentiles, p3_by_type, p3_summary, p3_merged, p8_packed, p8_fill, p9_mix, p9_shares)}


def oracle_sql() -> dict[str, str]:
    return {"p3_percentiles": _rank_sql("operation_type, log_day"), "p3_by_type": _rank_sql("operation_type"), "p3_summary": P3_SUMMARY_SQL}
