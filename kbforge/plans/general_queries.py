"""Queries of the general data problems: hierarchies (5) and timestamps (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.operators import hierarchy, timestamps
from kbforge.runtime import Scratch, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy.decompose(table(spark, sf_dir, "traces"), "trace_id", "parent_trace_id")
    return h.select(F.col("id").alias("trace_id"), F.col("root_id").alias("root_trace_id"), "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and number of descendants of every trace."""
    h = hierarchy.with_paths(hierarchy.decompose(table(spark, sf_dir, "traces"), "trace_id", "parent_trace_id"))
    return h.select(F.col("id").alias("trace_id"), "path", "depth", "n_descendants")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of every trace as intervals: x descends from y exactly if both have one root and y.enter < x.enter < y.leave."""
    h = hierarchy.decompose(table(spark, sf_dir, "traces"), "trace_id", "parent_trace_id")
    return h.select(F.col("id").alias("trace_id"), F.col("root_id").alias("root_trace_id"), "enter", "leave")


# Timestamp and context columns of the log tables.
LOG_TIMES = [("errors", "timestamp", "context"), ("token_usage", "timestamp", "metadata"), ("traces", "start_time", "metadata")]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "log_hosts")
    d = timestamps.TimestampDictionary(spark, Scratch(spark, "times").path("dictionary"))
    out = None
    for name, col, context in LOG_TIMES:
        rows = table(spark, sf_dir, name).where(F.col(col).isNotNull()).select("row_id", F.col(col).alias("raw"), F.get_json_object(context, "$.host").alias("_host_name"))
        rows = timestamps.with_zone(rows, hosts, F.col("_host_name")).select(F.lit(name).alias("tbl"), "row_id", "raw", "zone")
        d.update(rows)
        out = rows if out is None else out.unionByName(rows)
    return d.lookup(out).where(F.col("utc_us").isNotNull()).select("tbl", "row_id", "utc_us")


SQL_NODES = """nodes0 AS (SELECT trace_id AS id, min(CASE WHEN lower(trim(parent_trace_id)) IN ('', 'none', 'null', 'nan', '-', 'n/a') THEN NULL ELSE parent_trace_id END) AS p
  FROM traces WHERE trace_id IS NOT NULL AND lower(trim(trace_id)) NOT IN ('', 'none', 'null', 'nan', '-', 'n/a') GROUP BY 1),
nodes AS (SELECT a.id, b.id AS parent FROM nodes0 a LEFT JOIN nodes0 b ON a.p = b.id)"""

P5_FOUND_SQL = f"""WITH RECURSIVE {SQL_NODES},
t(id, root, depth) AS (SELECT id, id, 0 FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.root, t.depth + 1 FROM t JOIN nodes n ON n.parent = t.id)
SELECT n.id AS trace_id, coalesce(t.root, '') AS root_trace_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth FROM nodes n LEFT JOIN t ON n.id = t.id"""

P5_PATHS_SQL = f"""WITH RECURSIVE {SQL_NODES},
t(id, path, depth) AS (SELECT id, id, 0 FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.path || '/' || n.id, t.depth + 1 FROM t JOIN nodes n ON n.parent = t.id),
a AS (SELECT unnest(string_split(path, '/')) AS up FROM t), s AS (SELECT up, count(*) - 1 AS n FROM a GROUP BY 1)
SELECT n.id AS trace_id, coalesce(t.path, '') AS path, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, s.n AS n_descendants
FROM nodes n LEFT JOIN t ON n.id = t.id LEFT JOIN s ON n.id = s.up"""


def queries() -> dict:
    return {"p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants, "p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND_SQL, "p5_paths": P5_PATHS_SQL}
