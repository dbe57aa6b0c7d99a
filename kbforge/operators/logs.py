"""Log analytics over token, trace and error rows. Prices are a parameter (a small table), so no business figures live here.

Null amounts count as 0 in sums and are left out of averages and percentiles; month filters compare the text's prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.runtime import broadcast_if_small

SLOW_MS = 10_000


def cost(tokens: DataFrame, prices: DataFrame, default: str = "default") -> DataFrame:
    """Add cost from prices (model, in_price, out_price) per token; unknown models take the row named default."""
    base = prices.where(F.col("model") == default).select(F.col("in_price").alias("_di"), F.col("out_price").alias("_do"))
    p = prices.where(F.col("model") != default).select("model", "in_price", "out_price")
    t = tokens.join(broadcast_if_small(p), "model", "left").crossJoin(F.broadcast(base.limit(1)))  # one row
    c = F.coalesce("tokens.input", F.lit(0)) * F.coalesce("in_price", "_di") + F.coalesce("tokens.output", F.lit(0)) * F.coalesce("out_price", "_do")
    return t.withColumn("cost", F.round(c, 6)).drop("in_price", "out_price", "_di", "_do")


def month(col: str, prefix: str) -> Column:
    return F.col(col).startswith(prefix)


def token_totals(t: DataFrame) -> DataFrame:
    n = F.coalesce("tokens.total", F.lit(0))
    est = F.coalesce("estimated", F.lit(False))
    return t.agg(F.sum(n).alias("total_tokens"), F.round(F.sum("cost_usd"), 6).alias("total_cost"), F.count("*").alias("operations"), F.count_if(est).alias("estimated"), F.count_if(~est).alias("exact"))


def tokens_by(t: DataFrame, col: str) -> DataFrame:
    return t.groupBy(col).agg(F.sum(F.coalesce("tokens.total", F.lit(0))).alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost"))


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def latency_summary(t: DataFrame, by: list[str] | None = None) -> DataFrame:
    d = t.where(F.col("duration_ms").isNotNull())
    g = d.groupBy(*(by or []))
    return g.agg(F.count("*").alias("operations"), F.sum("duration_ms").alias("total_ms"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.count_if(F.col("duration_ms") > SLOW_MS).alias("slow"))


def grade(slow: Column, total: Column) -> Column:
    share = F.floor(100 * slow / F.greatest(total, F.lit(1)))
    return F.when(share < 5, "excellent").when(share < 10, "good").when(share < 20, "fair").otherwise("poor")


def nth_percentiles(t: DataFrame, by: str | None, permilles: list[int]) -> DataFrame:
    """sorted[floor(n * p)] (0-based) per group.

    Counts per distinct value are made before the shuffle and summed over a grid of at most 64 * 128 cells a group; only the cells that hold a
    rank are then ordered value by value, so neither a group's rows nor its distinct values meet in one task.
    """
    from pyspark.sql import Window as W

    d = t.where(F.col("duration_ms").isNotNull())
    keys = [by] if by else []
    same = [F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("_g")] if by else [F.lit("").alias("_g")]
    size = F.greatest(F.length(F.bin(F.abs(F.col("duration_ms")))) - 7, F.lit(0))
    cell = F.signum("duration_ms").cast("long") * F.call_function("shiftleft", F.call_function("shiftright", F.abs(F.col("duration_ms")), size), size)
    c = d.groupBy(*keys, "duration_ms").agg(F.count("*").alias("c")).select(*keys, *same, cell.alias("_cell"), "duration_ms", "c")
    per = c.groupBy(*keys, "_g", "_cell").agg(F.sum("c").alias("c"))
    w = W.partitionBy("_g")
    per = per.withColumn("upto", F.sum("c").over(w.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    per = per.withColumn("permille", F.explode(F.array(*map(F.lit, permilles)))).withColumn("k", F.expr("least((n * permille) div 1000, n - 1)"))
    hit = per.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k"))).select("_g", "_cell", "permille", (F.col("k") - F.col("upto") + F.col("c")).alias("k"))
    r = c.join(hit, ["_g", "_cell"])
    r = r.withColumn("upto", F.sum("c").over(W.partitionBy("_g", "_cell", "permille").orderBy("duration_ms").rowsBetween(W.unboundedPreceding, 0)))
    return r.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k"))).select(*keys, "permille", F.col("duration_ms").alias("value"))


def duration_ms(start_ns: Column, end_ns: Column) -> Column:
    """Whole milliseconds between two instants in nanoseconds, cut towards zero."""
    return F.call_function("div", end_ns.cast("long") - start_ns.cast("long"), F.lit(1_000_000))


def daily_average(totals: DataFrame, month_prefix: str) -> DataFrame:
    """Add tokens and cost per day of the month (yyyy-mm): whole tokens, cost cut to two digits."""
    days = F.day(F.last_day(F.to_date(F.lit(month_prefix + "-01"))))
    return totals.withColumns({"tokens_per_day": F.floor(F.col("total_tokens") / days), "cost_per_day": F.floor(F.col("total_cost") / days * 100) / 100})


def last(df: DataFrame, order: str, k: int) -> DataFrame:
    """The last k rows by a column, in its order."""
    return df.orderBy(F.desc(order)).limit(k).orderBy(order)


def first_per_group(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group with place (rn) and the group's number of rows (n); ranks are cut before the shuffle."""
    from pyspark.sql import Window as W

    n = df.groupBy(group).agg(F.count("*").alias("n"))
    top = df.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("rn") <= k)
    return top.join(n, top[group].eqNullSafe(n[group])).drop(n[group])


def operation_rows(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token rows, trace rows) of search operations (query, chunks, latency_ms, tokens, conversation_id, trace_id, end_ns); traces need a trace_id."""
    conv = F.coalesce("conversation_id", F.lit("unknown"))
    zero = F.lit(0).cast("long")
    tokens = searches.select(
        conv.alias("conversation_id"), F.lit("rag_search").alias("operation_type"), F.concat(F.lit("search:"), F.substring("query", 1, 30), F.lit("...")).alias("operation_name"),
        F.struct(zero.alias("input"), F.col("tokens").alias("output"), F.col("tokens").alias("total")).alias("tokens"), F.lit(True).alias("estimated"),
    )
    meta = F.to_json(F.struct(F.col("chunks").alias("num_chunks"), F.col("tokens").alias("tokens")))
    start = F.col("end_ns") - F.col("latency_ms") * 1_000_000
    traces = searches.where(F.col("trace_id").isNotNull()).select(
        conv.alias("conversation_id"), "trace_id", F.lit("rag_search").alias("operation_type"), F.concat(F.lit("search:"), F.col("chunks").cast("string"), F.lit("_chunks")).alias("operation_name"),
        start.cast("string").alias("start_time"), F.col("end_ns").cast("string").alias("end_time"), duration_ms(start, F.col("end_ns")).alias("duration_ms"), meta.alias("metadata"),
    )
    return tokens, traces


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def severity_counts(e: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    g = F.when(F.col("errors") == 0, "excellent").when(F.col("errors") < 10, "good").when(F.col("errors") < 50, "fair").otherwise("poor")
    return e.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos")).withColumn("health", g)


def recommendations(errors: Column, warnings: Column) -> Column:
    return F.array_compact(F.array(
        F.when(errors > 50, "investigate frequent errors"), F.when(warnings > 100, "review warnings"),
        F.when(errors == 0, "no errors"), F.when((errors == 0) & (warnings == 0), "no events"),
    ))


def health_window(errors: DataFrame, ops: DataFrame, as_of: str, days: int) -> DataFrame:
    """Counts and error rate of the days up to as_of (inclusive), from rows with log_day."""
    inside = (F.col("log_day") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("log_day") <= F.lit(as_of).cast("date"))
    n = lambda s: F.count_if(F.col("severity") == s)
    e = errors.where(inside).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    o = ops.where(inside).agg(F.count("*").alias("ops"))
    rate = F.when(F.col("ops") > 0, F.round(100 * F.col("errors") / F.col("ops"), 2)).otherwise(0.0)
    g = F.when(F.col("rate") < 0.5, "excellent").when(F.col("rate") < 1.0, "good").when(F.col("rate") < 2.0, "fair").otherwise("poor")
    return e.crossJoin(o).withColumn("days", F.lit(days)).withColumn("rate", rate).withColumn("grade", g)  # one row each


def shortened(c: Column, n: int = 60) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)
