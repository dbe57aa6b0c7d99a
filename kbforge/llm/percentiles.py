"""Percentiles per group by exact bisection, and a mergeable count form with bounded error.

Every (group, percentile) keeps a value interval known to hold its target rank. A pass counts, for all open intervals
at once, the rows at or below a few midpoints, and narrows to the sub-interval that holds the rank. Passes read only the
group and value columns; partial sums are combined before the shuffle, so a group holding a third of the rows is harmless.

Rank of percentile p over n values: max(1, ceil(p * n)) in ascending order. Defined results: null values are left out, null
group values form a group, ties and repeated rows count each, groups without values and empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kbforge.runtime import Scratch, broadcast_if_small

PERMILLES = [500, 900, 950, 990]
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _same(a: DataFrame, b: DataFrame, groups: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[g].eqNullSafe(b[f"_g_{g}"]) for g in groups])


def percentiles(df: DataFrame, groups: list[str], value: str, permilles: list[int] | None = None, step: float | None = None, ways: int = 16) -> DataFrame:
    """(groups..., permille, n, value): exact for integer columns; for others values are cut to multiples of step (the error bound)."""
    permilles = permilles or PERMILLES
    kind = df.schema[value].dataType
    if isinstance(kind, _EXACT):
        v = F.col(value).cast("long")
    elif step:
        v = F.floor(F.col(value) / F.lit(step)).cast("long")
    else:
        raise ValueError("a column that is no integer needs a step")
    data = df.where(F.col(value).isNotNull()).select(*groups, v.alias("_v"))
    s = Scratch(df.sparkSession, "percentiles")
    first = data.groupBy(*groups).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    start = F.array(*[F.struct(F.lit(p).alias("permille"), F.expr(f"greatest(1L, ({p} * n + 999) div 1000)").alias("k"), F.col("lo").alias("lo"), F.col("hi").alias("hi")) for p in permilles])
    state = s.cut(first.select(*groups, "n", start.alias("iv")))
    # Split points inside [lo, hi), without overflow for long intervals; a count at any of them serves every percentile.
    cuts = F.expr(f"""array_sort(array_distinct(flatten(transform(filter(iv, x -> x.lo < x.hi), x -> transform(sequence(1, {ways - 1}),
        j -> x.lo + (x.hi - x.lo) div {ways} * j + (x.hi - x.lo) % {ways} * j div {ways})))))""")
    narrowed = F.expr("""transform(iv, x -> named_struct('permille', x.permille, 'k', x.k,
        'lo', greatest(x.lo, coalesce(array_max(transform(filter(cum, c -> c.n < x.k), c -> c.at)) + 1, x.lo)),
        'hi', least(x.hi, coalesce(array_min(transform(filter(cum, c -> c.n >= x.k), c -> c.at)), x.hi))))""")
    cumulated = F.expr("""transform(sequence(0, size(cuts) - 1), i -> named_struct('at', cuts[i], 'n',
        aggregate(filter(cells, e -> e.cell <= i), 0L, (a, e) -> a + e.n)))""")
    is_open = F.expr("exists(iv, x -> x.lo < x.hi)")
    while not state.where(is_open).isEmpty():
        live = state.where(is_open).withColumn("cuts", cuts)
        points = broadcast_if_small(live.select(*[F.col(g).alias(f"_g_{g}") for g in groups], "cuts"))
        cell = F.expr("size(filter(cuts, c -> c < _v))")
        counts = data.join(points, _same(data, points, groups)).groupBy(*[f"_g_{g}" for g in groups], cell.alias("cell")).agg(F.count("*").alias("n"))
        per = counts.groupBy(*[f"_g_{g}" for g in groups]).agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most one entry per split point
        new = live.join(per, _same(live, per, groups)).withColumn("cum", cumulated).select(*groups, "n", narrowed.alias("iv"))
        new = s.cut(new.unionByName(state.where(~is_open)))
        s.drop(state)
        state = new
    out = F.col("x.lo") if isinstance(kind, _EXACT) else F.col("x.lo") * F.lit(step)
    return state.select(*groups, "n", F.explode("iv").alias("x")).select(*groups, "x.permille", "n", out.alias("value"))


def summary(df: DataFrame, groups: list[str], value: str, bits: int = 7) -> DataFrame:
    """(groups..., cell, width, n): counts over a fixed value grid with cells no wider than |value| * 2^(1-bits).

    The grid doesn't depend on the data, so summaries of partitions, days or hosts merge by adding counts.
    """
    a = F.abs(F.col(value).cast("long"))
    shift = F.greatest(F.length(F.bin(a)) - F.lit(bits), F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", a, shift), shift)
    cell = F.when(F.col(value) < 0, -low).otherwise(low)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return df.where(F.col(value).isNotNull()).groupBy(*groups, cell.alias("cell"), width.alias("width")).agg(F.count("*").alias("n"))


def merge(summaries: DataFrame, groups: list[str]) -> DataFrame:
    return summaries.groupBy(*groups, "cell", "width").agg(F.sum("n").alias("n"))


def from_summary(merged: DataFrame, groups: list[str], permilles: list[int] | None = None) -> DataFrame:
    """(groups..., permille, n, low, high): bounds that hold the exact percentile. A group has at most 64 * 2^bits cells."""
    w = W.partitionBy(*groups)
    up = merged.withColumn("upto", F.sum("n").over(w.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    up = up.withColumn("permille", F.explode(F.array(*[F.lit(p) for p in permilles or PERMILLES]))).withColumn("k", F.expr("greatest(1L, (permille * total + 999) div 1000)"))
    hit = up.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
    far = F.col("width") - 1
    return hit.select(*groups, "permille", F.col("total").alias("n"), F.when(F.col("cell") < 0, F.col("cell") - far).otherwise(F.col("cell")).alias("low"), F.when(F.col("cell") < 0, F.col("cell")).otherwise(F.col("cell") + far).alias("high"))
