"""Filling fixed-capacity containers: non-negative least squares over shallow length combinations, then greedy residuals.

Plan (driver): only the histogram of sizes is gathered; it has at most `capacity` entries whatever the data's size. Every
combination tried of up to three lengths with repeats filling the capacity (up to a slack) is a pattern; repeat counts solve min |A x - h|, x >= 0,
by accelerated projected gradients; counts are rounded, as far as the histogram holds the items; what remains is packed by repeating
greedy patterns, largest length first.
Assignment (cluster): items get a rank within their size, and rank ranges map to containers; ranks are built from bucket
counts, so a size held by a third of the items is spread over tasks.

Defined results: items of size 0 or null (null and empty texts) need no room and are left out; an item larger than the capacity is
cut into full containers and one rest that is packed like an item; repeated rows are separate items; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbforge.runtime import Scratch

#: Combinations are tried evenly over all lengths; this many are aimed at. Lengths in few or no combinations are packed greedily all the same.
AIM_COMBINATIONS = 400_000
RANK_BUCKET_ROWS = 20_000


def combinations(lengths: np.ndarray, capacity: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (indices into the sorted lengths + 1, repeats), each of up to three distinct lengths, that fill the capacity up to slack (index 0: unused).

    A length is taken as often as it fits, or half as often; a smaller one as often as the rest has room; a third one fills what is left.
    """
    ls = np.sort(lengths)
    stride = max(1, int(len(ls) ** 2 // AIM_COMBINATIONS))
    index, times = [], []
    for i, a in enumerate(ls):
        for m in sorted({capacity // a, (capacity // a + 1) // 2}):
            rest = int(capacity - m * a)
            if rest <= slack:
                index.append(np.array([[i + 1, 0, 0]]))
                times.append(np.array([[m, 0, 0]]))
                continue
            b = np.arange(i % stride, min(i, int(np.searchsorted(ls, rest, side="right"))), stride)
            j = rest // ls[b]
            left = rest - j * ls[b]
            c = np.where(left <= slack, -1, np.searchsorted(ls, left, side="right") - 1)
            good = (left <= slack) | (c >= 0) & (left - ls[c] <= slack)
            b, j, c = b[good], j[good], c[good]
            index.append(np.column_stack([np.full(len(b), i + 1), b + 1, c + 1]))
            times.append(np.column_stack([np.full(len(b), m), j, (c >= 0).astype(int)]))
    none = np.zeros((0, 3), dtype=np.int32)
    return np.concatenate([none, *index]).astype(np.int32), np.concatenate([none, *times]).astype(np.int32)


def nnls(combos: np.ndarray, times: np.ndarray, h: np.ndarray, rounds: int = 300, enough: float = 1e-3) -> np.ndarray:
    """min |A x - h|^2, x >= 0, where column j of A counts the lengths of combination j; A is never stored.

    Ends when a round moves x by less than the share `enough` of its size.
    """
    n = len(h) + 1
    target = np.concatenate([[0.0], h])
    cols = [(combos[:, i], times[:, i].astype(float)) for i in range(combos.shape[1])]

    def residual(x: np.ndarray) -> np.ndarray:
        r = -target.copy()
        for c, t in cols:
            r += np.bincount(c, weights=x * t, minlength=n)
        r[0] = 0.0
        return r

    deg = residual(np.ones(len(combos))) + target
    # Gershgorin-type bound per column: scaled steps converge faster than one global step.
    lip = np.maximum(sum(t * deg[c] for c, t in cols), 1.0)
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        r = residual(y)
        new = np.maximum(y - sum(w * r[c] for c, w in cols) / lip, 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        moved = np.abs(new - x).sum()
        x, t = new, t2
        if moved <= enough * x.sum():
            break
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers with the same sum up to one: shares are carried on to the next combination (largest first)."""
    order = np.argsort(-x, kind="stable")
    out = np.zeros(len(x), dtype=np.int64)
    out[order] = np.diff(np.floor(np.concatenate([[0.0], np.cumsum(x[order])]) + 1e-6)).astype(np.int64)
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: items per container}, repeats) that hold every item of the histogram (sizes 1..capacity)."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    patterns: list[tuple[dict[int, int], int]] = []
    combos, repeats = combinations(sizes, capacity, max(1, capacity // 512))
    if len(combos):
        x = rounded(nnls(combos, repeats, left.astype(float)))
        for j in np.flatnonzero(x)[np.argsort(-x[x > 0], kind="stable")]:
            need = {int(k) - 1: int(m) for k, m in zip(combos[j], repeats[j], strict=True) if k}
            times = min([int(x[j]), *(int(left[k]) // m for k, m in need.items())])
            if times:
                for k, m in need.items():
                    left[k] -= times * m
                patterns.append(({int(sizes[k]): m for k, m in need.items()}, times))
    live = np.flatnonzero(left)
    while len(live):
        room, need = capacity, {}
        end = len(live)
        while room > 0 and end > 0:
            end = int(np.searchsorted(sizes[live[:end]], room, side="right"))
            if not end:
                break
            k = live[end - 1]
            m = min(int(left[k]), room // int(sizes[k]))
            need[k] = m
            room -= m * int(sizes[k])
            end -= 1
        times = min(int(left[k]) // m for k, m in need.items())
        for k, m in need.items():
            left[k] -= times * m
        patterns.append(({int(sizes[k]): m for k, m in need.items()}, times))
        live = live[left[live] > 0]
    return patterns


def ranked(items: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Add rank: consecutive from 0 within key, built from bucket counts so that no key's rows meet in one task."""
    n = items.groupBy(key).agg(F.count("*").alias("_n"))
    # Rows with equal ids get different random places by position-free hashing of ids and are told apart by row_number.
    b = items.join(n, key).withColumn("_b", F.pmod(F.xxhash64(*ids), F.ceil(F.col("_n") / RANK_BUCKET_ROWS))).drop("_n")
    per = b.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    base = per.withColumn("_base", F.coalesce(F.sum("_c").over(W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = F.row_number().over(W.partitionBy(key, "_b").orderBy(*ids)) - 1
    return b.withColumn("_in", inside).join(base, [key, "_b"]).withColumn("rank", F.col("_base") + F.col("_in")).drop("_b", "_base", "_in")


def pack(items: DataFrame, ids: list[str], size: str, capacity: int) -> DataFrame:
    """(ids..., piece, piece_size, bin): every item, or each piece of a larger one, in a numbered container."""
    spark = items.sparkSession
    s = Scratch(spark, "packing")
    z = F.col(size)
    good = items.where(z > 0).select(*ids, z.cast("long").alias("_z"))
    whole = good.where(F.col("_z") >= capacity).select(*ids, F.explode(F.expr(f"sequence(0, cast(_z div {capacity} - 1 as int))")).alias("piece"), F.lit(capacity).cast("long").alias("piece_size"))
    rest = good.select(*ids, F.expr(f"_z div {capacity}").cast("int").alias("piece"), F.expr(f"_z % {capacity}").alias("piece_size")).where("piece_size > 0")
    parts = s.cut(rest.unionByName(whole))
    hist = {int(r[0]): int(r[1]) for r in parts.groupBy("piece_size").count().collect()}  # at most `capacity` rows
    slots, bin0, used = [], 0, dict.fromkeys(hist, 0)
    for need, times in plan(hist, capacity):
        for k, m in need.items():
            slots.append((k, used[k], used[k] + m * times, m, bin0))
            used[k] += m * times
        bin0 += times
    by_size: dict[int, list] = {}
    for k, *x in slots:
        by_size.setdefault(k, []).append(tuple(x))
    table = spark.createDataFrame([(k, v) for k, v in by_size.items()], "piece_size long, slots array<struct<lo:long,hi:long,m:long,bin0:long>>")
    r = ranked(parts, "piece_size", [*ids, "piece"]).join(F.broadcast(table), "piece_size")  # at most `capacity` rows
    slot = F.filter("slots", lambda x: (F.col("rank") >= x["lo"]) & (F.col("rank") < x["hi"]))[0]
    return r.withColumn("_s", slot).select(*ids, "piece", F.col("piece_size"), F.expr("_s.bin0 + (rank - _s.lo) div _s.m").alias("bin"))
