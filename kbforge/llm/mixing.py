"""Mixing sources to target token shares by Pareto order sampling.

Per mix, the total is the largest that every source can supply with its capped repeats. A source that owes d tokens of a available
gives floor(d / a) whole copies of every record for certain; the rest is a sample without replacement: record i with inclusion
probability p_i (rising with the square root of its size) has the order key (u/(1-u)) / (p_i/(1-p_i)) and the smallest keys are taken up
to the owed tokens. u is a hash of mix, record and seed, so a run can be repeated. Keys are summed in ranges first and only the
range in which the owed amount is reached is sorted, so a source with a third of the records is no single task.

Defined results: records of null or other sources take part in no mix; records of null, empty or zero-token texts add nothing and are left out;
a source without records in the data drops out and the shares of the others are kept in proportion (the report shows it with 0); repeated
record ids are separate records; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbforge.runtime import Scratch, broadcast_if_small

RANGE_ROWS = 20_000


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, target_share, max_repeats, avail, records, owed, copies, part): one row per mix and source; small."""
    avail = sized.where("source is not null and tokens > 0").groupBy("source").agg(F.sum("tokens").alias("avail"), F.count("*").alias("records"), F.sum(F.pow("tokens", F.lit(1.5))).alias("mass"))
    t = targets.where("target_share > 0 and max_repeats > 0 and mix is not null").join(avail, "source", "left")
    live = F.sum(F.when(F.col("avail").isNotNull(), F.col("target_share"))).over(W.partitionBy("mix"))
    t = t.withColumn("share", F.when(F.col("avail").isNotNull(), F.col("target_share") / live))
    total = F.min(F.col("avail") * F.col("max_repeats") / F.col("share")).over(W.partitionBy("mix"))
    t = t.withColumn("owed", F.floor(total * F.col("share") + F.lit(1e-6)))
    t = t.withColumn("copies", F.least(F.floor(F.col("owed") / F.col("avail")), F.col("max_repeats").cast("long")))
    return t.withColumn("part", F.col("owed") - F.col("copies") * F.col("avail")).drop("share")


def mix(records: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(mix, record, source, tokens, copies) from records (record, source, tokens) and targets (mix, source, target_share, max_repeats)."""
    s = Scratch(records.sparkSession, "mixing")
    sized = s.cut(records.where("tokens > 0 and source is not null").select("record", "source", "tokens"))
    p = s.cut(plan(sized, targets.select("mix", "source", "target_share", "max_repeats")).where("avail is not null"))
    each = sized.join(broadcast_if_small(p.select("mix", "source", "copies", "part", "mass", "records")), "source")
    u = (F.pmod(F.xxhash64(F.lit(seed), "mix", "record"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # Expected sampled tokens equal the part where no probability is cut: sum of c * sqrt(t) * t = part.
    pi = F.least(F.greatest(F.col("part") * F.sqrt("tokens") / F.col("mass"), F.lit(1e-9)), F.lit(1 - 1e-9))
    q = (u / (1 - u)) / (pi / (1 - pi))
    each = each.withColumn("key", q / (1 + q)).withColumn("range", F.floor(F.col("key") * F.ceil(F.col("records") / RANGE_ROWS)))
    certain = each.where("copies > 0 or part > 0")
    sums = certain.groupBy("mix", "source", "range").agg(F.sum("tokens").alias("in_range"))
    before = sums.withColumn("base", F.coalesce(F.sum("in_range").over(W.partitionBy("mix", "source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    b = certain.join(broadcast_if_small(before), ["mix", "source", "range"])
    whole = b.where(F.col("base") + F.col("in_range") <= F.col("part")).withColumn("extra", F.lit(1))
    none = b.where(F.col("base") >= F.col("part")).withColumn("extra", F.lit(0))
    cross = b.where((F.col("base") < F.col("part")) & (F.col("base") + F.col("in_range") > F.col("part")))
    run = F.col("base") + F.sum("tokens").over(W.partitionBy("mix", "source", "range").orderBy("key", "record").rowsBetween(W.unboundedPreceding, 0))
    cross = cross.withColumn("extra", F.when(run - F.col("tokens") / 2 <= F.col("part"), 1).otherwise(0))
    out = whole.unionByName(none).unionByName(cross).withColumn("copies", (F.col("copies") + F.col("extra")).cast("int"))
    return out.where("copies > 0").select("mix", "record", "source", "tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, target_share, actual_share, tokens, most_copies) of a result of mix()."""
    got = mixed.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.max("copies").alias("most_copies"))
    t = targets.select("mix", "source", "target_share").join(got, ["mix", "source"], "left")
    total = F.sum("got").over(W.partitionBy("mix"))
    return t.select("mix", "source", "target_share", F.coalesce(F.col("got") / total, F.lit(0.0)).alias("actual_share"), F.coalesce("got", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
