"""Parent-child links to full hierarchies by heavy-path decomposition.

Stages, each a constant number of equi-joins, repeated O(log depth) times:
1. one row per node; a parent that is blank, null or no node makes the node a root;
2. doubling of ancestor pointers separates the nodes that reach a root from those on or below a cycle, and adds up
   subtree sizes on the way (a node's count over distance < 2^k feeds its 2^k-th ancestor's);
3. the child with the largest subtree continues its parent's chain; a node's position in its chain comes from
   doubling along heavy links only;
4. chains form a forest of depth <= log2(n): roots, depths and preorder intervals are resolved chain by chain.

Defined results: null and blank ids are no nodes; repeated rows count once; if a node names several parents the
smallest is taken; a parent equal to the node itself is a cycle; nodes on or below a cycle have root '' and depth -1
and no interval; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbforge.runtime import Scratch

# Spellings of "no parent" in the logs.
NO_PARENT = ["", "none", "null", "nan", "-", "n/a"]
SIBLINGS_PER_BUCKET = 10_000


def _blank(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(NO_PARENT)


def nodes_of(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row (id, parent) per distinct id; parent is null for roots."""
    ids = rows.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("p")).where(~_blank(F.col("id")))
    one = ids.groupBy("id").agg(F.min(F.when(~_blank(F.col("p")), F.col("p"))).alias("p"))
    known = one.select(F.col("id").alias("parent"))
    return one.join(known, F.col("p") == F.col("parent"), "left").select("id", "parent")


def _doubling(nodes: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(id, parent, size) of the acyclic part, and the ids on or below cycles (None if there are none).

    Only nodes with an ancestor at distance 2^k take part in pass k. What they add to that ancestor's size is written once and summed at the end,
    so resolved nodes are not moved again.
    """
    open_ = s.cut(nodes.where(F.col("parent").isNotNull()).select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size")), "open")
    ledger, fed_tables, left, before = None, [], open_.count(), -1
    while left and left != before:  # every pass resolves the shallowest open depth, so what stays never ends
        fed = s.cut(open_.groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("more")), "fed")
        fed_tables.append(fed)
        ledger = fed if ledger is None else ledger.unionByName(fed)
        up = open_.select(F.col("id").alias("anc"), F.col("anc").alias("next"))
        new = open_.join(up, "anc").join(fed, "id", "left").select("id", F.col("next").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        new = s.cut(new, "open")
        s.drop(open_)
        open_, before, left = new, left, new.count()
    tree = nodes if not left else nodes.join(open_.select("id"), "id", "left_anti")
    if ledger is None:
        return tree.withColumn("size", F.lit(1).cast("long")), None
    more = ledger.groupBy("id").agg(F.sum("more").alias("more"))
    sized = s.cut(tree.join(more, "id", "left").select("id", "parent", (1 + F.coalesce("more", F.lit(0))).alias("size")), "tree")
    s.drop(*fed_tables)
    return sized, open_.select("id") if left else None


def _jump(start: DataFrame, key: str, to: str, done: Column, add: list[str], s: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Pointer jumping: rows (key, to, add...) whose target is no row's key, or that are `done`, have arrived; others take over their target's pointer
    and add its amounts until all have. Only rows on the way are moved; arrived ones are looked up. Also gives the stored tables that the result reads."""
    columns = [key, to, *add]
    tables = [s.cut(start.select(*columns, done.alias("done")), "jump")]
    arrived, going = [tables[0].where("done")], tables[0].where("not done")
    while not going.isEmpty():
        every = going
        for x in arrived:
            every = every.unionByName(x)
        at = every.select(F.col(key).alias(to), F.col(to).alias("_to"), F.col("done").alias("_done"), *[F.col(c).alias(f"_{c}") for c in add])
        sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in add]
        new = s.cut(going.join(at, to, "left").select(key, F.coalesce("_to", to).alias(to), *sums, F.coalesce("_done", F.lit(True)).alias("done")), "jump")
        tables.append(new)
        arrived.append(new.where("done"))
        going = new.where("not done")
    out = arrived[0]
    for x in arrived[1:]:
        out = out.unionByName(x)
    return out.drop("done"), tables


def _chains(tree: DataFrame, s: Scratch) -> DataFrame:
    """Add head (first node of the chain) and pos (place in the chain, from 0)."""
    heavy = tree.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.max(F.struct("size", "id")).alias("h")).select(F.col("h.id").alias("id"), F.col("parent").alias("hop"), F.lit(1).cast("long").alias("pos"))
    places, tables = _jump(heavy, "id", "hop", F.lit(False), ["pos"], s)
    chained = tree.join(places, "id", "left").select("id", "parent", "size", F.coalesce("hop", "id").alias("head"), F.coalesce("pos", F.lit(0)).alias("pos"))
    chained = s.cut(chained, "chain")
    s.drop(tree, *tables)
    return chained


def _entry_offsets(nodes: DataFrame) -> DataFrame:
    """For each chain head below a parent: preorder offset from the parent's own place (light subtrees after the heavy one).

    Siblings are summed in buckets of bounded size, then within buckets, so no parent's children meet in one task.
    """
    heads = nodes.where((F.col("id") == F.col("head")) & F.col("parent").isNotNull()).select("id", "parent", "size")
    n = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("n"), F.max("size").alias("heavy_size"))
    b = heads.join(n, "parent").withColumn("bucket", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SIBLINGS_PER_BUCKET)))
    per = b.groupBy("parent", "bucket").agg(F.sum("size").alias("total"))
    before = per.withColumn("base", F.coalesce(F.sum("total").over(W.partitionBy("parent").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("total")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("parent", "bucket").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("inside", inside).join(before, ["parent", "bucket"]).select("id", (F.col("heavy_size") + 1 + F.col("base") + F.col("inside")).alias("offset"))


def decompose(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row per node: id, parent, root_id, depth, n_descendants, head, pos, enter, leave.

    Within one root, x is a descendant of y exactly if y.enter < x.enter < y.leave.
    """
    s = Scratch(rows.sparkSession, "hierarchy")
    nodes = s.cut(nodes_of(rows, id_col, parent_col), "nodes")
    tree, cyclic = _doubling(nodes, s)
    chained = _chains(tree, s)
    # Chains: each hangs below place ppos of the parent's chain.
    up = chained.select(F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("ppos"))
    c = chained.where(F.col("id") == F.col("head")).select("id", "parent").join(up, "parent", "left").join(_entry_offsets(chained), "id", "left")
    links = c.select(
        F.col("id").alias("head"), "up", F.coalesce(F.col("ppos") + 1, F.lit(0)).alias("depth"),
        F.coalesce(F.col("ppos") + F.col("offset"), F.lit(0)).alias("enter"),
    )
    links, _ = _jump(links.withColumn("up", F.coalesce("up", "head")), "head", "up", F.col("up") == F.col("head"), ["depth", "enter"], s)
    good = chained.join(links.select("head", F.col("up").alias("root_id"), F.col("depth").alias("cd"), F.col("enter").alias("ce")), "head").select(
        "id", "parent", "root_id", (F.col("cd") + F.col("pos")).cast("int").alias("depth"), (F.col("size") - 1).alias("n_descendants"),
        "head", "pos", (F.col("ce") + F.col("pos")).alias("enter"), (F.col("ce") + F.col("pos") + F.col("size")).alias("leave"),
    )
    if cyclic is None:
        return good
    null = F.lit(None)
    bad = cyclic.join(nodes, "id").select(
        "id", "parent", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), null.cast("long").alias("n_descendants"),
        null.cast("string").alias("head"), null.cast("long").alias("pos"), null.cast("long").alias("enter"), null.cast("long").alias("leave"),
    )
    return good.unionByName(bad)


def with_paths(labels: DataFrame, sep: str = "/") -> DataFrame:
    """Add path: the ids from the root to the node, joined by sep, put together from chain segments ('' for cyclic nodes).

    The prefix of a chain is the path of the node it hangs from; chains are resolved level by level, at most log2(n)
    levels. A path has depth + 1 ids, so the longest array held for a row is the longest path itself.
    """
    s = Scratch(labels.sparkSession, "paths")
    lab = s.cut(labels, "labels")
    ok = lab.where(F.col("head").isNotNull())
    segs = ok.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("seg"))
    at = ok.select(F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("upos"))
    chains = s.cut(ok.where(F.col("id") == F.col("head")).select("head", "parent").join(segs, "head").join(at, "parent", "left").drop("parent"), "segments")
    done = s.cut(chains.where(F.col("up").isNull()).select("head", "seg", F.array().cast("array<string>").alias("prefix")), "level")
    todo, levels = chains.where(F.col("up").isNotNull()), [done]
    while not done.isEmpty():
        p = done.select(F.col("head").alias("up"), F.col("seg").alias("pseg"), F.col("prefix").alias("pp"))
        nxt = todo.join(p, "up").select("head", "seg", F.concat("pp", F.slice("pseg", F.lit(1), (F.col("upos") + 1).cast("int"))).alias("prefix"))
        done = s.cut(nxt, "level")
        levels.append(done)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    full = F.concat_ws(sep, F.concat("prefix", F.slice("seg", F.lit(1), (F.col("pos") + 1).cast("int"))))
    return lab.join(every, "head", "left").withColumn("path", F.coalesce(F.when(F.col("head").isNotNull(), full), F.lit(""))).drop("prefix", "seg")


def descendants(labels: DataFrame, of: DataFrame) -> DataFrame:
    """(id, descendant) for the ids in `of` (column id): nodes of the same root whose enter lies inside the id's interval."""
    q = labels.join(of.select("id").distinct(), "id").select("id", "root_id", F.col("enter").alias("lo"), F.col("leave").alias("hi")).where(F.col("lo").isNotNull())
    n = labels.select("root_id", F.col("id").alias("descendant"), "enter").where(F.col("enter").isNotNull())
    return q.join(n, "root_id").where((F.col("enter") > F.col("lo")) & (F.col("enter") < F.col("hi"))).select("id", "descendant")
