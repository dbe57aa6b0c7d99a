"""Deduplicating new batches against all accepted history.

A text's full vector is its sequence of words in lower case, kept as 32-bit numbers. Two texts of n and m words are close if their longest
common subsequence has at least LEAST_COMMON * max(n, m) words. The persisted index holds, for one text per class of equal
word sequences, its full vector, and cells: a cell is a shingle (five words, the smallest of eight consecutive ones) with the first text
that has it. A batch reads cells and vectors, never the history's texts, and appends to both.

A batch finds its near repeats in two steps:
* Probing: a query reads its own cells only; the text that most of them name is compared exactly. This settles most repeats at a cost that
  grows with the batch, not with the history.
* Every query that this leaves open is compared with the vectors of fitting length under bounds that hold for any two close texts, so none
  is lost: max(n, m) * LEAST_COMMON <= min(n, m); they share LCS words (counted with repeats), so a query also shares as many with all texts of a slice
  together, which leaves out slices in other languages; and at most n + m - 2 * LCS words lie outside the common subsequence, each breaks at most
  one of its LCS - 1 steps, so they share at least 3 * LCS - 1 - n - m pairs of neighbouring words. What passes all of them is compared exactly.

Defined results: null contents are no documents; empty contents can only be exact repeats; contents with the same words are `near`
(or `exact` if byte for byte equal) whatever their case, white space and punctuation; ids repeated in a batch are one document;
empty batches and histories give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.runtime import Scratch, release

SHINGLE, WINDOW, BUCKETS = 5, 8, 8
LEAST_COMMON = 0.72
#: Batch tables of at most so many rows are broadcast; larger ones are joined by shuffle.
MOST_BROADCAST = 500_000
#: Words of a block of queries, of a slice of texts; words counted by a dense product; queries a product; groups of texts by their words.
BLOCK_WORDS, SLICE_WORDS, DENSE, GROUP, ALIKE = 1 << 22, 1 << 18, 1024, 512, 8
_FEATURES = "id long, sha string, form string, n int, words array<int>, coords array<long>"


def _mix(h: np.ndarray) -> np.ndarray:
    """Hash of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def coordinates(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed shingle hashes of many word sequences, given one after the other with their ends (from 0): (hashes, their ends)."""
    sizes = np.diff(ends)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    left = (ends[1:][text] - np.arange(len(flat))).astype(np.int32)  # words from here to the text's end
    w = np.concatenate([flat, np.zeros(SHINGLE, dtype=np.uint32)]).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(flat), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            h = (h + w[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        for at in ends[:-1][(sizes > 0) & (sizes < SHINGLE)].tolist():
            # A text shorter than a shingle is one shingle of all of its words.
            x = np.uint64(0)
            for j in range(at, at + int(left[at])):
                x = (x + w[j]) * np.uint64(0x9E3779B97F4A7C15)
            h[at] = x
    h = _mix(h)
    least, width = h, 1
    while width < WINDOW:
        least = np.minimum(least, np.concatenate([least[width:], least[-width:]]))
        width *= 2
    many = (sizes >= SHINGLE + WINDOW)[text]
    value = np.where(many, least, h)
    keep = left >= np.where(many, SHINGLE + WINDOW - 1, SHINGLE)
    keep[ends[:-1][(sizes > 0) & (sizes < SHINGLE)]] = True
    keep[1:] &= (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[keep].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(sizes)))])


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit numbers of the words of all texts, ends of the texts from 0); words are runs of letters and digits in lower case."""
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\p{L}\p{N}]+", " "), " ")
    lists = pc.split_pattern(spaced, " ")
    sizes = np.where(pc.equal(spaced, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy())
    code = pc.dictionary_encode(lists.flatten())
    numbers = np.array([zlib.crc32(w.encode()) for w in code.dictionary.to_pylist()], dtype=np.uint32)
    words = code.indices.to_numpy()
    empty = code.dictionary.index(pa.scalar("", pa.large_string())).as_py()
    words = words[words != empty] if empty >= 0 else words
    return numbers[words], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, ends = word_numbers(b.column("content"))
        forms = [hashlib.blake2b(flat[x:y].tobytes(), digest_size=12).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        cells, stops = coordinates(flat, ends)
        lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v)) for e, v in ((ends, flat.view(np.int32)), (stops, cells))]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sha"), pa.array(forms, pa.string()), pa.array(np.diff(ends).astype(np.int32)), *lists], names=["id", "sha", "form", "n", "words", "coords"])


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel after cutting equal ends."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return i + j
    masks: dict[int, int] = {}
    for p, w in enumerate(a):
        masks[w] = masks.get(w, 0) | (1 << p)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return i + j + len(a) - v.bit_count()


def close(a: list[int], b: list[int]) -> bool:
    longest = max(len(a), len(b))
    if not longest or min(len(a), len(b)) < LEAST_COMMON * longest:
        return False
    if sum((Counter(a) & Counter(b)).values()) < LEAST_COMMON * longest:
        return False
    return common_subsequence(a, b) >= LEAST_COMMON * longest


def _keys(words: list[np.ndarray], rows: np.ndarray, pairs: bool) -> np.ndarray:
    """Sorted numbers (40-bit hash << 24 | row) of the texts' words or neighbouring pairs, each repeat within a text with a hash of its own."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.concatenate([*words, np.zeros(0, dtype=np.int32)]).astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
    row = np.repeat(rows.astype(np.uint64), sizes)
    with np.errstate(over="ignore"):
        if pairs:
            inside = np.ones(len(flat), dtype=bool)
            inside[np.cumsum(sizes)[sizes > 0] - 1] = False
            inside = inside[:-1]
            h = _mix(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:])[inside]
            row = row[:-1][inside]
        else:
            h = _mix(flat + np.uint64(1 << 40))
        high = np.uint64(24)
        key = np.sort((h >> high) << high | row)
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        at = np.arange(len(key))
        again = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        late = again > 0
        if late.any():
            more = _mix((key[late] >> high) + again[late] * np.uint64(0xD6E8FEB86659FD93))
            key = np.sort(np.concatenate([key[~late], (more >> high) << high | key[late] & np.uint64((1 << 24) - 1)]))
    return key


def _held(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of every key, distinct hashes, their first key, how many keys they have) of what _keys gives."""
    h = key >> np.uint64(24)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), dtype=bool), h[1:] != h[:-1]]))
    return (key & np.uint64((1 << 24) - 1)).astype(np.int32), h[start], start, np.diff(np.append(start, len(h)))


class Block:
    """Queries (qid, words) that are compared with slices of texts (id, words)."""

    def __init__(self, qids: list[int], queries: list[np.ndarray]) -> None:
        order = np.argsort([len(q) for q in queries], kind="stable")
        queries = [queries[i] for i in order]
        self.qids = np.array(qids, dtype=np.int64)[order]
        self.n = np.array([len(q) for q in queries], dtype=np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.n)])
        self.flat = np.concatenate([*queries, np.zeros(0, dtype=np.int32)])
        self.open = np.ones(len(queries), dtype=bool)
        row, self.hashes, _, size = _held(_keys(queries, np.arange(len(queries)), False))
        #: Places of every query's words (repeats counted) among the hashes, from ends to ends as the words.
        self.own = np.repeat(np.arange(len(size), dtype=np.int32), size)[np.argsort(row, kind="stable")]

    def query(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]

    def against(self, ids: np.ndarray, words: list[np.ndarray]) -> list[int]:
        """qids of open queries that are close to a text with a smaller id; they are closed."""
        m = np.array([len(w) for w in words], dtype=np.int64)
        fit = self.open & (self.n >= LEAST_COMMON * m.min()) & (LEAST_COMMON * self.n <= m.max()) & (self.qids > ids.min())
        if not fit.any():
            return []
        texts, held, start, size = _held(_keys(words, np.arange(len(words)), False))
        if not len(held):
            return []
        at = np.minimum(np.searchsorted(held, self.hashes), len(held) - 1)
        at = np.where(held[at] == self.hashes, at, -1).astype(np.int32)
        # A query can share no more words with a text than with all texts of the slice.
        lo, hi = np.flatnonzero(fit)[[0, -1]] + [0, 1]
        known = np.concatenate([[0], np.cumsum((at >= 0)[self.own[self.ends[lo] : self.ends[hi]]])])[self.ends[lo : hi + 1] - self.ends[lo]]
        near = lo + np.flatnonzero(fit[lo:hi] & (np.diff(known) >= LEAST_COMMON * np.maximum(self.n[lo:hi], m.min()) - 0.01))
        # Words that many texts have are counted by a product of matrices, the others one by one.
        dense = np.argpartition(-size, min(DENSE, len(size)) - 1)[:DENSE]
        dense = dense[size[dense] * 16 > len(words)]
        rank = np.full(len(held) + 1, -1, dtype=np.int32)  # the last entry serves words that no text has
        rank[dense] = np.arange(len(dense))
        y = np.zeros((max(1, len(dense)), len(words)), dtype=np.float32)
        for r, d in enumerate(dense if len(near) else []):
            y[r, texts[start[d] : start[d] + size[d]]] = 1
        size0 = np.append(np.where(rank[:-1] >= 0, 0, size), 0).astype(np.int32)
        start0 = np.append(start, 0).astype(np.int32)
        length = m.astype(np.float32)
        found: list[int] = []
        for a in range(0, len(near), GROUP):
            group = near[a : a + GROUP]
            place = at[np.concatenate([self.own[self.ends[i] : self.ends[i + 1]] for i in group])]
            line = np.repeat(np.arange(len(group)), self.n[group])
            x = np.zeros((len(group), len(y)), dtype=np.float32)
            common = rank[place] >= 0
            x[line[common], rank[place[common]]] = 1
            hits = x @ y
            some = size0[place] > 0
            place, line = place[some], line[some]
            c = size0[place]
            total = int(c.sum(dtype=np.int64))
            if total:
                base = np.repeat(start0[place] - np.cumsum(c, dtype=np.int32) + c, c)
                base += np.arange(total, dtype=np.int32)
                cell = texts[base]
                cell += np.repeat((line * len(words)).astype(np.int32), c)
                hits += np.bincount(cell, minlength=hits.size).reshape(hits.shape)
            need = np.maximum(self.n[group].astype(np.float32)[:, None], length)
            need *= np.float32(LEAST_COMMON - 1e-6)  # less for the rounding of single precision
            need -= np.float32(0.01)
            g, t = np.nonzero(hits >= need)  # the lengths fit then, too
            earlier = ids[t] < self.qids[group[g]]
            g, t = g[earlier], t[earlier]
            for k in range(0, len(g), 1024):
                found += self._exact(group[g[k : k + 1024]], t[k : k + 1024], words)
        return found

    def _pairs(self, q: np.ndarray, t: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        """Whether query and text share as many pairs of neighbouring words as close ones do."""
        rows = np.arange(len(q))
        keys = [_keys([self.query(i) for i in q], rows, True), _keys([words[j] for j in t], rows, True)]
        both = np.intersect1d(*keys, assume_unique=True) & np.uint64((1 << 24) - 1)
        n, m = self.n[q], np.array([len(words[j]) for j in t])
        return np.bincount(both.astype(np.int64), minlength=len(q)) >= 3 * LEAST_COMMON * np.maximum(n, m) - 1 - n - m - 0.01

    def _exact(self, q: np.ndarray, t: np.ndarray, words: list[np.ndarray]) -> list[int]:
        found: list[int] = []
        still = self.open[q]
        q, t = q[still], t[still]
        keep = self._pairs(q, t, words)
        for i, j in zip(q[keep].tolist(), t[keep].tolist(), strict=True):
            if self.open[i] and close(self.query(i).tolist(), words[j].tolist()):
                self.open[i] = False
                found.append(int(self.qids[i]))
        return found


def _alike(words: list[np.ndarray]) -> list[np.ndarray]:
    """The texts in groups whose words are mostly those of one text, as those of one language are; this only saves time."""
    heads = [w[:64] for w in words]
    sizes = np.array([len(w) for w in heads], dtype=np.int64)
    ends = np.cumsum(sizes)
    low, left, out = np.concatenate(heads).view(np.uint32).astype(np.uint16), np.ones(len(words), dtype=bool), []
    while left.any() and len(out) < ALIKE:
        at = np.flatnonzero(left)
        pick = at[len(at) // 2]
        mask = np.zeros(1 << 16, dtype=bool)
        mask[words[pick].view(np.uint32).astype(np.uint16)] = True
        sums = np.cumsum(mask[low])[ends - 1]
        group = left & (np.diff(sums, prepend=0) >= 0.3 * sizes)
        group[pick] = True
        out.append(np.flatnonzero(group))
        left &= ~group
    return [*out, np.flatnonzero(left)] if left.any() else out


def _compare(block: Block):
    """Maps texts (id, words) to the queries (qid) that are close to one of them with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        words: list[np.ndarray] = []

        def compared() -> pa.RecordBatch:
            """Slices of texts of like words and length, so that a slice meets only the queries that may fit."""
            found, all_ids = [], np.concatenate(ids)
            sizes = np.array([len(w) for w in words])
            for group in _alike(words):
                order = group[np.argsort(sizes[group], kind="stable")]
                for part in np.array_split(order, min(len(order), 1 + int(sizes[group].sum()) // SLICE_WORDS)):
                    found += block.against(all_ids[part], [words[i] for i in part])
            ids.clear()
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["qid"])

        held = 0
        for b in batches:
            ids.append(b.column("id").to_numpy())
            lists = b.column("words")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            words += [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            held += int(ends[-1] - ends[0])
            if held > 16 * SLICE_WORDS:
                yield compared()
                held = 0
        if words:
            yield compared()

    return run


def _rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        good = [len(x) > 1 and close(x[0].tolist(), x[1].tolist()) for x in pdf["both"]]
        yield pdf.loc[good, ["qid"]]


class History:
    """The persisted index under path, by parts (one a batch): docs (id, sha, form, n, words, coords) and cells (cell, id), by bucket of the cell.

    Only the first text of every class of equal word sequences has cells. A part counts once its mark is written, so an update
    that fails leaves the index as it was; a single writer is assumed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in self._fs.listStatus(fs_path)] if self._fs.exists(fs_path) else []
        self.parts = sorted(int(n[4:]) for n in names if n.startswith("_ok-"))

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/part={k}" for k in self.parts])

    def docs(self) -> DataFrame:
        return self._read("docs", _FEATURES)

    def cells(self) -> DataFrame:
        return self._read("cells", "cell long, id long, bucket int")

    def add(self, docs: DataFrame) -> None:
        """Append documents (id, content) with distinct ids without checking them, e.g. a history accepted earlier."""
        f, k = self._vectors(docs)
        self._commit(k, self._firsts(f, self._classes(f)))

    def _vectors(self, docs: DataFrame) -> tuple[DataFrame, int]:
        """The batch's vectors, stored as the next part (which counts only after _commit), by length so that scans can leave out other lengths."""
        k = self.parts[-1] + 1 if self.parts else 0
        clean, at = docs.where("content is not null").select("id", F.sha2("content", 256).alias("sha"), "content"), f"{self.path}/docs/part={k}"
        clean.mapInArrow(_features, _FEATURES).sortWithinPartitions("n").write.mode("overwrite").parquet(at)
        f = self.spark.read.schema(_FEATURES).parquet(at)
        sums = [F.count("*"), F.coalesce(F.sum(F.size("coords")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.countDistinct("id")]
        self._rows, self._probes, self._words, ids = f.agg(*sums).first()
        if ids < self._rows:  # repeated ids: of each id the content with the smallest hash
            first = f.groupBy("id").agg(F.min(F.struct(*[c for c in f.columns if c != "id"])).alias("x")).select("id", "x.*")
            f = Scratch(self.spark, "check").cut(first)
            f.sortWithinPartitions("n").write.mode("overwrite").parquet(at)
            f = self.spark.read.schema(_FEATURES).parquet(at)
            self._rows = ids
        return f, k

    def _small(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Broadcast a table of the batch if its rows (at most the batch's) are few, so that the history isn't shuffled."""
        return F.broadcast(df) if (self._rows if rows is None else rows) <= MOST_BROADCAST else df

    def _earliest(self, f: DataFrame, key: str) -> DataFrame:
        """(key, first): the smallest id of index and batch for every key of the batch."""
        own = f.groupBy(key).agg(F.min("id").alias("own"))
        old = self.docs().select(key, "id").join(self._small(own.select(key)), key, "left_semi").groupBy(key).agg(F.min("id").alias("old"))
        return own.join(self._small(old), key, "left").select(key, F.least("own", "old").alias("first"))

    def _classes(self, f: DataFrame) -> DataFrame:
        return self._earliest(f.where("form != ''").select("form", "id"), "form").withColumnRenamed("first", "cid")

    def _firsts(self, f: DataFrame, classes: DataFrame) -> DataFrame:
        """Texts of the batch that are the first of their class."""
        return f.where("form != ''").join(self._small(classes), "form").where(F.col("id") == F.col("cid")).drop("cid")

    def _commit(self, k: int, firsts: DataFrame) -> None:
        each = firsts.select(F.explode("coords").alias("cell"), "id").withColumn("bucket", F.pmod("cell", F.lit(BUCKETS)).cast("int"))
        cells = each.repartition(BUCKETS, "bucket").groupBy("bucket", "cell").agg(F.min("id").alias("id"))
        cells.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/cells/part={k}")
        self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_ok-{k}")).close()
        self.parts.append(k)

    def check(self, docs: DataFrame) -> DataFrame:
        """(id, match) of the documents (id, content) that repeat a smaller id of the index or the batch; the batch is appended."""
        out = self._checked(docs)
        release(self.spark)  # a batch broadcasts some dozen tables
        return out

    def _checked(self, docs: DataFrame) -> DataFrame:
        s = Scratch(self.spark, "check")
        f, k = self._vectors(docs)
        classes = s.cut(self._classes(f), "classes")
        firsts = self._firsts(f, classes)
        thin = f.select("id", "sha", "form").join(self._small(classes), "form", "left").withColumn("cid", F.coalesce("cid", "id"))
        rows = thin.join(self._small(self._earliest(f.select("sha", "id"), "sha")), "sha").join(self._small(self._matched(firsts, s)), F.col("cid") == F.col("qid"), "left")
        kind = F.when(F.col("first") < F.col("id"), "exact").when((F.col("cid") < F.col("id")) | F.col("qid").isNotNull(), "near")
        out = s.cut(rows.select("id", kind.alias("match")).where("match is not null"), "out")
        self._commit(k, firsts)
        return out

    def _matched(self, firsts: DataFrame, s: Scratch) -> DataFrame:
        """qid of the class firsts of the batch that are close to a text with a smaller id."""
        probes = firsts.select(F.col("id").alias("qid"), F.explode("coords").alias("cell"))
        cells = self.cells()
        if self._probes < 8 * BUCKETS:
            # A few probes read their own buckets only; more would touch nearly all.
            cells = cells.where(F.col("bucket").isin([r[0] for r in probes.select(F.pmod("cell", F.lit(BUCKETS)).cast("int")).distinct().collect()]))
        old = cells.select("cell", "id").join(self._small(probes.select("cell"), self._probes), "cell", "left_semi")
        named = old.unionByName(probes.select("cell", F.col("qid").alias("id"))).groupBy("cell").agg(F.min("id").alias("id"))
        hits = probes.join(named, "cell").where(F.col("id") < F.col("qid")).groupBy("qid", "id").agg(F.count("*").alias("hits"))
        best = hits.groupBy("qid").agg(F.max(F.struct("hits", (-F.col("id")).alias("id"))).alias("b")).where("b.hits > 1")
        best = s.cut(best.select("qid", F.explode(F.array("qid", -F.col("b.id"))).alias("id")), "best")
        words = self.docs().select("id", "n", "words").unionByName(firsts.select("id", "n", "words"))
        both = words.select("id", "words").join(self._small(best, 2 * self._rows), "id").groupBy("qid").agg(F.collect_set("words").alias("both"))  # two texts
        probed = s.cut(both.mapInPandas(_rerank, "qid long"), "probed")
        out = probed.unionByName(self._rest(firsts.select("id", "n", "words").join(self._small(probed), F.col("id") == F.col("qid"), "left_anti"), words, s))
        s.drop(best)
        return out

    def _blocks(self, queries: DataFrame, s: Scratch) -> Iterator[tuple[int, int, Block]]:
        """(least and greatest length, block); a block's queries have about BLOCK_WORDS words, which stay columns on their way."""

        def block(df: DataFrame) -> Iterator[tuple[int, int, Block]]:
            rows = df.select("id", "words").toArrow().combine_chunks()
            if rows.num_rows:
                lists = rows.column("words").combine_chunks()
                ends, flat = lists.offsets.to_numpy().tolist(), lists.values.to_numpy()
                b = Block(rows.column("id").to_numpy(), [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])
                yield int(b.n[0]), int(b.n[-1]), b

        if self._words <= BLOCK_WORDS:
            yield from block(queries)
            return
        queries = s.cut(queries, "left")
        sizes = queries.groupBy("n").agg(F.sum("n").alias("words")).orderBy("n").collect()  # one row per length
        bounds, held = [], 0
        for r in sizes:
            if not bounds or held > BLOCK_WORDS:
                bounds.append([r["n"], r["n"]])
                held = 0
            bounds[-1][1] = r["n"]
            held += r["words"]
        for lo, hi in bounds:
            split = max(1, -(-sum(r["words"] for r in sizes if lo <= r["n"] <= hi) // (2 * BLOCK_WORDS)))
            for part in range(split):  # more than one only where a single length holds more than two blocks
                yield from block(queries.where(F.col("n").between(lo, hi) & (F.pmod(F.xxhash64("id"), F.lit(split)) == part)))

    def _rest(self, queries: DataFrame, words: DataFrame, s: Scratch) -> DataFrame:
        """qid of the queries (id, n, words) that are close to one of the words (id, n, words) with a smaller id.

        Queries go by length into blocks of about BLOCK_WORDS words; a block is compared with all texts of fitting length, which are not shuffled.
        """
        at, blocks = s.path("rest"), 0
        for lo, hi, block in self._blocks(queries, s):
            fit = words.where((F.col("n") >= LEAST_COMMON * lo) & (LEAST_COMMON * F.col("n") <= hi) & (F.col("n") > 0)).select("id", "words")
            fit.mapInArrow(_compare(block), "qid long").write.mode("append").parquet(at)
            blocks += 1
        empty = self.spark.createDataFrame([], T.StructType([T.StructField("qid", T.LongType())]))
        return self.spark.read.schema("qid long").parquet(at).distinct() if blocks else empty


def accepted(kb: DataFrame) -> DataFrame:
    """(id, content) of the knowledge base: per path and content hash its chunks in order, joined by a blank line; ids are negative.

    Rows without a hash belong to the content of their path where that has one hash only, else they are a content of their own.
    """
    path = F.regexp_replace(F.trim(F.regexp_replace("file_path", r"\\", "/")), r"^(\./)+", "")
    h = F.lower(F.regexp_replace(F.trim("content_hash"), r"(?i)^sha-?256:", ""))
    rows = kb.where("original_chunk is not null and file_path is not null").select(path.alias("path"), h.alias("h"), "chunk_index", "original_chunk")
    one = rows.groupBy("path").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    rows = rows.join(one, "path").withColumn("key", F.coalesce("h", F.when(F.col("low") == F.col("high"), F.col("high")), F.lit("")))
    each = rows.groupBy("path", "key").agg(F.collect_set(F.struct("chunk_index", "original_chunk")).alias("c"))  # the chunks of one content
    text = F.array_join(F.transform(F.array_sort("c"), lambda x: x["original_chunk"]), "\n\n")
    return each.select((-1 - F.pmod(F.xxhash64("path", "key"), F.lit(1 << 62))).alias("id"), text.alias("content"))


BATCH = 1 << 40


def numbered(incoming: DataFrame) -> DataFrame:
    """(id, content) of incoming documents; ids rise with (batch_id, in_id)."""
    return incoming.where("in_id is not null").select((F.coalesce(F.col("batch_id").cast("long"), F.lit(1 << 20)) * BATCH + F.col("in_id")).alias("id"), "content")
