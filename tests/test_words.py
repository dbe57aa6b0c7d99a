"""Word search and what is built on it: equal to a count pair by pair, without a row for each pair of query and text."""

import math
import random
import re

import pytest

import __spark_entry__
from kbforge.operators import search


def by_pairs(docs, asked, k):
    """Results of asked {query: text} by scoring every text of docs [(id, text)]."""
    bags = [(i, re.findall(r"\w+", t.lower())) for i, t in docs if t is not None]
    mean = sum(len(b) for _, b in bags) / len(bags)
    lists = {}  # an id and a length are one entry, as in the SQL
    for i, b in bags:
        for w in b:
            lists.setdefault(w, {}).setdefault((i, len(b)), []).append(1)
    out = []
    for n, words in asked.items():
        score = {}
        for w in words:
            df = len(lists.get(w, ()))
            for (i, dl), tf in lists.get(w, {}).items():
                score[i] = score.get(i, 0) + math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * len(tf) * 2.2 / (len(tf) + 1.2 * (0.25 + 0.75 * dl / mean))
        best = sorted((-round(s, 6), i) for i, s in score.items())[:k]
        out += [(n, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_best_texts_equal_a_count_by_pairs(spark, tmp_path, kind):
    rnd = random.Random(3)
    words = ["the", "after", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(w for w in words if rnd.random() < (0.7 if len(w) > 3 or w == "the" else 0.1)) or "alone") for i in range(400)]
    docs += [(i + 500, t) for i, t in docs[:90]] + [(7, docs[7][1]), (7, "w1 w1 after"), (900, None), (901, "")]  # ties, and texts of one id
    docs = [(i if kind == "long" else f"d{i}", t) for i, t in docs]
    asked = [(n, " ".join(rnd.sample(words, 5)) + f" the unknown{n}") for n in range(60)]
    asked += [(100, asked[0][1]), (101, "w3 W3 w4"), (101, "w4 w5"), (102, "the after"), (103, None), (104, "...")]  # equal words, two rows of one query
    merged = {}
    for n, t in asked:
        merged.setdefault(n, set()).update(re.findall(r"\w+", (t or "").lower()))
    ix = search.Bm25Index.build(spark.createDataFrame(docs, f"id {kind}, text string"), str(tmp_path / "words"))
    q = spark.createDataFrame(asked, "query_id long, text string")
    want = by_pairs(docs, merged, 20)
    for terms in (500_000, 40):  # in one block of queries, and in several
        with pytest.MonkeyPatch.context() as m:
            m.setattr(search, "BLOCK_TERMS", terms, raising=False)
            got = sorted(tuple(r) for r in ix.topk(q).select("query_id", "id", "score", "search_rank").collect())
        assert [(n, i, r) for n, i, _, r in got] == [(n, i, r) for n, i, _, r in want]
        assert all(abs(x[2] - y[2]) < 1.5e-6 for x, y in zip(got, want, strict=True))
    lists = {}
    for i, t in docs:
        for w in (t or "").split():
            lists[w, i, len(t.split())] = lists.get((w, i, len(t.split())), 0) + 1
    assert {(r["term"], r["id"], r["dl"]): r["tf"] for r in ix.postings.collect()} == lists


TEXTS, ASKED = 1500, 300


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd, d = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    some = [f"w{i}" for i in range(40)]
    text = [(i, " ".join(["the", "after", *rnd.sample(some, 12)]), f"docs/{i}.md", "atlas-core") for i in range(1, TEXTS + 1)]
    spark.createDataFrame(text, "doc_id long, text string, file_path string, project string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(20 * i, f"the {rnd.choice(some)} failed after {i} ms") for i in range(1, ASKED + 1)], "row_id long, error_message string").write.parquet(f"{d}/errors.parquet")
    spark.createDataFrame([(i, [rnd.random() for _ in range(4)], 1) for i in range(200)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def shuffled(spark, job):
    """Rows that the stages of a job shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (x.apply(i) for x in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(x.size()))}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = stages()
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["bm25_topk", "rerank_lexical", "search_full", "fusion_bypass", "weighted_fusion", "hybrid_pipeline", "citation_docs", "fusion_stats", "rrf_fusion"])
def test_no_row_for_each_pair(spark, tables, name):
    __spark_entry__.queries()["bm25_index"](spark, tables).count()  # the stored index is built
    rows = shuffled(spark, lambda: __spark_entry__.queries()[name](spark, tables).collect())
    assert rows < TEXTS * ASKED / 4
