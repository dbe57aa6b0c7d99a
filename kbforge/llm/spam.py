"""Keyword-stuffed and link-list pages by robust Mahalanobis distance per language.

Each text gets six features: link density, word entropy, repetition, function words, prose (words in segments that read like
sentences) and tag density. Location and scale per language are medians and median absolute deviations over all documents; the scatter of the
central documents (all robust z-scores within a bound) gives the covariance. A page is flagged if its distance is an
outlier and the deviation points in a spam direction (towards links, repetition and tags; away from entropy, function words and prose).

Defined results: null, empty and very short texts (fewer than LEAST_ITEMS words and links) are never flagged; unknown languages are guessed by function
words, else pooled; the statistics of a language weigh n / (n + PRIOR) against the pooled ones; source and configuration files take part in no statistics and
are never flagged; ties and repeated rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.runtime import Scratch

# Common function words per language.
FUNCTION_WORDS = {
    "en": "the a an of to in on at by for from with without and or but if because while when after before as is are was were be been it its this that these those our we he she they his her their not no nobody who which than then into over under until unless once so far only there has have had do does did can will would should may must",
    "de": "der die das den dem des ein eine einen einem einer und oder aber wenn weil als auch in im an am auf aus bei mit nach von vor zu zum zur für über unter ist sind war waren wird werden nicht kein keine sie er es wir ihr sich dass noch schon nur wie so bis durch gegen ohne um",
    "fr": "le la les un une des du de d l et ou mais si car que qui dans en au aux par pour sur sous avec sans ce cette ces son sa ses il elle on nous vous ils elles est sont était ne pas plus à après avant pendant depuis vers chez selon malgré se",
    "es": "el la los las un una unos unas de del y o pero si porque que quien en al por para con sin sobre bajo tras entre es son era fue no se su sus lo le les este esta estos ese esa como más muy ya hasta desde durante según pese cuando",
}
FEATURES = ["links", "entropy", "repetition", "function_words", "prose", "tags"]
# Direction of spam for each feature.
DIRECTION = [1.0, -1.0, 1.0, -1.0, -1.0, 1.0]
# Least scale of each feature, so that a feature that most texts lack doesn't make every text that has a little of it an outlier.
LEAST_SCALE = {"links": 0.25, "entropy": 0.05, "repetition": 0.08, "function_words": 0.04, "prose": 0.12, "tags": 0.25}
CODE_SUFFIX = r"\.(py|ts|js|sh|json|ya?ml)$"
MIN_WORDS = 20
#: Documents at which the statistics of a language weigh as much as the pooled ones.
PRIOR = 200
#: A flagged page has so many words and links, lies so far out, and so far in the spam direction.
LEAST_ITEMS, DISTANCE, TOWARDS_SPAM, ALIGNED = 12, 6.0, 5.3, 0.5
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_SETS.values())
_WORD = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"https?://[^\s<>\")\]]+|\bwww\.[^\s<>\")\]]+", re.I)
_MARKUP = re.compile(r"<[^<>]+>|&[a-z#0-9]{2,8};")
_CODE = re.compile(r"^(```|~~~).*?^\1|\{code(?::\w+)?\}.*?\{code\}|<pre\b.*?</pre>|\\begin\{(?:verbatim|lstlisting)\}.*?\\end\{(?:verbatim|lstlisting)\}", re.S | re.M)
_SEGMENT = re.compile(r"[\n,;|•·]+|\s[-–—/]\s|(?<=[.!?:])\s+")
_TAG = re.compile(r"\b[A-Z]{1,3}-?\d{2,}\b|\b\d+[.,]\d{2}\b|#\w+")


def features(text: str | None, lang: str | None) -> tuple[str, int, list[float]]:
    """(language, words and links, features) of a text; code blocks are left aside."""
    code = {"fra": "fr", "deu": "de", "ger": "de", "eng": "en", "spa": "es"}
    lang = (lang or "").strip().lower()
    lang = code.get(lang, lang[:2])
    body = _CODE.sub(" ", text or "")
    n_links = len(_LINK.findall(body))
    plain = _MARKUP.sub(" ", _LINK.sub(" ", body))
    words = _WORD.findall(plain.lower())
    n = len(words)
    items = n + n_links
    counts = Counter(words)
    if lang not in _SETS:
        best = max(_SETS, key=lambda k: sum(counts[w] for w in _SETS[k]))
        lang = best if sum(counts[w] for w in _SETS[best]) >= 3 else ""
    if items < 2:
        return lang, items, [0.0] * len(FEATURES)
    n = max(n, 2)
    fw = _SETS.get(lang, _ANY)
    h = -sum(c * math.log(c / n) for c in counts.values()) / n
    pairs = Counter(zip(words, words[1:], strict=False))
    repeated = sum(c for c in pairs.values() if c > 2) / (n - 1)
    prose = 0
    for seg in _SEGMENT.split(plain):
        ws = seg.lower().split()
        if len(ws) >= 5 and sum(w in fw for w in ws) * 7 >= len(ws) and len(set(ws)) * 10 >= len(ws) * 6:
            prose += len(ws)
    return lang, items, [
        math.log1p(20 * n_links / n), h / math.log(max(n, 8)), repeated, sum(counts[w] for w in fw) / n,
        min(1.0, prose / max(1, len(plain.split()))), math.log1p(20 * len(_TAG.findall(plain)) / n),
    ]


def _featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [features(t, lang) for t, lang in zip(pdf["text"], pdf["lang"], strict=True)]
        out = pd.DataFrame({"doc_id": pdf["doc_id"], "lg": [r[0] for r in rows], "n_words": [r[1] for r in rows]})
        for i, f in enumerate(FEATURES):
            out[f] = [r[2][i] for r in rows]
        yield out


def featurized(docs: DataFrame) -> DataFrame:
    """(doc_id, lg, n_words, features...) from documents (doc_id, text, lang, file_path) that are no source or configuration files."""
    own = docs.where(~F.coalesce(F.lower("file_path").rlike(CODE_SUFFIX), F.lit(False)) & F.col("text").isNotNull())
    return own.select("doc_id", "text", "lang").mapInPandas(_featurize, "doc_id long, lg string, n_words int, " + ", ".join(f"{f} double" for f in FEATURES))


def statistics(f: DataFrame, prior: int = PRIOR) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language ('*': pooled): medians, scales, inverse covariance of z-scores of the central documents. At most six rows are collected."""
    own = f.where(F.col("n_words") >= MIN_WORDS)
    both = own.unionByName(own.withColumn("lg", F.lit("*")))
    med = {r["lg"]: r for r in both.groupBy("lg").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in FEATURES]).collect()}

    def at(stats: dict, c: str, default: float) -> F.Column:
        x = F.lit(float(default))
        for lg, r in stats.items():
            x = F.when(F.col("lg") == lg, F.lit(float(r[c]))).otherwise(x)
        return x

    dev = both.select("lg", *[F.abs(F.col(c) - at(med, c, 0)).alias(c) for c in FEATURES])
    mad = {r["lg"]: r.asDict() for r in dev.groupBy("lg").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in FEATURES]).collect()}
    scale = {lg: {c: max(1.4826 * r[c], LEAST_SCALE[c]) for c in FEATURES} for lg, r in mad.items()}
    z = both.select("lg", *[((F.col(c) - at(med, c, 0)) / at(scale, c, 1)).alias(c) for c in FEATURES])
    central = z.where(F.greatest(*[F.abs(c) for c in FEATURES]) <= 3.5)
    prods = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j]
    cov = {r["lg"]: r for r in central.groupBy("lg").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"m_{c}") for c in FEATURES], *prods).collect()}
    d = len(FEATURES)

    def scatter(r) -> np.ndarray:
        m = np.array([r[f"m_{c}"] for c in FEATURES]) / r["n"]
        c = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                c[i, j] = c[j, i] = r[f"s{i}_{j}"] / r["n"] - m[i] * m[j]
        return c

    own = {lg: (np.array([med[lg][x] for x in FEATURES]), np.array([scale[lg][x] for x in FEATURES]), scatter(r)) for lg, r in cov.items()}
    out = {}
    for lg, stats in own.items():
        w = 1.0 if lg == "*" else med[lg]["n"] / (med[lg]["n"] + prior)
        m, sc, c = (w * a + (1 - w) * b for a, b in zip(stats, own["*"], strict=True))
        out[lg] = m, sc, np.linalg.inv(0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.15 * np.eye(d))
    return out


def scored(f: DataFrame, stats: dict) -> DataFrame:
    """Add distance (robust Mahalanobis) and aligned (cosine of the deviation in robust z-scores with the spam direction)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[FEATURES].to_numpy(float)
            dist, cos = np.zeros(len(pdf)), np.zeros(len(pdf))
            for lg in pdf["lg"].unique():
                rows = (pdf["lg"] == lg).to_numpy()
                med, scale, inv = stats.get(lg) or stats["*"]
                z = ((x[rows] - med) / scale).clip(-20, 20)
                dist[rows] = np.sqrt(np.einsum("ij,jk,ik->i", z, inv, z))
                size = np.sqrt((z * z).sum(1)) * math.sqrt(len(DIRECTION))
                cos[rows] = (z * DIRECTION).sum(1) / np.maximum(size, 1e-9)
            yield pdf.assign(distance=dist, aligned=cos)

    if not stats:
        return f.select("*", F.lit(0.0).alias("distance"), F.lit(0.0).alias("aligned")).limit(0)
    return f.mapInPandas(score, "doc_id long, lg string, n_words int, " + ", ".join(f"{c} double" for c in FEATURES) + ", distance double, aligned double")


def spam_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, lg, features..., distance, aligned) of the flagged documents."""
    f = Scratch(docs.sparkSession, "spam").cut(featurized(docs))
    s = scored(f, statistics(f))
    # An outlier towards spam may lie there by few features; pages that mostly read as prose are none.
    towards = F.col("distance") * F.col("aligned")
    return s.where((F.col("n_words") >= LEAST_ITEMS) & (F.col("distance") > DISTANCE) & (towards > TOWARDS_SPAM) & (F.col("aligned") > ALIGNED) & (F.col("prose") < 0.5))
