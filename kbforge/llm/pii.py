"""Personal information inside free text: regions of interest, BiLSTM-CRF decoding, global reconciliation, placeholders.

Regions: every place that can hold personal information (an @ or its spelled forms, a long run of digits, an id-like token, a
postcode, a capitalised word that the fitted vocabulary doesn't know as an ordinary word) with its surroundings. Regions are cut into
overlapping windows; the tagger scores each window, scores of overlapping windows are blended by the distance from the
window's edges, and one Viterbi pass over the whole region gives spans that agree across windows. Exact checks follow: allow-listed terms,
repository remotes, package versions, logins in URLs, build and serial numbers are no personal information.

Defined results: null and empty texts hold none and are kept; a kind is given once per text however often it occurs; repeated rows each give
theirs (p1_found gives distinct rows); very long texts are read whole; null terms in the allow list are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kbforge.llm.tagger import KINDS, PAD_FLAGS, TAGS, Tagger, encode

MODEL = os.path.join(os.path.dirname(__file__), "models", "pii_tagger.npz")
WINDOW, OVERLAP = 96, 32
BATCH_WINDOWS = 512
_CAP = re.compile(r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+")
# (pattern, characters to the left and right that belong to the region)
_MAIL = re.compile(r"[@＠]|[\[(]at[\])]")
_DIGITS = re.compile("\\d(?:[ \u00a0\u202f().\\-\u2011/]{0,3}\\d){6,}")
_ID_LIKE = re.compile(r"[A-Z]\d(?:[ -]?\d){5}|[A-Z] ?\d\d ?\d\d ?\d\d ?[A-D]|\d{8}-?[A-Z]|L0[A-Z0-9]{7}")
_POSTCODE = re.compile(r"\d{5}\s+[A-ZÀ-Þ]|[A-Z]{2} \d{5}|[A-Z]\d[\dA-Z]? \d[A-Z]{2}")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_NOT_EMAIL = re.compile(r"(?i)^git@|@\d|@latest\b")
_URL_LOGIN = re.compile(r"[a-z][a-z0-9+.-]*://[^\s/@'\"]*:[^\s/@'\"]*@[\w.-]+", re.I)
_EMAIL_LIKE = re.compile(r"[\w.+-]+ ?(?:@|＠|[\[(]at[\])]) ?[\w-]+(?:(?:\.|[\[(]dot[\])])[\w-]+)+")
_SSN = re.compile("\\d{3}([- \u2011\u00a0])\\d{2}\\1\\d{4}|\\d{8}-?[A-Z]|[A-Z]\\d{8}|[12] \\d{2} \\d{2} \\d{2} \\d{3} \\d{3} \\d{2}")
_DIALLED = re.compile("\\+?(?:34|33|44|49)[- \u00a0]?\\d[\\d\u00a0 -]{7,14}|0\\d[\\d\u00a0 /-]{8,13}|\\(?\\d{3}\\)?[-. \u2011\u00a0]\\d{3}[-. \u2011\u00a0]\\d{4}")
_NUMBERED = re.compile(r"(?i)(?:serial|build|request|ticket|version|revision|rev|order|invoice)(?: (?:no\.?|nr\.?|number))? [\w.-]*$|INC-[\d-]*$")


def word_hash(w: str) -> int:
    return zlib.crc32(w.encode())


class Reader:
    """The tagger with its vocabulary of ordinary words."""

    def __init__(self, path: str = MODEL) -> None:
        self.tagger = Tagger.load(path)
        with np.load(path) as z:
            self.common = frozenset(int(h) for h in z["common_words"])
        self._known: dict[str, bool] = {}

    def ordinary(self, w: str) -> bool:
        k = self._known.get(w)
        if k is None:
            if len(self._known) > 300_000:
                self._known.clear()
            k = self._known[w] = word_hash(w.lower()) in self.common
        return k


@lru_cache(maxsize=1)
def reader(path: str = MODEL) -> Reader:
    return Reader(path)


def _spaced(piece: str) -> str:
    """The piece as the tagger reads it: an equals sign before a number written as an id or phone number is a space."""
    at = piece.find("=")
    while at >= 0:
        if _SSN.match(piece, at + 1) or _DIALLED.match(piece, at + 1):
            piece = piece[:at] + " " + piece[at + 1 :]
        at = piece.find("=", at + 1)
    return piece


def regions(text: str, ordinary) -> list[tuple[int, int]]:
    """Merged (start, end) of the places to be read, in order."""
    spans = []
    if "@" in text or "＠" in text or "(at)" in text or "[at]" in text:
        spans += [(m.start() - 40, m.end() + 40) for m in _MAIL.finditer(text)]
    for r, left, right in ((_DIGITS, 28, 16), (_ID_LIKE, 28, 16), (_POSTCODE, 64, 24)):
        for m in r.finditer(text):
            before = text[m.start() - 1] if m.start() else " "
            written = before == "=" and (_SSN.match(text, m.start()) or _DIALLED.match(text, m.start()))
            if written or not (before.isalnum() and r is not _ID_LIKE or before in "/=._-"):
                spans.append((m.start() - left, m.end() + right))
    unknown = {w for w in set(_CAP.findall(text)) if not ordinary(w)}
    if unknown:
        for m in _CAP.finditer(text):
            if m[0] in unknown:
                a, b = m.span()
                before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
                if not (before.isalnum() or before in "@＠/\\&$_+=-.#" and before != "-" or after.isdigit() or after in "@＠/\\_=(+"):
                    spans.append((a - 28, b + 24))
    if not spans:
        return []
    spans.sort()
    out: list[list[int]] = []
    n = len(text)
    for a, b in spans:
        a, b = max(0, a), min(n, b)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_flags(text: str, ordinary) -> np.ndarray:
    """Per character: within an unknown capitalised word, within an ordinary word, start of a line."""
    f = np.zeros((len(text), PAD_FLAGS), np.float32)
    for m in _LETTERS.finditer(text):
        w = m[0]
        if len(w) > 1:
            if ordinary(w):
                f[m.start() : m.end(), 1] = 1
            elif w[0].isupper():
                f[m.start() : m.end(), 0] = 1
    if len(text):
        f[0, 2] = 1
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        f[at + 1, 2] = 1
        at = text.find("\n", at + 1)
    return f


def _windows(n: int) -> list[tuple[int, int]]:
    if n <= WINDOW:
        return [(0, n)]
    step = WINDOW - OVERLAP
    starts = list(range(0, n - WINDOW, step)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _batches(order: list[int], lengths: list[int]) -> Iterator[list[int]]:
    """Runs of an order by rising length whose padded size stays below BATCH_WINDOWS windows; a longer piece is alone."""
    part: list[int] = []
    for k in order:
        if part and (len(part) + 1) * lengths[k] > BATCH_WINDOWS * WINDOW:
            yield part
            part = []
        part.append(k)
    if part:
        yield part


def tag(pieces: list[str], r: Reader) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each piece of text."""
    seqs = [(encode(p), char_flags(p, r.ordinary)) for p in pieces]
    wins = [(k, a, b) for k, (ids, _) in enumerate(seqs) for a, b in _windows(len(ids))]
    total = [np.zeros((len(ids), len(TAGS)), np.float32) for ids, _ in seqs]
    weight = [np.zeros(len(ids), np.float32) for ids, _ in seqs]
    order = sorted(range(len(wins)), key=lambda j: wins[j][2] - wins[j][1])
    for lo in range(0, len(order), BATCH_WINDOWS):
        part = [wins[j] for j in order[lo : lo + BATCH_WINDOWS]]
        size = max(b - a for _, a, b in part)
        ids, flags, mask = np.zeros((len(part), size), np.int16), np.zeros((len(part), size, PAD_FLAGS), np.float32), np.zeros((len(part), size), bool)
        for i, (k, a, b) in enumerate(part):
            ids[i, : b - a], flags[i, : b - a], mask[i, : b - a] = seqs[k][0][a:b], seqs[k][1][a:b], True
        e = r.tagger.emissions(ids, flags, mask)
        for i, (k, a, b) in enumerate(part):
            # A character weighs by its distance from the window's edges; edges of the piece itself don't count.
            left = np.arange(1, b - a + 1) if a else np.full(b - a, WINDOW)
            right = np.arange(b - a, 0, -1) if b < len(seqs[k][0]) else np.full(b - a, WINDOW)
            w = np.minimum(np.minimum(left, right), OVERLAP).astype(np.float32)
            total[k][a:b] += e[: b - a, i] * w[:, None]
            weight[k][a:b] += w
    out: list[list[tuple[int, int, str]]] = [[] for _ in pieces]
    order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
    for part in _batches(order, [len(p) for p in pieces]):
        size = len(pieces[part[-1]])
        e = np.zeros((size, len(part), len(TAGS)), np.float32)
        lengths = np.array([len(pieces[k]) for k in part])
        for i, k in enumerate(part):
            e[: lengths[i], i] = total[k] / np.maximum(weight[k], 1e-6)[:, None]
        paths = r.tagger.viterbi(e, lengths)
        hot = (paths > 0).any(1)
        for i in np.flatnonzero(hot):
            out[part[i]] = spans_of(paths[i, : lengths[i]])
    return out


def spans_of(path: np.ndarray) -> list[tuple[int, int, str]]:
    """B/I tags to spans; an I without its B starts one."""
    out, start, kind = [], -1, -1
    for t, x in enumerate([*path.tolist(), 0]):
        k = (x - 1) // 2 if x else -1
        if start >= 0 and (k != kind or x % 2 == 1):
            out.append((start, t, KINDS[kind]))
            start = -1
        if x and start < 0:
            start, kind = t, k
    return out


def _token(text: str, a: int, b: int) -> tuple[int, int]:
    """The span widened to whole runs of letters and digits."""
    while a > 0 and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    return a, b


def checked(text: str, spans: list[tuple[int, int, str]], allowed: re.Pattern | None, ordinary) -> list[tuple[int, int, str]]:
    """Exact checks after decoding; spans are trimmed to the tokens they touch."""
    if not spans:
        return []
    lo, hi = spans[0][0], max(b for _, b, _ in spans)
    lo, hi = max(0, lo - 80), min(len(text), hi + 80)
    near = text[lo:hi]
    logins = [(m.start() + lo, m.end() + lo) for m in _URL_LOGIN.finditer(near)] if "://" in near else []
    mails = [(m.start() + lo, m.end() + lo) for m in _EMAIL_LIKE.finditer(near)]
    terms = [(m.start() + lo, m.end() + lo) for m in allowed.finditer(near)] if allowed else []
    out = []
    for a, b, kind in spans:
        while a < b and text[a] in " ,.;:()<>\n":
            a += 1
        while b > a and text[b - 1] in " ,;:()<>\n":
            b -= 1
        piece = text[a:b]
        hits = lambda xs: any(a < y and x < b for x, y in xs)  # noqa: B023, E731
        if kind == "email":
            own = next(((x, y) for x, y in mails if a < y and x < b), None)
            if not own or hits(logins) or _NOT_EMAIL.search(text[own[0] : own[1]]):
                continue
            a, b = own
        elif kind in ("phone", "id_number"):
            if a and (text[a - 1].isalnum() or text[a - 1] in "-/=_") or b < len(text) and text[b].isalnum() and text[b - 1].isdigit() and not piece[-1].isspace():
                a0, b0 = _token(text, a, b)
                if len(text[a0:b0].split()) == 1 and not _SSN.fullmatch(text[a0:b0]) and not _DIALLED.fullmatch(text[a0:b0]) and b0 - a0 > 14:
                    continue  # part of a longer key, digest or id
                a, b = a0, b0
                piece = text[a:b]
            # The written form decides between the two kinds where it can.
            kind = "id_number" if _SSN.fullmatch(piece) else "phone" if _DIALLED.fullmatch(piece) else kind
            digits = sum(c.isdigit() for c in piece)
            if digits < (7 if kind == "phone" else 4) or _NUMBERED.search(text[max(0, a - 30) : a]) or re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", piece):
                continue
            if kind == "phone" and not 7 <= digits <= 17:
                continue
        elif kind == "address":
            if not re.search(r"\d", piece) or len(piece) < 10 or not re.search(r"\s", piece):
                continue
        elif kind == "person":
            if hits(terms) or hits(mails) or hits(logins):
                continue
            a, b = _token(text, a, b)
            piece = text[a:b]
            words = _LETTERS.findall(piece)
            known = [w for w in words if len(w) > 1 and w[0].isupper() and not ordinary(w)]
            if not known or re.search(r"[\d_/+=]", piece) or all(w.isupper() for w in known) and len(words) == 1:
                continue
            if a and text[a - 1] in "/+=_#" or b < len(text) and text[b] in "/+=_(":
                continue
        out.append((a, b, kind))
    return out


def read(texts: list[str], allowed: re.Pattern | None = None) -> list[list[tuple[int, int, str]]]:
    """Checked spans of many texts."""
    r = reader()
    places = [(i, a, b) for i, t in enumerate(texts) if t for a, b in regions(t, r.ordinary)]
    cache: dict[str, int] = {}
    pieces: list[str] = []
    for i, a, b in places:
        p = _spaced(texts[i][a:b])
        if p not in cache:
            cache[p] = len(pieces)
            pieces.append(p)
    tagged = tag(pieces, r) if pieces else []
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, a, b in places:
        found = [(x + a, y + a, k) for x, y, k in tagged[cache[_spaced(texts[i][a:b])]]]
        out[i] += checked(texts[i], found, allowed, r.ordinary)
    return out


PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Typed placeholders for the spans; the rest stays as it is."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, k in sorted(spans):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[k]]
            at = b
    return "".join([*out, text[at:]])


def allow_pattern(terms: list[str | None]) -> re.Pattern | None:
    known = sorted({t for t in terms if t}, key=len, reverse=True)
    return re.compile(r"\b(?:" + "|".join(r"\s+".join(map(re.escape, t.split())) for t in known) + r")\b") if known else None


def found(texts: DataFrame, allow_terms: list[str | None]) -> DataFrame:
    """(doc_id, chunk_index, kind) of rows (doc_id, chunk_index, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        allowed = allow_pattern(allow_terms)
        for pdf in batches:
            got = read(pdf["text"].tolist(), allowed)
            rows = [(d, c, k) for d, c, s in zip(pdf["doc_id"], pdf["chunk_index"], got, strict=True) for k in sorted({k for _, _, k in s})]
            yield pd.DataFrame({"doc_id": pd.Series([r[0] for r in rows], dtype="int64"), "chunk_index": pd.Series([r[1] for r in rows], dtype="int32"), "kind": pd.Series([r[2] for r in rows], dtype=object)})

    return texts.where("text is not null").select("doc_id", "chunk_index", "text").mapInPandas(run, "doc_id long, chunk_index int, kind string")


def redacted(texts: DataFrame, allow_terms: list[str | None]) -> DataFrame:
    """(doc_id, chunk_index, text) with placeholders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        allowed = allow_pattern(allow_terms)
        for pdf in batches:
            ts = [t if t is not None else "" for t in pdf["text"]]
            yield pdf.assign(text=[redact(t, s) for t, s in zip(pdf["text"], read(ts, allowed), strict=True)])

    return texts.select("doc_id", "chunk_index", "text").mapInPandas(run, "doc_id long, chunk_index int, text string")
