"""Fits the personal-information tagger: python -m kbforge.llm.pii_fit DOCUMENTS.parquet

Labelled spans come from labelling functions over a bounded sample (at most SAMPLE_DOCUMENTS documents); names, digits and
emails are also recombined at random, so that the tagger learns shapes and contexts rather than the sample's strings.
"""

from __future__ import annotations

import re
import sys
import time
from collections import Counter

import numpy as np

from kbforge.llm import pii
from kbforge.llm.tagger import KINDS, PAD_FLAGS, Adam, Tagger, encode

SAMPLE_DOCUMENTS = 10_000
_EMAIL = re.compile(r"(?<![\w.+/-])[A-Za-z0-9][\w.+-]*(?: ?[@＠] ?| ?\[at\] ?| ?\(at\) ?)[A-Za-z][A-Za-z0-9-]*(?:(?:\.|\(dot\)|\[dot\])[A-Za-z][A-Za-z0-9-]*)+")
_SEP = "[ \u00a0\u202f.\\-\u2011]"
_PHONE = re.compile(
    rf"(?<![\w/=.+-])(?:\+\d{{1,3}}{_SEP}?|00\d{{2}}{_SEP}?(?:\(0\))?)?(?:\(\d{{2,4}}\){_SEP}?)?\d{{1,5}}(?:[  .\-‑/]\d{{2,9}}){{1,5}}(?![\w/@]|\.\d|-\d)(?:,? (?:ext\.?|x|Durchwahl|poste) ?\d{{1,5}})?"
    r"|(?<![\w/=.+-])(?:\+\d{10,13}|1\d{10})(?![\w/])"
)
_ID = re.compile(
    r"(?<![\w/=.-])(?:\d{3}([- ‑])\d{2}\1\d{4}|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]\d{8}|L0[A-Z0-9]{7}|(?<!\+)\d{2} \d{3} \d{3} \d{3})(?![\w/-])"
    r"|(?<=number )\d{9}(?!\d)|(?<=SSN )\d{9}(?!\d)|(?<=SSN: )\d{9}(?!\d)|(?<=no\. )\d{9}(?!\d)"
)
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Terrace|Court|Ct|Drive|Dr|Way|Close|Row|Mews|Place|Pl|Boulevard|Blvd)\.?"
_ADDRESS = re.compile(
    rf"\b\d{{1,5}}[A-Za-z]? (?:[A-Z][a-z]+ ){{1,3}}{_STREET}(?:,? (?:(?:Apt|Unit|Suite|Flat) \w+|#\w+))?(?:[,\n]\s?[A-ZÀ-Þ][\w-]+(?: [A-Z][\w-]+)?,?(?: [A-Z]{{2}} \d{{5}}| [A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}})?)?"
    r"|\b\d{1,4}(?: (?:bis|ter))?,? (?:rue|avenue|place|quai|impasse|boulevard|allée|chemin|cours|route) [^\n,]{3,40},\s\d{5} [A-ZÀ-Þ][\w-]+"
    r"|(?<!\w)(?:C/|Calle|Paseo|Avenida|Plaza|Ronda|Camino|Travesía)(?: (?:de|del|la|las|los|el))* [A-ZÀ-Þ][\w-]+(?: [A-ZÀ-Þ][\w-]+)?,? (?:nº )?\d{1,4}(?:, \d{1,2}º ?[A-Z]?)?,\s\d{5} [A-ZÀ-Þ][\w-]+"
    r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|gasse|platz|allee|str\.|ring|damm|ufer|hof|steig) ?\d{1,4}[a-z]?,\s\d{5} [A-ZÀ-Þ][\w-]+"
    r"|\b(?:Am|An der|Im|Zum) [A-ZÄÖÜ][a-zäöüß-]+(?: [A-ZÄÖÜ][a-zäöüß-]+)? \d{1,4}[a-z]?,\s\d{5} [A-ZÀ-Þ][\w-]+"
)
# Contexts whose next words are a person, and contexts that follow one.
_LEAD = re.compile(
    r"(?:returned to|preguntar a|prévenir|signalé par|Signalé par|Avisado por|Gemeldet von|Reported by|According to|We met|Please ask|Bitte|cc|Owner:|Kontakt:|maintainer:|ask:|author:|owner:|"
    r"(?:Kind regards|Best regards|Regards|Cordialement|Saludos|Viele Grüße|Mit freundlichen Grüßen),?(?:\s|</?\w+ ?/?>)*) ?(?=[A-ZÀ-Þ])"
)
_FOLLOW = re.compile(r" (?:signed off on|hat die Änderung|a validé la|aprobó el)")
_TOKEN = re.compile(r"(?:Prof|Dr|Mrs?|Ms|Mme|Sra?)\.|[A-ZÀ-ÖØ-Þ](?:\.|[A-Za-zÀ-ÖØ-öø-ÿ'’]+(?:-[A-ZÀ-Þ][A-Za-zÀ-ÿ]+)*)")


def common_words(texts: list[str]) -> tuple[frozenset[str], list[str]]:
    """Ordinary words of the sample (often written, or written small outside emails), and first names seen in emails."""
    names = Counter()
    for t in texts:
        for m in re.finditer(r"\b([a-z]+)\.[a-z-]{4,}(?:\+\w+)?\s?(?:@|\[at\]|\(at\))|\b[a-z-]{4,}_([a-z]+)\s?(?:@|\[at\]|\(at\))", t):
            names[m[1] or m[2]] += 1
    given = [n for n, c in names.items() if c >= 3]
    small, all_df = Counter(), Counter()
    for t in texts:
        t = re.sub(r"\S+ ?(?:@|\[at\]|\(at\))\S*|https?://\S+|[\w/.-]+\.(?:md|txt|py|js|ts)\b", " ", t)
        ws = set(re.findall(r"(?<![\w-])[^\W\d_]{2,}(?![\w-])", t))
        small.update(w for w in ws if w.islower())
        all_df.update({w.lower() for w in ws})
    least = max(3, len(texts) // 5000)
    often = max(5, round(0.006 * len(texts)))
    common = {w for w, c in small.items() if c >= least} | {w for w, c in all_df.items() if c >= often}
    return frozenset(common - set(given)), given


def label(text: str, ordinary, allowed: re.Pattern | None) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    taken = np.zeros(len(text) + 1, bool)

    def add(a: int, b: int, kind: str) -> None:
        if a < b and not taken[a:b].any():
            taken[a:b] = True
            spans.append((a, b, kind))

    for m in pii._URL_LOGIN.finditer(text):
        taken[m.start() : m.end()] = True
    for m in _EMAIL.finditer(text):
        if not pii._NOT_EMAIL.search(m[0]):
            add(m.start(), m.end(), "email")
        taken[m.start() : m.end()] = True
    for m in _ADDRESS.finditer(text):
        add(m.start(), m.end(), "address")
    for m in _ID.finditer(text):
        if not re.search(r"(?i)(?:serial|request|build) $", text[max(0, m.start() - 9) : m.start()]):
            add(m.start(), m.end(), "id_number")
    for m in _PHONE.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        shape = re.fullmatch(r"\d{1,3}(\.\d+){3}|\d{4}(\.\d+)+|\d{7}-\d{2}|\d{4}-\d{2}-\d{2,3}|\d{4}-\d\d-\d\d \d\d|[\d ]+\.\d+", m[0])
        if 9 <= len(digits) <= 17 and not shape and not re.search(r"(?i)(?:serial|request|build|wrote|INC-)\s?$", text[max(0, m.start() - 9) : m.start()]):
            add(m.start(), m.end(), "phone")
    terms = [m.span() for m in allowed.finditer(text)] if allowed else []

    def name_at(i: int) -> int:
        """End of the run of name words from i."""
        end, at, unknown = i, i, False
        for _ in range(5):
            m = _TOKEN.match(text, at)
            if not m:
                break
            w = m[0]
            initial = w.endswith(".")
            if initial and len(w) > 2 and i == at:
                end = at = m.end() + (text[m.end() : m.end() + 1] == " ")
                continue
            if not initial and all(ordinary(p) for p in re.findall(r"[^\W\d_]+", w)):
                break
            unknown |= not initial
            end = m.end()
            sep = re.match(r",? ", text[end:])
            if not sep:
                break
            at = end + sep.end()
        return end if unknown else i

    for m in _LEAD.finditer(text):
        end = name_at(m.end())
        if end > m.end() and not any(m.end() < y and x < end for x, y in terms):
            add(m.end(), end, "person")
    for m in _FOLLOW.finditer(text):
        start = max(0, m.start() - 60)
        for t in _TOKEN.finditer(text, start, m.start()):
            if (t.start() == 0 or not (text[t.start() - 1].isalnum() or text[t.start() - 1] in "-.")) and name_at(t.start()) == m.start() and not taken[t.start() : m.start()].any():
                add(t.start(), m.start(), "person")
                break
    return sorted(spans)


_SYLLABLES = "bal bren cal dor el fal gar hol ir jen kor lin mor nor ol per quin ros sil tor ul ven wil yar zel ard berg mar tol".split()
_ENDINGS = "ov enko ston field berg er mann ini etti ez son well quist strom dale wick ier eau uri ova ski ra ton ley gren".split()


def _surname(r: np.random.Generator) -> str:
    s = (str(r.choice(_SYLLABLES)) + str(r.choice(_ENDINGS))).capitalize()
    return s if r.random() > 0.12 else s + "-" + (str(r.choice(_SYLLABLES)) + str(r.choice(_ENDINGS))).capitalize()


def _new_name(r: np.random.Generator, given: list[str]) -> str:
    g, s = str(r.choice(given)).capitalize() if r.random() < 0.7 else (str(r.choice(_SYLLABLES)) + str(r.choice(["a", "in", "o", "ia", "us", "e"]))).capitalize(), _surname(r)
    i = chr(65 + int(r.integers(26))) + "."
    return str(r.choice([f"{g} {s}", f"{s}, {g}", f"{g} {i} {s}", f"{i[0]}. {s}", f"{g} {i}", f"{g}", f"{g} {s.upper()}"], p=[0.38, 0.14, 0.14, 0.12, 0.08, 0.1, 0.04]))


def augment(piece: str, spans: list[tuple[int, int, str]], r: np.random.Generator, given: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    out, new, at = "", [], 0
    for a, b, k in spans:
        out += piece[at:a]
        s = piece[a:b]
        if k == "person" and a > 0 and b < len(piece) and r.random() < 0.6:
            s = _new_name(r, given)
        elif k in ("phone", "id_number", "address") and r.random() < 0.6:
            s = re.sub(r"[0-9]", lambda m: str(r.integers(10)), s)
        new.append((len(out), len(out) + len(s), k))
        out += s
        at = b
    out += piece[at:]
    return out, new


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, b, k in spans:
        y[a:b] = 2 + 2 * KINDS.index(k)
        y[a] = 1 + 2 * KINDS.index(k)
    return y


def examples(texts: list[str], ordinary, allowed) -> list[tuple[str, list[tuple[int, int, str]]]]:
    out = []
    for t in texts:
        places = pii.regions(t, ordinary)
        if not places:
            continue
        spans = label(t, ordinary, allowed)
        for a, b in places:
            for x, y in pii._windows(b - a):
                lo, hi = a + x, a + y
                out.append((t[lo:hi], [(max(s, lo) - lo, min(e, hi) - lo, k) for s, e, k in spans if s < hi and e > lo]))
    return out


def fit(texts: list[str], terms: list[str], path: str = pii.MODEL, steps: int = 1500, batch: int = 96, seconds: float = 420, seed: int = 1) -> dict[str, float]:
    r = np.random.default_rng(seed)
    texts = texts[:SAMPLE_DOCUMENTS]
    common, given = common_words(texts)
    hashes = frozenset(pii.word_hash(w) for w in common)
    memo: dict[str, bool] = {}

    def ordinary(w: str) -> bool:
        if w not in memo:
            memo[w] = pii.word_hash(w.lower()) in hashes
        return memo[w]

    allowed = pii.allow_pattern(terms)
    cut = len(texts) * 9 // 10
    train, held = examples(texts[:cut], ordinary, allowed), examples(texts[cut:], ordinary, allowed)
    pos, neg = [e for e in train if e[1]], [e for e in train if not e[1]]
    print("regions", len(pos), len(neg), "held out", len(held), "ordinary words", len(common), flush=True)
    model = Tagger.fresh(seed=seed)
    opt = Adam(model.p)
    began = time.time()
    for step in range(steps):
        k = batch * 2 // 3
        pick = [augment(*pos[i], r, given) for i in r.integers(len(pos), size=k)] + [neg[i] for i in r.integers(len(neg), size=batch - k)]
        size = max(len(p) for p, _ in pick)
        ids, flags, mask, y = np.zeros((batch, size), np.int16), np.zeros((batch, size, PAD_FLAGS), np.float32), np.zeros((batch, size), bool), np.zeros((batch, size), np.int64)
        for i, (p, s) in enumerate(pick):
            n = len(p)
            ids[i, :n], flags[i, :n], mask[i, :n], y[i, :n] = encode(p), pii.char_flags(p, ordinary), True, tags_of(n, s)
        loss, grads = model.loss_and_grads(ids, flags, mask, y)
        left = 1 - max(step / steps, (time.time() - began) / seconds)
        opt.step(grads, 6e-3 * max(0.03, left))
        if step % 100 == 0:
            print(step, round(loss, 3), round(time.time() - began), flush=True)
        if left <= 0:
            break
    np.savez_compressed(path, common_words=np.array(sorted(hashes), dtype=np.uint32), **{k: v.astype(np.float16) for k, v in model.p.items()})
    pii.reader.cache_clear()
    got = pii.tag([p for p, _ in held], pii.reader(path))
    scores = {}
    for k in KINDS:
        want = [any(s[2] == k for s in spans) for _, spans in held]
        have = [any(s[2] == k for s in spans) for spans in got]
        both = sum(a and b for a, b in zip(want, have, strict=True))
        scores[k] = (round(both / max(1, sum(have)), 4), round(both / max(1, sum(want)), 4), sum(want))
    print("held out precision, recall, cases:", scores)
    return scores


if __name__ == "__main__":
    import pyarrow.parquet as pq

    where = sys.argv[1]
    docs = pq.read_table(f"{where}/documents.parquet", columns=["text"]).column("text").to_pylist()
    fit([t for t in docs if t], [t for t in pq.read_table(f"{where}/ner_allowlist.parquet").column("term").to_pylist() if t])
