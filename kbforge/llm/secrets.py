"""Credentials in source code and configuration: unnatural strings plus context rules, redacted in place.

A string is unnatural if a public subword vocabulary needs many tokens for it (few characters per token): words give four or
more characters per token, random keys about two. A literal is a credential if its context says so (the name it is assigned to, a
header, a URL with a login, a webhook address, a key prefix, a private-key mark) and it is unnatural; passwords made of words need a
password's name. Placeholders, references to variables, files or vaults, digests, ids and public keys are none.

Redaction keeps every other character: the literal is replaced by a run of the same length of characters that are valid where
it stands, so that offsets, quotes and line ends stay.

Defined results: null and empty texts hold none; lines are split at "\\n" and counted from 1, whatever else ends a line; a line is given
once however many credentials it holds; repeated rows each give theirs; very long lines are scanned whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from kbforge.llm.tokens import VOCABULARY, encoder

CHARS_PER_TOKEN = 2.75
# Words in names of credentials; those that may hold a password made of words; words that make a name harmless.
PASSWORD_WORDS = frozenset("password passwd pwd pw pass passphrase passwort kennwort passcode contrasena contraseña motdepasse mdp".split())
SECRET_WORDS = PASSWORD_WORDS | frozenset("secret token apikey auth authorization key credential credentials bearer signature pat jwt sas conn".split())
HARMLESS_WORDS = frozenset("name file path dir url uri ttl length min max count limit len type kind public pub pubkey policy size expiry expires ring rotation schema sort cache primary foreign map board id ids fingerprint digest sha256 sha1 md5 checksum hash sum version rev format hint prompt label field column header".split())
_GATE = re.compile(r"(?i)pass|pwd|\bpw\b|log-?[io]n\b|mdp|secret|token|key|conn|auth|cred|clave|contrase|kennwort|jwt|hooks?[.-]|://[^\s/:@]*:[^\s/@]+@|AKIA|bearer|\b[a-z]{2,5}_[a-z]{2,5}_\w{16}|xox[a-z]-|gh[a-z]_|glpat-|npm_|eyJ|\s-u\s")
# Signs of the rules below that the gate lacks: (literal to look for first, in lower case or as written; pattern).
_SIGNS_LOWER = [("signature", re.compile(r"(?i)signature")), ("basic", re.compile(r"(?i)basic\s")), ("hook", re.compile(r"(?i)hook[\w.-]*/"))]
_SIGNS = [(x, re.compile(x + y)) for x, y in (("ASIA", "[A-Z0-9]"), ("AIza", r"[\w-]"), ("SG", r"\.[\w-]"), ("k_live_", ""), ("k_test_", ""), ("_pat_", ""), ("-u=", ""), ("--user", r"[\s=]"))]
for _w in ("pat", "sas"):
    for _k in range(4):  # the spellings of a word that _SPLIT keeps whole
        _x = _w[:_k].upper() + _w[_k:]
        _before = rf"(?<![A-Za-zÀ-ÿ0-9]{_x})" if _k == 0 else rf"(?<![A-ZÀ-Þ]{_x})"
        _SIGNS.append((_x, re.compile(_x + _before + ("(?![A-Za-zÀ-ÿ0-9])" if _k == 3 else "(?![a-zà-ÿ0-9])"))))
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")  # as html.unescape reads them
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINES = re.compile(r"""(?:(?:\\[nr]|[\s"'+,>#*|-])*(?:(?:Proc-Type|DEK-Info|Version|Comment): [^\n\\]*|[A-Za-z0-9+/]{24,}={0,2}|[A-Za-z0-9+/]{2,}={1,2})(?![\w+/=]))*""")
_LOGIN = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://([^\s/:@'\"<>]*):([^\s/@'\"<>]+)@[\w\[]", re.I)
_HEADER = re.compile(r"(?i)\b(?:authorization|x-auth-token|x-api-key|private-token|x-[a-z-]*(?:token|key|secret))\b['\"]?\s*[:=,]\s*['\"]?\s*(?:(?:basic|bearer|token|apikey)\s+)?([^\s'\",;<>]{8,})")
_SCHEME = re.compile(r"(?i)\b(?:bearer|basic)\s+([A-Za-z0-9+/_.=~-]{12,})")
_WEBHOOK = re.compile(r"(?i)https?://[\w.-]*(?:hook|webhook)[\w.-]*/(?:[\w-]+/)*([\w-]{6,}(?:/[\w-]{6,})*/?[\w-]{16,})")
_PREFIXED = re.compile(r"\b(?:(AKIA|ASIA)[A-Z0-9]{16}\b|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|glpat-[\w-]{16,}|xox[abpsr]-[\w-]{16,}|npm_[A-Za-z0-9]{20,}|[a-z]{2,6}_pat_[A-Za-z0-9]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,})")
_CONNECTION = re.compile(r"(?i)\b(AccountKey|SharedAccessKey|Password|Pwd)=([^;'\"\s<>]{6,})")
_CURL = re.compile(r"\bcurl\b.*?\s(?:-u|--user)[\s=]+['\"]?([^\s:'\"]+):([^\s'\"]+)")
# "login NAME / PASSWORD" in remarks.
_PAIR = re.compile(r"(?i)\b(?:log-?[io]n|account|credentials?|creds)\b:?\s+[\w.@-]+\s+/\s+([^\s'\",;<>]{6,})")
_NAMED = re.compile(
    r"(?<![\wÀ-ÿ])\d*(?P<name>[A-Za-zÀ-ÿ_][\wÀ-ÿ.-]*)[\"'\]]{0,3}\s{0,3}(?::\s?(?:str|string|String|bytes|&str)\s{0,3}=|:=|=>|->|==?|:|,|\s)\s{0,3}"
    r"(?P<value>[rbuf]?\"(?:[^\"\\\n]|\\.)*\"|[rbuf]?'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\s\"'`,;<>(){}\[\]]+)"
)
_SPLIT = re.compile(r"[^A-Za-zÀ-ÿ0-9]+|(?<=[a-zà-ÿ0-9])(?=[A-Z])")
_HOLDER = re.compile(
    r"(?i)^(?:[x*.•#?_-]+|\$.*|.*\$\{.*|.*\{\{.*|%\(?.*\)?s?|<.*>|\[.*\]|env[:.].*|!.*|vault[:.].*|secret[sm]?[:.].*|file[:.].*|ref[+:].*|arn:.*|@.*|&.*"
    r"|os\.environ.*|process\.env.*|.*(?:change-?_?me|set-?_?me|placeholder|your[-_ ]|example|redacted|dummy|replace|todo|fixme|insert).*|null|none|nil|true|false|undefined|test|secret|password|string|str|token|required|optional|missing)$"
)
_PATH = re.compile(r"^(?:~|\.{1,2})?/(?:[\w.-]+/)*[\w.-]+\.[a-z]{2,5}$|^(?:~|\.{1,2})?/(?:[a-z][a-z.-]*/)+[\w.-]*$|^https?://", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)


def chars_per_token(s: str, vocabulary: str = VOCABULARY) -> float:
    """Over the whole string, in pieces of bounded length."""
    e = encoder(vocabulary)
    return len(s) / max(1, sum(len(e.encode_ordinary(s[at : at + 400])) for at in range(0, len(s), 400)))


def unnatural(s: str, least: int = 12) -> bool:
    return len(s) >= least and chars_per_token(s) < CHARS_PER_TOKEN and len(set(s)) > 5


def _words(name: str) -> list[str]:
    return [w.lower() for w in _SPLIT.split(name) if w]


def _is_literal(v: str) -> bool:
    return not (_HOLDER.match(v) or _PATH.match(v) or _UUID.match(v))


def _named(m: re.Match) -> tuple[int, int] | None:
    """Span of a literal credential assigned to a telling name."""
    words = _words(m["name"])
    if not words or not (set(words) & SECRET_WORDS or {"mot", "passe"} <= set(words) or "api" in words and "key" in words or any(w.endswith(("password", "apikey", "secret", "passwd")) for w in words)):
        return None
    value, at = m["value"], m.start("value")
    quoted = value[-1] in "\"'`" and len(value) > 1
    between = m.string[m.end("name") : at]
    if not quoted and ("," in between or not between.strip("\"'] ") and m.string[m.start() - 1 : m.start()] != "-"):
        return None
    if quoted:
        cut = 2 if value[0] in "rbuf" and value[1] in "\"'" else 1
        value, at = value[cut:-1], at + cut
    value = value.strip() if not quoted else value
    if not value or not _is_literal(value) or value.startswith(("ssh-", "-----BEGIN", "data:", "sha256", "sha1", "sha512", "md5:")):
        return None
    last = [w for w in words if w not in ("b64", "base64", "enc", "value", "prod", "dev", "staging")]
    if set(last[-2:]) & HARMLESS_WORDS and not ("id" in last and "access" in last):
        return None
    telling = set(words) & PASSWORD_WORDS or {"mot", "passe"} <= set(words) or any(w.endswith(("password", "passwd")) for w in words)
    if telling:
        mixed = bool(re.search(r"\d", value)) + bool(re.search(r"[A-Z]", value)) + bool(re.search(r"[^A-Za-z0-9]", value))
        code = not quoted and re.search(r"[.(\[]|^[a-z_]+$|^[A-Z_]+$|^\d+$", value) and not re.search(r"\d.*[^\w.]|[^\w.].*\d", value)
        if len(value) >= 6 and not code and (mixed >= 2 or mixed and (quoted or unnatural(value, 8)) or quoted and unnatural(value, 8)) and not re.search(r"\s", value) and not re.fullmatch(r"\d{1,5}", value):
            return at, at + len(value)
        if quoted and len(value) >= 12 and re.fullmatch(r"[a-z]+(?:[ -][a-z]+){2,}", value) and words[-1] in ("passphrase",):
            return at, at + len(value)
        return None
    if re.search(r"\s", value) or not re.search(r"[0-9]", value) and not quoted:
        return None
    return (at, at + len(value)) if unnatural(value) else None


def spans(line: str) -> list[tuple[int, int]]:
    """Spans of literal credentials in a line."""
    out: list[tuple[int, int]] = []
    for m in _LOGIN.finditer(line):
        if _is_literal(m[2]) and not re.fullmatch(r"(?i)pass(word)?|pwd|secret|token|\d{1,5}", m[2]):
            out.append(m.span(2))
    for m in _CURL.finditer(line):
        if _is_literal(m[2]):
            out.append(m.span(2))
    for r in (_HEADER, _SCHEME):
        for m in r.finditer(line):
            if _is_literal(m[1]) and unnatural(m[1]):
                out.append(m.span(1))
    for m in _WEBHOOK.finditer(line):
        if unnatural(m[1].rpartition("/")[2]):
            out.append(m.span(1))
    for m in _PREFIXED.finditer(line):
        if _is_literal(m[0]) and len(set(m[0])) > 8:
            out.append(m.span())
    for m in _CONNECTION.finditer(line):
        if _is_literal(m[2]) and unnatural(m[2], 8):
            out.append(m.span(2))
    for m in _PAIR.finditer(line):
        if _is_literal(m[1]) and re.search(r"\d", m[1]) and (unnatural(m[1], 8) or re.search(r"[A-Z]", m[1])):
            out.append(m.span(1))
    at = 0
    while m := _NAMED.search(line, at):
        s = _named(m)
        if s:
            out.append(s)
        if m["value"][-1] in "\"'`" and len(m["value"]) > 1:
            inner = m["value"][1:-1]
            if not s and re.search(r"\w\s?[=:]\s?[\"'\w]", inner) and not inner.lower().startswith("env:"):
                out += [(a + m.start("value") + 1, b + m.start("value") + 1) for a, b in spans(inner)]
            at = m.end()
        else:
            at = m.end() if s else m.start("value")
    return out


def _unescaped(line: str) -> tuple[str, list[int], list[int]]:
    """html.unescape(line), and where each of its characters starts and ends in the line."""
    out, starts, ends, at = [], [], [], 0

    def keep(a: int, b: int) -> None:
        out.append(line[a:b])
        starts.extend(range(a, b))
        ends.extend(range(a + 1, b + 1))

    for m in _ENTITY.finditer(line):
        keep(at, m.start())
        at, new = m.end(), html.unescape(m[0])
        rest = 0  # what follows a reference without its semicolon stays as it is
        while rest < (len(new) if new == m[0] else len(new) - 1) and new[-1 - rest] == m[0][-1 - rest]:
            rest += 1
        out.append(new[: len(new) - rest])
        starts += [m.start()] * (len(new) - rest)
        ends += [at - rest] * (len(new) - rest)
        keep(at - rest, at)
    keep(at, len(line))
    return "".join(out), starts, ends


def _line_spans(line: str) -> list[tuple[int, int]]:
    """Spans of literal credentials in a line that may be HTML-escaped."""
    if "&" not in line:
        return spans(line)
    plain, starts, ends = _unescaped(line)
    return [(starts[a], ends[b - 1]) for a, b in spans(plain) if a < b]


def _hits(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(line number, start, end of the line, line) of lines that pass the gate."""
    at, no, low = 0, 1, text.lower()
    signs = [r for x, r in _SIGNS_LOWER if x in low] + [r for x, r in _SIGNS if x in text]
    for g in sorted(m.start() for r in [_GATE, *signs] for m in r.finditer(text)):
        if g < at:
            continue
        start = text.rfind("\n", 0, g) + 1
        end = text.find("\n", g)
        end = len(text) if end < 0 else end
        no += text.count("\n", max(0, at - 1) if at else 0, start) if at else text.count("\n", 0, start)
        yield no, start, end, text[start:end]
        at = end + 1


def lines(text: str | None) -> list[int]:
    """Numbers of the lines that hold a literal credential."""
    out = []
    for no, _, _, line in _hits(text or ""):
        if _PRIVATE.search(line) or _line_spans(line):
            out.append(no)
    return out


def redact(text: str | None) -> str | None:
    """The text with credentials replaced by X runs of equal length; bodies of private keys up to their end mark too."""
    if not text:
        return text
    chars = list(text)
    for _, start, _, line in _hits(text):
        for a, b in _line_spans(line):
            chars[start + a : start + b] = "X" * (b - a)
    for m in _PRIVATE.finditer(text):
        # Up to the end mark; a block cut off before it ends with its lines of key text.
        end, nxt = text.find("-----END ", m.end()), text.find("-----BEGIN ", m.end())
        if end < 0 or 0 <= nxt < end:
            end = _KEY_LINES.match(text, m.end()).end()
        chars[m.end() : end] = re.sub(r"\\[nr]|[A-Za-z0-9+/=]", lambda x: x[0] if x[0][0] == "\\" else "X", text[m.end() : end])
    return "".join(chars)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no) of documents (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for n in lines(t)]
            yield pd.DataFrame({"doc_id": pd.Series([r[0] for r in rows], dtype="int64"), "line_no": pd.Series([r[1] for r in rows], dtype="int32")})

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, line_no int")


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with credentials redacted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=pdf["text"].map(redact))

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string")
