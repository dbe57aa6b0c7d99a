"""Chunkers (Markdown, code, generic), context rules and token estimates. Documents are independent; a fold runs within one document.

Null and blank texts give no chunks; texts below the least size are dropped, as are short buffers before an overflow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_TOKENS, LEAST_TOKENS = 384, 100
# Suffixes by chunker, starts of lines at which code may be broken.
MARKDOWN, CODE = [".md", ".txt"], [".py", ".ts", ".js", ".sh"]
BREAK_STARTS = ("def ", "class ", "function ", "const ", "export ", "#", "//", "/*", "*", '"""', "'''")
BREAK_LINES = ("}", "};", "})", "});")
SCHEMA = "chunk_index int, text string, start_char int, end_char int, token_count int"


def tokens(s: str) -> int:
    return len(s) // 4


def _pack(parts: list[str], joint: str, content: str, overlap: bool, generic: bool) -> list[tuple[str, int]]:
    out, cur, start = [], "", 0
    for p in map(str.strip, parts):
        if not p:
            continue
        both = cur + joint + p if cur else p
        if tokens(both) <= CHUNK_TOKENS:
            if not cur or generic and not start:
                start = content.find(p)
            cur = both
        else:
            if cur and tokens(cur) >= LEAST_TOKENS:
                out.append((cur, start))
            cur = cur.rpartition("\n\n")[2] + "\n\n" + p if overlap and "\n\n" in cur else p
            start = content.find(p)
    return out + ([(cur, start)] if cur and tokens(cur) >= LEAST_TOKENS else [])


def markdown(content: str) -> list[tuple[str, int]]:
    return _pack(re.split(r"\n\n+", content), "\n\n", content, True, False)


def generic(content: str) -> list[tuple[str, int]]:
    return _pack(re.split(r"(?<=[.!?])\s+", content), " ", content, False, True)


def good_break(line: str) -> bool:
    s = line.strip()
    return not s or s.startswith(BREAK_STARTS) or s in BREAK_LINES


def code(content: str) -> list[tuple[str, int]]:
    out, cur = [], ""
    for line in content.split("\n"):
        both = cur + "\n" + line if cur else line
        if tokens(both) > CHUNK_TOKENS and cur and good_break(line):
            if tokens(cur) >= LEAST_TOKENS:
                out.append((cur, 0))
            cur = "\n".join(cur.split("\n")[-3:]) + "\n" + line
        else:
            cur = both
    return out + ([(cur, 0)] if cur and tokens(cur) >= LEAST_TOKENS else [])


def chunk_text(content: str, suffix: str | None) -> list[tuple[str, int]]:
    return (markdown if suffix in MARKDOWN else code if suffix in CODE else generic)(content)


def chunked(docs: DataFrame, id_col: str, text_col: str, suffix_col: str) -> DataFrame:
    """(id, chunk_index, text, start_char, end_char, token_count) of documents."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c, s, s + len(c), tokens(c)) for i, t, x in zip(pdf[id_col], pdf[text_col], pdf[suffix_col], strict=True) if t for k, (c, s) in enumerate(chunk_text(t, x))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "text", "start_char", "end_char", "token_count"])

    return docs.select(id_col, text_col, suffix_col).where(F.col(text_col).isNotNull()).mapInPandas(run, f"{id_col} {kind}, {SCHEMA}")


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def needs_context(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    few = F.size(F.split(t, "\n")) <= 2
    listed = F.regexp_like(t, F.lit(r"^(?:- |\* |1\. |2\. |3\. )"))
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    skip = (F.length(t) < 100) | t.startswith("#") | F.contains(F.substring(t, 1, 50), F.lit("```")) | (few & listed) | (t.startswith("|") & (pipes > 2))
    return ~skip


def context_of(path: Column, project: Column) -> Column:
    return F.concat(F.lit("This is from "), path, F.lit(" in the "), project, F.lit(" project."))


def estimated_tokens(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise((F.size(F.split(t, r"(?U)\s+")) / 0.75).cast("int"))
