"""File sources: texts, office documents, changed-file rules, log readers. Files that can't be read become dead-letter rows, not gaps.

Empty and blank files are left out; suffixes compare case-sensitively; excluded parts match anywhere in the path.
"""

from __future__ import annotations

import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that are read, path parts that are not.
SUFFIXES = [".md", ".py", ".ts", ".js", ".json", ".txt", ".sh", ".yml", ".yaml", ".pdf", ".docx", ".pptx"]
EXCLUDED = ["node_modules", ".git", ".venv", ".venv-rag", "__pycache__", "dist", "build", "output/temp", ".DS_Store"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
LOG_SCHEMAS = {
    "tokens": "timestamp string, conversation_id string, operation_type string, operation_name string, tokens struct<input:long,output:long,total:long>, model string, cost_usd double, estimated boolean, metadata string",
    "traces": "conversation_id string, trace_id string, parent_trace_id string, operation_type string, operation_name string, start_time string, end_time string, duration_ms long, metadata string",
    "errors": "timestamp string, conversation_id string, severity string, source string, error_type string, error_message string, exit_code int, context string, stack_trace string, resolution_hint string, recovered boolean",
}


class UnsupportedFormat(ValueError):
    pass


def docx_text(data: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs, then all table rows with cells joined by " | "."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    paras = [text(p) for p in body.findall(f"{_W}p")]
    tables = body.findall(f"{_W}tbl")
    rows = [" | ".join(text(c).strip() for c in r.findall(f"{_W}tc")) for t in tables for r in t.findall(f"{_W}tr")]
    return "\n\n".join([p for p in paras if p.strip()] + [r for r in rows if r.strip(" |")]), {"paragraph_count": str(len(paras)), "table_count": str(len(tables))}


def pptx_text(data: bytes) -> tuple[str, dict[str, str]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for k, n in enumerate(names, 1):
        lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in ET.fromstring(z.read(n)).iter(f"{_A}p")]
        lines = [x for x in lines if x.strip()]
        if lines:
            out.append(f"--- Slide {k} ---\n" + "\n".join(lines))
    return "\n\n".join(out), {"slide_count": str(len(names))}


def parse(path: str, data: bytes) -> tuple[str, dict[str, str]]:
    suffix = os.path.splitext(path)[1]
    if suffix == ".docx":
        return docx_text(data)
    if suffix == ".pptx":
        return pptx_text(data)
    if suffix == ".pdf":
        raise UnsupportedFormat("no reader for .pdf is installed")
    return data.decode("utf-8"), {"file_size": str(len(data))}


def wanted(path: Column, suffixes: list[str] | None = None, excluded: list[str] | None = None) -> Column:
    keep = F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(suffixes or SUFFIXES)
    for part in EXCLUDED if excluded is None else excluded:
        keep = keep & ~F.contains(path, F.lit(part))
    return keep


def load(spark: SparkSession, path: str, project: str, recursive: bool = True, suffixes: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """(file_path, project, content, metadata, error): documents, and dead-letter rows with a null content and the reason."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select(F.regexp_replace("path", r"^file:/*", "/").alias("file_path"), "content").where(wanted(F.col("file_path"), suffixes, excluded))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["file_path"], pdf["content"], strict=True):
                try:
                    text, meta = parse(p, bytes(data))
                    if text.strip():
                        rows.append((p, project, text, meta, None))
                except Exception as e:
                    rows.append((p, project, None, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file_path", "project", "content", "metadata", "error"])

    return files.mapInPandas(run, "file_path string, project string, content string, metadata map<string,string>, error string")


def changed(path: Column, suffixes: list[str], prefixes: list[str]) -> Column:
    """Exact suffix and whole leading path components."""
    ok = F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(suffixes)
    where = F.lit(not prefixes)
    for p in prefixes:
        p = p.rstrip("/")
        where = where | (path == p) | path.startswith(p + "/")
    return ok & where


def read_logs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMAS[kind]).json(path)


class SecurityError(PermissionError):
    pass


def guarded(path: str, bases: list[str]) -> str:
    """The resolved path if it lies in one of the bases; else SecurityError."""
    if "\0" in path:
        raise SecurityError("null byte in path")
    real = os.path.realpath(os.path.expanduser(path))
    for b in bases:
        root = os.path.realpath(os.path.expanduser(b))
        if real == root or real.startswith(root.rstrip("/") + "/"):
            return real
    raise SecurityError(f"outside the allowed folders: {path}")
