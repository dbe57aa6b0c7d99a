"""Queries of personal information (1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.llm import pii
from kbforge.runtime import table


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_index, text) of documents (chunk_index -1) and chunks; a chunk written twice is one text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("chunk_index"), "text")
    return d.unionByName(table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", "text"))


def _terms(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["term"] for r in table(spark, sf_dir, "ner_allowlist").select("term").collect()]  # a fixed table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(texts(spark, sf_dir), _terms(spark, sf_dir)).distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(texts(spark, sf_dir), _terms(spark, sf_dir))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_redacted": p1_redacted}


def oracle_sql() -> dict[str, str]:
    return {}
