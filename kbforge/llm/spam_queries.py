"""Queries of keyword-stuffed and link-list pages (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbforge.llm import spam
from kbforge.runtime import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


def queries() -> dict:
    return {"p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return {}
