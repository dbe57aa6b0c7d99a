"""Queries of credentials in text (2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbforge.llm import secrets
from kbforge.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(table(spark, sf_dir, "documents"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_redacted": p2_redacted}


def oracle_sql() -> dict[str, str]:
    return {}
