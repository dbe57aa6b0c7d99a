"""Queries of markup residue (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbforge.llm import markup
from kbforge.runtime import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.found(table(spark, sf_dir, "documents"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p7_found": p7_found, "p7_cleaned": p7_cleaned}


def oracle_sql() -> dict[str, str]:
    return {}
