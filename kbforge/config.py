"""Configuration: YAML files with fallbacks, tier rules that fail closed, allow lists in JSON.

A missing file gives an empty configuration; unknown or malformed tiers give `strict`; malformed rules are dropped.
"""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from kbforge.operators.sanitize import TIERS

VARIABLE, FILE = "KBFORGE_CONFIG", "kbforge.yml"


def find(start: str | None = None, levels: int = 5) -> str | None:
    """The file that the variable names, else the nearest one in the folder or up to `levels` parents."""
    named = os.environ.get(VARIABLE)
    if named:
        return named if os.path.isfile(named) else None
    where = os.path.abspath(start or os.getcwd())
    for _ in range(levels + 1):
        path = os.path.join(where, FILE)
        if os.path.isfile(path):
            return path
        where = os.path.dirname(where)
    return None


def load(path: str | None = None) -> dict[str, Any]:
    import yaml

    path = path or find()
    if not path or not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        content = yaml.safe_load(f)
    return content if isinstance(content, dict) else {}


def section(config: dict, name: str) -> dict:
    part = config.get(name)
    return part if isinstance(part, dict) else {}


def tiers(config: dict) -> dict[str, Any]:
    """default and rules of sanitize.resolve_tier; anything that can't be read redacts more, never less."""
    part = section(config, "security")
    default, rules = part.get("sanitize_default_tier"), part.get("sanitize_path_tiers")
    good = [r for r in rules if isinstance(r, dict) and isinstance(r.get("path"), str) and r["path"] and isinstance(r.get("tier"), str) and r["tier"] in TIERS] if isinstance(rules, list) else []
    return {"default": default if isinstance(default, str) and default in TIERS else "strict", "rules": good}


def limits(config: dict) -> dict[str, int]:
    """Numbers of candidates of a search, with their defaults."""
    part, out = section(config, "retrieval"), {"default_top_k": 5, "vector_limit": 20, "bm25_limit": 20, "fusion_limit": 10}
    return {k: part[k] if isinstance(part.get(k), int) and part[k] > 0 else v for k, v in out.items()}


def allowed_bases(config: dict, base: str | None = None) -> list[str]:
    listed = section(config, "security").get("allowed_base_paths")
    good = [p for p in listed if isinstance(p, str) and p] if isinstance(listed, list) else []
    return good or [base or os.getcwd()]


def allowlist(spark: SparkSession, path: str, before: DataFrame | None = None) -> DataFrame:
    """(category, term) of {"allowlist": {category: {"terms": [...]}}}; `before`, or no terms, if the file can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)["allowlist"]
        rows = [(str(c), t) for c, x in content.items() for t in (x or {}).get("terms", []) if isinstance(t, str)]
    except (OSError, ValueError, KeyError, AttributeError, TypeError):
        if before is not None:
            return before
        rows = []
    return spark.createDataFrame(rows, "category string, term string")
