"""Queries and SQL of this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("top_n", "splitting", "fusion", "distinctive", "leakage", "secrets", "handwritten", "abuse", "containers")


def _parts(name: str) -> dict:
    found: dict = {}
    for m in _MODULES:
        try:
            module = importlib.import_module(f"lineweave.llm.{m}")
        except ModuleNotFoundError as e:
            if e.name == f"lineweave.llm.{m}":
                continue
            raise
        found |= getattr(module, name)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _parts("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _parts("SQL")
