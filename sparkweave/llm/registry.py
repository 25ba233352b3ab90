"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("p1_cooccurrence", "p2_names", "p3_encoding", "p4_frequency", "p5_boilerplate", "p6_site_lines", "p7_neighbours", "p8_tokenize", "p9_leaks", "p10_language")


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"sparkweave.llm.{m}"), what).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
