"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshweave.llm import queries as q
from meshweave.llm import sql

NAMES = [name for name in sorted(vars(q), key=lambda n: (len(n.split("_")[0]), n)) if name.startswith("op")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(q, name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
