"""All core queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import indexes, markup, references, retrieval, store, streams, text

MODULES = (references, text, retrieval, store, indexes, streams, markup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= m.ORACLE
    return out


def flagship(spark: SparkSession, base: str) -> DataFrame:
    return text.chunk_pack(spark, base)
