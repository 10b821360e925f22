"""Collects the queries of every area and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.plans import automata, corpora, evaluation, models, scoring

Query = Callable[[SparkSession, str], DataFrame]
AREAS = (automata, evaluation, corpora, models, scoring)


def queries() -> dict[str, Query]:
    return {name: q for area in AREAS for name, q in area.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for area in AREAS for name, s in area.oracle_sql().items()}
