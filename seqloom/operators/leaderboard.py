"""Accuracy roll-ups, ranks, latencies and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(results: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    hit = F.sum(correct.cast("bigint"))
    return results.groupBy(*keys).agg(hit.alias("correct_count"), F.count(correct).alias("total_count"), (hit / F.count(correct)).alias("accuracy"))


def mean_of_means(table: DataFrame, keys: list[str], inner: str, value: Column) -> DataFrame:
    """The mean, without weights, of the means of ``inner``'s groups."""
    means = table.groupBy(*keys, inner).agg(F.avg(value).alias("mean"))
    return means.groupBy(*keys).agg(F.avg("mean").alias("score"))


def weighted(parts: dict[str, float]) -> Column:
    """Weighted sum of columns; a missing part counts as 0."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return total


def ranked(table: DataFrame, score: str, tie: str) -> DataFrame:
    """Ranks from 1 by falling score; equal scores are told apart by ``tie``.  One
    row a model: small enough for one task."""
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), tie)))


def latency(table: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    return table.groupBy(*keys).agg(F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("sd"), F.percentile(seconds, F.lit(0.95)).alias("p95"))


def error_rollup(failures: DataFrame, kind: Column) -> DataFrame:
    """Counts by error type, by its first part, and of all."""
    parts = failures.select(F.split(kind, ":")[0].alias("family"), kind.alias("error_type"))
    return parts.rollup("family", "error_type").agg(F.count("*").alias("n"))
