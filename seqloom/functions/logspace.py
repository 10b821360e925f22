"""Sums and products of probabilities held as logarithms.

Spark's ``ln(0)`` is null, so the logarithm of 0 is LOG_ZERO throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_ZERO = -1e30


def log(p: Column) -> Column:
    return F.when(p > 0, F.log(p)).otherwise(F.lit(LOG_ZERO))


def logsumexp(values: Column) -> Column:
    """Of an array."""
    top = F.array_max(values)
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top), lambda s: top + F.log(s))


def logsumexp_by(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Grouped logsumexp in two aggregations that both sum before the shuffle."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    joined = df.join(top, keys) if keys else df.crossJoin(F.broadcast(top))  # one row
    sums = joined.groupBy(*keys, "_top").agg(F.sum(F.exp(F.col(value) - F.col("_top"))).alias("_sum"))
    return sums.select(*keys, (F.col("_top") + F.log("_sum")).alias(out))


def matmul_log(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, x) of log(exp A exp B); A is (i, k, x), B (k, j, x), all logarithms."""
    terms = a.select("i", "k", F.col("x").alias("xa")).join(b.select("k", "j", F.col("x").alias("xb")), "k")
    return logsumexp_by(terms.select("i", "j", (F.col("xa") + F.col("xb")).alias("x")), ["i", "j"], "x", "x")


def matmul_loga_b(a: DataFrame, b: DataFrame) -> DataFrame:
    """As matmul_log, B being probabilities."""
    return matmul_log(a, b.withColumn("x", log(F.col("x"))))


def matmul_a_logb(a: DataFrame, b: DataFrame) -> DataFrame:
    """As matmul_log, A being probabilities."""
    return matmul_log(a.withColumn("x", log(F.col("x"))), b)


def to_edges(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(src, cls, dst, i, x): every edge takes its target state's weights (state, i, x)."""
    return edges.join(weights.withColumnRenamed("state", "dst"), "dst").select("src", "cls", "dst", "i", "x")


def from_edges(weights: DataFrame) -> DataFrame:
    """(state, i, x): logsumexp of the edges that leave a state."""
    return logsumexp_by(weights.withColumnRenamed("src", "state"), ["state", "i"], "x", "x")
