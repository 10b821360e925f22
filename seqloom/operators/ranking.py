"""Trimming, scoring and ranking generated sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip_stop(tokens: Column, stop: int) -> Column:
    """Without the stop tokens at the end; all stop tokens give an empty array."""
    kept = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda k: F.element_at(tokens, k) != stop)
    return F.when(F.size(tokens) == 0, tokens).otherwise(F.slice(tokens, 1, F.coalesce(F.array_max(kept), F.lit(0))))


def generated(tokens: Column, prompt: Column, suffix: Column, stop: int) -> Column:
    """What was generated: stop tokens at the end go, then the prompt by its
    length, then the longest beginning of the suffix that the rest ends in."""
    whole, tail = strip_stop(tokens, stop), strip_stop(suffix, stop)
    rest = F.slice(whole, F.size(prompt) + 1, F.greatest(F.size(whole) - F.size(prompt), F.lit(0)))

    def cut(rest: Column) -> Column:
        n = F.size(rest)
        longest = F.least(n, F.size(tail))
        fits = F.filter(F.sequence(F.lit(0), longest), lambda k: F.slice(rest, n - k + 1, k) == F.slice(tail, 1, k))
        return F.slice(rest, 1, n - F.array_max(fits))

    return F.element_at(F.transform(F.array(rest), cut), 1)


def score(logp: DataFrame, key: str, penalty: float = 1.0, suffix_only: bool = False, cap: int | None = None) -> DataFrame:
    """(key, score): the sum of log probabilities of the generated part and the
    suffix, or of the suffix alone (its first ``cap``), over their number to the
    power ``penalty``.  Rows: pos, part, logp, nth (place within its part, from
    1).  The prompt and place 0 never count; nothing to count gives null."""
    counts = F.col("part").isin("suffix") if suffix_only else F.col("part").isin("generated", "suffix")
    if cap is not None:
        counts = counts & ((F.col("part") != "suffix") | (F.col("nth") <= cap))
    counts = counts & (F.col("pos") > 0)
    n = F.sum(counts.cast("int"))
    total = F.sum(F.when(counts, F.col("logp")))
    return logp.groupBy(key).agg(F.when(n > 0, total / F.pow(n, F.lit(penalty))).alias("score"))


def top(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The best k rows of each group with their rank."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def two_stage(df: DataFrame, group: str, first: str, second: str, tie: str, k: int) -> DataFrame:
    """The best k by the first score, ranked by the second."""
    kept = top(df, group, first, tie, k).drop("rank")
    order = Window.partitionBy(group).orderBy(F.col(second).desc_nulls_last(), tie)
    return kept.withColumn("rank", F.row_number().over(order))
