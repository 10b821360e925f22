"""Evaluating generated outputs: answers, repetition, percentages, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def extract_answers(text: Column, marker: str = "Answer:") -> Column:
    """What follows each marker up to the line's end, stripped, no empty ones;
    white space after the marker may hold line breaks."""
    found = F.regexp_extract_all(text, F.lit(marker + r"[ \t\n\x0B\f\r]*([^\n\r]*)"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda a: a != "")


def adjacent_repeats(values: Column) -> Column:
    """How many elements equal the one before; the count runs over the whole array."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    return F.size(F.filter(pairs, lambda same: same))


def percentage(hits: Column) -> Column:
    return F.avg(hits.cast("double")) * 100


def repeat_table(outputs: DataFrame, threshold: int, keys: list[str]) -> DataFrame:
    """Percentage of outputs (answers array) with more than ``threshold`` repeats."""
    return outputs.groupBy(*keys).agg(percentage(adjacent_repeats(F.col("answers")) > threshold).alias("pct"))


def pivot_percentages(table: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """One row for each ``row``, one column for each given value, 0 where nothing is."""
    wide = table.groupBy(row).pivot(column, values).agg(F.first("pct"))
    return wide.na.fill(0.0)
