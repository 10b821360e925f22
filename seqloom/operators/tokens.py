"""Tokens as text: classes, word counts, sets of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.dfa import word_count
from seqloom.dfa.execute import _array

SEPARATORS = (" ", "\n", ",", ".", ":", ";", '"', "/")


def classify(token: Column) -> tuple[Column, Column]:
    """Whether a token begins with a separator, and whether it has a letter or a
    digit.  The empty token has neither."""
    return F.substring(token, 1, 1).isin(*SEPARATORS), token.rlike(r"[\p{L}\p{Nd}]")


def count_words(tokens: Column, least: int, most: int) -> Column:
    """Whether the tokens, each set off by a blank, have ``least`` to ``most``
    words: the word-count automaton, folded over classes found by expressions."""
    dfa = word_count({"start": (True, True), "more": (False, True), "gap": (True, False)}, least, most)
    flat, width = _array(x for row in dfa.step for x in row), dfa.width
    begins, gap = dfa.classes.get("start", 0), dfa.classes.get("gap", 0)
    last = F.aggregate(tokens, F.lit(0), lambda s, t: F.element_at(flat, s * width + F.when(classify(t)[1], begins).otherwise(gap) + 1))
    return last.isin(*sorted(dfa.accept))


def runs_of(pattern: Column, longest: Column) -> Column:
    """All runs of an array of at most ``longest`` elements."""
    return F.flatten(F.transform(F.sequence(F.lit(1), longest), lambda n: F.transform(F.sequence(F.lit(1), F.size(pattern) - n + 1), lambda k: F.slice(pattern, k, n))))


def reduce_pattern_table(patterns: DataFrame) -> DataFrame:
    """(pattern): distinct patterns without those that hold another, by an
    anti join of each pattern's shorter runs with the patterns."""
    own = patterns.select("pattern").distinct()
    runs = own.where(F.size("pattern") > 1).select("pattern", F.explode(runs_of(F.col("pattern"), F.size("pattern") - 1)).alias("run"))
    holding = runs.join(own.select(F.col("pattern").alias("run")), "run", "left_semi").select("pattern").distinct()
    return own.join(holding, "pattern", "left_anti")
