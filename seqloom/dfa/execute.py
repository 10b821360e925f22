"""Automata as Spark columns: one fold over the tokens, no Python on executors.

Several predicates on one column are first combined into one automaton, so the
tokens are folded once.  A plain "contains" on text becomes Spark's own
``contains``, which readers and generated code know.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.dfa.automaton import Dfa

#: Entries of a transition table that go into an expression; beyond, use joins.
LITERAL_ENTRIES = 50_000


def _array(values) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def classes_of(tokens: Column, dfa: Dfa) -> Column:
    """The classes of an array of tokens."""
    if not dfa.classes:
        return F.transform(tokens, lambda _: F.lit(0))
    named = F.create_map(*[F.lit(x) for t, c in dfa.classes.items() for x in (t, c)])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(named, t), F.lit(0)))


def last_state(tokens: Column, dfa: Dfa, start: Column | None = None) -> Column:
    """The state after the tokens; null for null tokens."""
    if len(dfa.step) * dfa.width > LITERAL_ENTRIES:
        raise ValueError("too large for an expression; fold by joins with edge_table()")
    flat, width = _array(x for row in dfa.step for x in row), dfa.width
    begin = F.lit(0) if start is None else start
    return F.aggregate(classes_of(tokens, dfa), begin, lambda s, c: F.element_at(flat, s * width + c + 1))


def matches(tokens: Column, *constraints: Dfa) -> Column:
    """Whether the tokens satisfy all constraints (combined into one)."""
    dfa = reduce(lambda a, b: a & b, constraints)
    if len(dfa.accept) == len(dfa.step):
        return tokens.isNotNull()
    if not dfa.accept:
        return F.when(tokens.isNotNull(), False)
    return last_state(tokens, dfa).isin(*sorted(dfa.accept))


def contains_text(text: Column, phrase: str) -> Column:
    """A phrase of words, bounded by blanks, newlines or the ends."""
    return F.concat(F.lit(" "), F.translate(text, "\n", " "), F.lit(" ")).contains(f" {phrase} ")


def edge_table(spark: SparkSession, dfa: Dfa) -> DataFrame:
    return spark.createDataFrame(dfa.edges(), "src int, cls int, dst int")


def state_table(spark: SparkSession, dfa: Dfa) -> DataFrame:
    return spark.createDataFrame([(s, s == 0, s in dfa.accept) for s in range(len(dfa.step))], "state int, is_initial boolean, is_accept boolean")


def class_table(spark: SparkSession, dfa: Dfa) -> DataFrame:
    """Token classes of named tokens (as text)."""
    return spark.createDataFrame([(str(t), c) for t, c in dfa.classes.items()], "token string, cls int")
