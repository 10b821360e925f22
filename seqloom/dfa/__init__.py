"""Constraints on token sequences: compile, combine, minimise, execute."""

from seqloom.dfa.automaton import Dfa, always, contains, contains_any, reduce_patterns, stop_once, word_count

__all__ = ["Dfa", "always", "contains", "contains_any", "reduce_patterns", "stop_once", "word_count"]
