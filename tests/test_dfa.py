from itertools import product

import pytest

from seqloom.dfa import Dfa, always, contains, contains_any, reduce_patterns, stop_once, word_count

STRINGS = [s for n in range(7) for s in product((0, 1, 2), repeat=n)]


def has(s, p):
    return any(s[k : k + len(p)] == tuple(p) for k in range(len(s) - len(p) + 1))


SAMPLES = [always(), contains([1, 2]), contains([0, 0, 1]), contains_any([[1], [2, 0]]), stop_once(2), ~contains([2]), word_count({0: (True, True), 1: (False, True), 2: (True, False)}, 1, 2)]


@pytest.mark.parametrize("pattern", [[1], [1, 2], [0, 1, 0], [1, 1, 1], [0, 1, 0, 1]])
def test_contains_is_naive_search(pattern):
    dfa = contains(pattern)
    assert all(dfa.accepts(s) == has(s, pattern) for s in STRINGS)
    assert len(dfa.step) == len(pattern) + 1


def test_contains_any():
    patterns = [[1, 2], [0, 1, 2], [2, 2, 0], [0, 0]]
    dfa = contains_any(patterns)
    assert all(dfa.accepts(s) == any(has(s, p) for p in patterns) for s in STRINGS)
    assert reduce_patterns([[1, 2], [0, 1, 2]]) == [(1, 2)]
    assert reduce_patterns([[1], [11, 2]]) == [(1,), (11, 2)]
    for bad in ([], [[]], [[1], []]):
        with pytest.raises(ValueError):
            contains_any(bad)


def test_laws():
    for a in SAMPLES:
        assert all((~~a).accepts(s) == a.accepts(s) != (~a).accepts(s) for s in STRINGS)
        assert all(a.minimize().accepts(s) == a.accepts(s) for s in STRINGS)
        for b in SAMPLES:
            both, either = a & b, a | b
            morgan = ~(~a | ~b)
            for s in STRINGS:
                x, y = a.accepts(s), b.accepts(s)
                assert both.accepts(s) == (x and y) == morgan.accepts(s) and either.accepts(s) == (x or y)


def test_then_begins_at_the_first_acceptance():
    for a in SAMPLES:
        for b in SAMPLES:
            dfa = a.then(b)
            for s in STRINGS[:400]:
                first = next((k for k in range(len(s) + 1) if a.accepts(s[:k])), None)
                assert dfa.accepts(s) == (first is not None and b.accepts(s[first:]))


def test_hand_cases():
    assert [contains([1, 2]).accepts(s) for s in ([0, 1, 2], [1, 1, 2], [1, 0, 2], [])] == [True, True, False, False]
    assert [stop_once(3).accepts(s) for s in ([1, 3, 3], [1, 3, 1], [])] == [True, False, True]
    never = contains([1]) & ~contains([1])
    assert not never.accept and len(never.step) == 1
    assert [contains([1]).then(contains([2])).accepts(s) for s in ([1, 2], [2, 1], [2, 1, 0, 2])] == [True, False, True]


def test_word_count_by_a_plain_loop():
    kinds = {0: (True, True), 1: (False, True), 2: (True, False), 3: (False, False)}
    for least, most in ((0, 0), (1, 1), (1, 3), (2, 2)):
        dfa = word_count(kinds, least, most)
        for s in (t for n in range(6) for t in product(range(4), repeat=n)):
            words, boundary = 0, True
            for t in s:
                separated, wordy = kinds[t]
                words += wordy and (boundary or separated)
                boundary = not wordy and (boundary or separated)
            assert dfa.accepts(s) == (least <= words <= most)
    assert word_count({10: (True, True), 11: (False, True), 12: (True, False)}, 2, 2).accepts([10, 11, 12, 11])


def test_minimal_automata_are_canonical():
    assert (contains([1]) | contains([1, 2])) == contains([1])
    assert (contains([1]) & always()).step == contains([1]).step
    with pytest.raises(ValueError):
        Dfa({1: 1}, ((0,),), frozenset())


def test_state_sets():
    dfa = Dfa({1: 1}, ((1, 0), (2, 2), (2, 2), (0, 3)), frozenset([1]))
    assert dfa.reachable() == {0, 1, 2} and dfa.live() == {0, 1, 3}
    assert (stop_once(1) & contains([1])).size()[0] == 3
