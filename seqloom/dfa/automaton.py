"""Automata over token sequences, compiled on the driver.

Tokens with equal transitions share a class; class 0 holds every token that no
constraint names, so vocabularies may be open.  Automata are total: each state
has a successor for each class.  Combining builds only states that can be
reached, and results are minimal and numbered in breadth-first order, so equal
languages over equal classes have equal automata.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

Token = Hashable


@dataclass(frozen=True)
class Dfa:
    """``classes``: token -> class from 1; ``step[state][class]``; start state 0."""

    classes: dict[Token, int]
    step: tuple[tuple[int, ...], ...]
    accept: frozenset[int]

    def __post_init__(self) -> None:
        width = self.width
        if not self.step:
            raise ValueError("an automaton needs a state")
        for row in self.step:
            if len(row) != width or not all(0 <= s < len(self.step) for s in row):
                raise ValueError("every state needs a successor for every class")
        if not all(0 <= s < len(self.step) for s in self.accept):
            raise ValueError("an accepting state doesn't exist")

    @property
    def width(self) -> int:
        return 1 + max(self.classes.values(), default=0)

    def next(self, state: int, token: Token) -> int:
        return self.step[state][self.classes.get(token, 0)]

    def accepts(self, tokens: Iterable[Token]) -> bool:
        return reduce(self.next, tokens, 0) in self.accept

    def edges(self) -> list[tuple[int, int, int]]:
        """(state, class, successor)"""
        return [(s, c, t) for s, row in enumerate(self.step) for c, t in enumerate(row)]

    def size(self) -> tuple[int, int]:
        """States and pairs of states with a transition."""
        return len(self.step), len({(s, t) for s, _, t in self.edges()})

    # combining

    def __and__(self, other: Dfa) -> Dfa:
        return _product(self, other, lambda a, b: a and b)

    def __or__(self, other: Dfa) -> Dfa:
        return _product(self, other, lambda a, b: a or b)

    def __invert__(self) -> Dfa:
        return Dfa(self.classes, self.step, frozenset(range(len(self.step))) - self.accept)

    def then(self, other: Dfa) -> Dfa:
        """The other begins where this one accepts for the first time."""
        classes, pairs = _joint(self, other)
        if 0 in self.accept:
            return _explore(classes, pairs, (1, 0), lambda s, p: (1, other.step[s[1]][p[1]]), lambda s: s[1] in other.accept)

        def move(state: tuple[int, int], pair: tuple[int, int]) -> tuple[int, int]:
            if state[0]:
                return 1, other.step[state[1]][pair[1]]
            after = self.step[state[1]][pair[0]]
            return (1, 0) if after in self.accept else (0, after)

        return _explore(classes, pairs, (0, 0), move, lambda s: bool(s[0]) and s[1] in other.accept)

    # shrinking

    def reachable(self) -> set[int]:
        seen, queue = {0}, deque([0])
        while queue:
            for t in self.step[queue.popleft()]:
                if t not in seen:
                    seen.add(t)
                    queue.append(t)
        return seen

    def live(self) -> set[int]:
        """States from which an accepting one can be reached."""
        back: dict[int, set[int]] = {}
        for s, _, t in self.edges():
            back.setdefault(t, set()).add(s)
        seen, queue = set(self.accept), deque(self.accept)
        while queue:
            for s in back.get(queue.popleft(), ()):
                if s not in seen:
                    seen.add(s)
                    queue.append(s)
        return seen

    def groups(self) -> list[int]:
        """Equivalence classes of states, by refinement of accepting or not."""
        group = [int(s in self.accept) for s in range(len(self.step))]
        while True:
            signs = [(group[s], *(group[t] for t in row)) for s, row in enumerate(self.step)]
            index = {sign: k for k, sign in enumerate(sorted(set(signs)))}
            new = [index[s] for s in signs]
            if len(set(new)) == len(set(group)):
                return new
            group = new

    def minimize(self) -> Dfa:
        group = self.groups()
        first = {g: s for s, g in reversed(list(enumerate(group)))}
        merged = _explore(self.classes, list(range(self.width)), group[0], lambda g, c: group[self.step[first[g]][c]], lambda g: first[g] in self.accept, shrink=False)
        # classes that no state tells apart become one, with class 0 first
        columns = list(zip(*merged.step, strict=True))
        index: dict[tuple[int, ...], int] = {}
        for column in columns:
            index.setdefault(column, len(index))
        classes = {t: index[columns[c]] for t, c in merged.classes.items() if index[columns[c]]}
        used = sorted({0, *classes.values()})
        kept = {c: k for k, c in enumerate(used)}
        by_index = {k: column for column, k in index.items()}
        step = tuple(tuple(by_index[c][s] for c in used) for s in range(len(merged.step)))
        return Dfa({t: kept[c] for t, c in classes.items()}, step, merged.accept)


def _explore(classes, labels, start, move, accepting, shrink: bool = True) -> Dfa:
    index, order, step = {start: 0}, deque([start]), []
    accept = set()
    while order:
        state = order.popleft()
        if accepting(state):
            accept.add(index[state])
        row = []
        for label in labels:
            after = move(state, label)
            if after not in index:
                index[after] = len(index)
                order.append(after)
            row.append(index[after])
        step.append(tuple(row))
    out = Dfa(dict(classes), tuple(step), frozenset(accept))
    return out.minimize() if shrink else out


def _joint(a: Dfa, b: Dfa) -> tuple[dict[Token, int], list[tuple[int, int]]]:
    """Common classes of two automata: a class for each pair of classes in use."""
    pairs = {(0, 0): 0}
    classes = {}
    for token in dict.fromkeys([*a.classes, *b.classes]):
        classes[token] = pairs.setdefault((a.classes.get(token, 0), b.classes.get(token, 0)), len(pairs))
    return {t: c for t, c in classes.items() if c}, list(pairs)


def _product(a: Dfa, b: Dfa, both) -> Dfa:
    classes, pairs = _joint(a, b)
    return _explore(classes, pairs, (0, 0), lambda s, p: (a.step[s[0]][p[0]], b.step[s[1]][p[1]]), lambda s: both(s[0] in a.accept, s[1] in b.accept))


# builders


def always() -> Dfa:
    return Dfa({}, ((0,),), frozenset([0]))


def contains(pattern: Sequence[Token]) -> Dfa:
    """Sequences that hold the pattern as a run."""
    return contains_any([pattern])


def _part_of(small: Sequence[Token], large: Sequence[Token]) -> bool:
    n = len(small)
    return any(tuple(large[k : k + n]) == tuple(small) for k in range(len(large) - n + 1))


def reduce_patterns(patterns: Iterable[Sequence[Token]]) -> list[tuple[Token, ...]]:
    """Distinct patterns without those that hold another, token by token."""
    own = list(dict.fromkeys(map(tuple, patterns)))
    return [p for p in own if not any(q != p and _part_of(q, p) for q in own)]


def contains_any(patterns: Iterable[Sequence[Token]]) -> Dfa:
    """Sequences that hold one of the patterns: a trie with failure links, made
    total; a pattern's end absorbs."""
    own = reduce_patterns(patterns)
    if not own or not all(own):
        raise ValueError("patterns are needed, none of them empty")
    tokens = list(dict.fromkeys(t for p in own for t in p))
    classes = {t: k + 1 for k, t in enumerate(tokens)}
    trie: list[dict[Token, int]] = [{}]
    ends = set()
    for pattern in own:
        node = 0
        for token in pattern:
            if token not in trie[node]:
                trie[node][token] = len(trie)
                trie.append({})
            node = trie[node][token]
        ends.add(node)
    step: list[list[int]] = [[0] * (len(tokens) + 1) for _ in trie]
    queue, fail = deque([0]), [0] * len(trie)
    while queue:
        node = queue.popleft()
        for token in tokens:
            c = classes[token]
            if token in trie[node]:
                child = trie[node][token]
                fail[child] = step[fail[node]][c] if node else 0
                step[node][c] = child
                queue.append(child)
            else:
                step[node][c] = step[fail[node]][c] if node else 0
    for node in ends:
        step[node] = [node] * (len(tokens) + 1)
    return Dfa(classes, tuple(map(tuple, step)), frozenset(ends)).minimize()


def stop_once(stop: Token) -> Dfa:
    """After the stop token only stop tokens follow."""
    return Dfa({stop: 1}, ((0, 1), (2, 1), (2, 2)), frozenset([0, 1]))


def word_count(kinds: dict[Token, tuple[bool, bool]], least: int, most: int) -> Dfa:
    """Sequences of ``least`` to ``most`` words.  ``kinds``: whether a token
    begins with a separator, and whether it has a letter or digit; unknown tokens
    have neither.  A token counts at most one word."""
    if not 0 <= least <= most:
        raise ValueError("0 <= least <= most is needed")
    number = {(False, False): 0, (False, True): 1, (True, False): 2, (True, True): 3}
    classes = {t: number[k] for t, k in kinds.items() if number[k]}
    labels = range(1 + max(classes.values(), default=0))

    def move(state: tuple[int, bool], c: int) -> tuple[int, bool]:
        words, boundary = state
        if words > most:
            return most + 1, False
        separated, wordy = c >= 2, c % 2 == 1
        begins = wordy and (boundary or separated)
        if begins:
            words += 1
        return (words, not wordy and (boundary or separated)) if words <= most else (most + 1, False)

    return _explore(classes, list(labels), (0, True), move, lambda s: least <= s[0] <= most)
