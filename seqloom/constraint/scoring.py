"""Constrained scoring: a hidden Markov model times an automaton.

A constraint asks that ``least`` to ``most`` tokens follow a prefix, that prefix
and these together are accepted, and that the suffix comes next.  Compiling it
sums emission probabilities by token class, then goes back from the suffix one
token at a time; the tables are small (lengths x states x hidden states) and
travel with the tasks.  Without a suffix nothing marks the end: a suffix should
end in the stop token.  If nothing can satisfy the constraint, it says so.

Rows of a batch are read side by side, token by token.  Missing and unknown tokens
follow the rule in ``seqloom.hmm.batches``: summed over by the model, read as a
token that no constraint names by the automaton; after a token beyond the
vocabulary every probability is 0.  Null tokens are empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.dfa import Dfa
from seqloom.dfa.execute import matches
from seqloom.hmm import Hmm
from seqloom.hmm.batches import grouped
from seqloom.hmm.inference import emissions


@dataclass(frozen=True)
class Constraint:
    dfa: Dfa
    hmm: Hmm
    least: int
    most: int
    suffix: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if not 0 <= self.least <= self.most:
            raise ValueError("0 <= least <= most is needed")

    def suffix_costs(self) -> np.ndarray:
        """(len + 1, H): P(suffix from t on | state at its first token)."""
        b = [np.ones(self.hmm.states)]
        for k, w in enumerate(reversed(self.suffix)):
            b.append(self.hmm.emit[:, w] * (self.hmm.move @ b[-1] if k else 1.0))
        return np.array(b[::-1])

    def class_weights(self) -> np.ndarray:
        """(classes, H): emission probability summed over a class's tokens."""
        out = np.zeros((self.dfa.width, self.hmm.states))
        for w in range(self.hmm.tokens):
            out[self.dfa.classes.get(w, 0)] += self.hmm.emit[:, w]
        return out

    def from_first(self) -> np.ndarray:
        """F[t, q, i] for t = 0..most: P(t more tokens lead from automaton state q
        to acceptance and the suffix follows | hidden state i at the first of them)."""
        s, h, weights = len(self.dfa.step), self.hmm.states, self.class_weights()
        out = np.zeros((self.most + 1, s, h))
        for q in self.dfa.accept:
            out[0, q] = self.suffix_costs()[0]
        for t in range(1, self.most + 1):
            for q in range(s):
                out[t, q] = sum(weights[c] * (self.hmm.move @ out[t - 1, self.dfa.step[q][c]]) for c in range(self.dfa.width))
        return out

    def completions(self) -> np.ndarray:
        """C[t, q, i]: as above, given hidden state i at the token before."""
        return self.from_first() @ self.hmm.move.T

    def ranges(self) -> list[tuple[int, int]]:
        """(lo, hi) of tokens that may follow the next one, after n = 0.. tokens."""
        return [(max(1, self.least - n) - 1, self.most - n - 1) for n in range(self.most)]

    def range_sums(self) -> np.ndarray:
        """(n, q, i): completions summed over the range after n tokens."""
        c = self.completions()
        return np.array([c[lo : hi + 1].sum(0) for lo, hi in self.ranges()]).reshape(-1, *c.shape[1:])

    def overlaps(self, tokens: list[int]) -> list[int]:
        """Lengths of the suffix's beginning that the tokens may already end in."""
        out = []
        for s in range(min(len(tokens), len(self.suffix)) + 1):
            before = tokens[: len(tokens) - s]
            if tuple(tokens[len(before) :]) == tuple(self.suffix[:s]) and self.least <= len(before) <= self.most and self.dfa.accepts(before):
                out.append(s)
        return out

    def read(self, a: np.ndarray, q: np.ndarray, x: np.ndarray, n: np.ndarray, back: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The next hidden state's probabilities after the rows' first ``n`` tokens,
        from those before, and the automaton's states (back + 1, rows) there and up
        to ``back`` tokens earlier (-1: before the first)."""
        table = np.array(self.dfa.step)
        most = max([self.hmm.tokens - 1, *(t for t in self.dfa.classes if isinstance(t, int))])
        classes = np.array([self.dfa.classes.get(t, 0) for t in range(most + 1)] + [0])
        before = np.full((back + 1, len(n)), -1)
        for t in range(x.shape[1] + 1):
            here = np.flatnonzero((n >= t) & (n - t <= back))
            before[n[here] - t, here] = q[here]
            if t == x.shape[1]:
                break
            e = a * emissions(self.hmm, x[:, t])
            after = (e / np.maximum(e.sum(1), 1e-300)[:, None]) @ self.hmm.move
            there = n > t
            a = np.where(there[:, None], after, a)
            known = (x[:, t] >= 0) & (x[:, t] <= most)
            q = np.where(there, table[q, classes[np.where(known, x[:, t], most + 1)]], q)
        return a, before

    def next(self, prefix: list[int], tokens: list[int], sums: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(w and the constraint | prefix, tokens), P(w | prefix, tokens) for every w."""
        x = np.array([prefix], np.int64).reshape(1, -1)
        a, _ = self.read(self.hmm.start[None, :], np.zeros(1, np.int64), x, np.array([x.shape[1]]))
        num, den = self.after(a, [tokens], sums, costs)
        return num[0], den[0]

    def after(self, a: np.ndarray, tokens: list[list[int]], sums: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``next`` for many rows: ``a`` holds what their prefixes leave."""
        n = np.array([len(t) for t in tokens], np.int64)
        x, goal = np.full((len(n), max(1, int(n.max(initial=0)))), -1, np.int64), len(self.suffix)
        for k, t in enumerate(tokens):
            x[k, : n[k]] = [-1 if w is None else w for w in t]
        a, before = self.read(a, np.zeros(len(n), np.int64), x, n, goal)
        q = before[0]
        held, num = a[:, :, None] * self.hmm.emit, np.zeros((len(n), self.hmm.tokens))
        for w in range(self.hmm.tokens):
            then = np.array([self.dfa.next(s, w) for s in range(len(self.dfa.step))])[q]
            open_ = n < self.most
            num[open_, w] = np.einsum("ri,ri->r", held[open_, :, w], sums[n[open_], then[open_]])
        for s in range(goal):
            # rows that may already end in the suffix's first s tokens
            ends = np.isin(before[s], list(self.dfa.accept)) & (n - s >= self.least) & (n - s <= self.most)
            for k in range(s):
                ends &= x[np.arange(len(n)), np.maximum(n - s + k, 0)] == self.suffix[k]
            num[ends, self.suffix[s]] += a[ends] @ costs[s]
        return num, held.sum(1)


def satisfaction(df: DataFrame, constraint: Constraint, key: str, tokens: str = "tokens", least: str | None = None, most: str | None = None) -> DataFrame:
    """(key, p, feasible): P(the constraint is met by least..most tokens after
    ``tokens`` | tokens), the tokens being read by model and automaton alike.
    ``least`` and ``most`` name columns with a range for each row, within 0 and the
    constraint's ``most``; null takes the constraint's own."""
    upto = np.concatenate([np.zeros((1, len(constraint.dfa.step), constraint.hmm.states)), np.cumsum(constraint.from_first(), 0)])
    hmm, kind = constraint.hmm, df.schema[key].dataType.simpleString()
    bound = lambda name, own: (F.lit(own) if name is None else F.coalesce(F.col(name), F.lit(own))).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, lo, hi = np.zeros(b.num_rows), b.column(2).to_numpy(), b.column(3).to_numpy()
            if ((lo < 0) | (hi > constraint.most)).any():
                raise ValueError(f"ranges have to lie between 0 and {constraint.most}")
            for rows, x, n in grouped(b.column(1), hmm.states):
                a, q = constraint.read(np.tile(hmm.start, (len(rows), 1)), np.zeros(len(rows), np.int64), x, n)
                q = q[0]
                some = np.maximum(upto[hi[rows] + 1, q] - upto[np.minimum(lo[rows], hi[rows] + 1), q], 0)
                p[rows] = (a * some).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p > 0)], [key, "p", "feasible"])

    return df.select(key, tokens, bound(least, constraint.least), bound(most, constraint.most)).mapInArrow(run, f"{key} {kind}, p double, feasible boolean")


def next_tokens(df: DataFrame, constraint: Constraint, key: str, prefix: str = "prefix", tokens: str = "tokens", step: int = 1024) -> DataFrame:
    """(key, token, num, den); ``step`` rows are looked at together."""
    sums, costs, kind = constraint.range_sums(), constraint.suffix_costs(), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = constraint.hmm.tokens
        for whole in batches:
            for b in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                a = np.zeros((b.num_rows, constraint.hmm.states))
                for rows, x, n in grouped(b.column(1), constraint.hmm.states):
                    a[rows], _ = constraint.read(np.tile(constraint.hmm.start, (len(rows), 1)), np.zeros(len(rows), np.int64), x, n)
                num, den = constraint.after(a, [t or [] for t in b.column(2).to_pylist()], sums, costs)
                keys = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), v)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(v, dtype=np.int32), b.num_rows)), pa.array(num.ravel()), pa.array(den.ravel())], [key, "token", "num", "den"])

    return df.select(key, prefix, tokens).mapInArrow(run, f"{key} {kind}, token int, num double, den double")


def overlaps(tokens: Column, suffix: tuple[int, ...], dfa: Dfa, least: int) -> Column:
    """Lengths s of the suffix's beginning that the tokens may already end in: the
    automaton accepts what stands before, which has ``least`` tokens or more."""
    whole = F.array(*map(F.lit, suffix))
    n = F.size(tokens)
    lengths = F.sequence(F.lit(0), F.least(n, F.lit(len(suffix))))
    return F.filter(lengths, lambda s: (F.slice(tokens, n - s + 1, s) == F.slice(whole, 1, s)) & (n - s >= least) & matches(F.slice(tokens, 1, n - s), dfa))


def reweight(scores: DataFrame, key: str, alpha: float = 1.0, temperature: float = 1.0, ended: Column | None = None) -> DataFrame:
    """(key, token, logp): base scores (logit) made probabilities, shifted by
    alpha (log num - log den), and made probabilities again, before and after the
    temperature.  Ended rows take the temperature alone; tokens that cannot lead
    on are banned, and so are those without ``num`` and ``den``, which the model
    doesn't know; ``feasible`` tells rows in which none can."""
    of = Window.partitionBy(key)

    def normal(x: Column) -> Column:
        top = F.max(x).over(of)
        return x - top - F.log(F.sum(F.exp(x - top)).over(of))

    logs = lambda p: F.when(p > 0, F.log(p)).otherwise(F.lit(-1e30))
    shift = F.when(F.col("num") > 0, logs(F.col("num")) - logs(F.col("den"))).otherwise(F.lit(-1e30))
    df = scores.withColumn("_base", normal(F.col("logit")))
    df = df.withColumn("_shift", F.lit(alpha) * shift)
    stays = ended if ended is not None else F.lit(False)
    df = df.withColumn("_x", F.when(stays, F.col("_base")).otherwise(F.col("_base") + F.col("_shift")))
    df = df.withColumn("_x", normal(F.col("_x")) / F.lit(temperature))
    return df.select(key, "token", normal(F.col("_x")).alias("logp"), F.coalesce(F.max("num").over(of) > 0, F.lit(False)).alias("feasible"))


def decode(df: DataFrame, constraint: Constraint, key: str, prefix: str = "prefix", beam: int = 1) -> DataFrame:
    """(key, tokens, logp): beam search of most + suffix tokens over the model
    itself, each next token weighed by its probability given the constraint.
    Null where the constraint cannot be met."""
    sums, costs, kind = constraint.range_sums(), constraint.suffix_costs(), df.schema[key].dataType.simpleString()
    goal, hmm = len(constraint.suffix), constraint.hmm

    def search(a: np.ndarray) -> tuple[list[int] | None, float | None]:
        beams, done = [([], 0.0)], []
        for _ in range(constraint.most + goal):
            nums, _ = constraint.after(np.tile(a, (len(beams), 1)), [t for t, _ in beams], sums, costs)
            grown = []
            for (tokens, lp), num in zip(beams, nums, strict=True):
                if (total := num.sum()) > 0:
                    grown += [([*tokens, w], lp + float(np.log(num[w] / total))) for w in np.flatnonzero(num).tolist()]
            grown.sort(key=lambda x: (-x[1], x[0]))
            beams = grown[:beam]
            done += [x for x in beams if goal in constraint.overlaps(x[0])] if goal else []
            if not beams or len(done) >= beam:
                break
        if not goal:
            done = [x for x in beams if constraint.dfa.accepts(x[0])]
        return min(done, key=lambda x: (-x[1], x[0])) if done else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None] * b.num_rows
            for rows, x, n in grouped(b.column(1), hmm.states):
                a, _ = constraint.read(np.tile(hmm.start, (len(rows), 1)), np.zeros(len(rows), np.int64), x, n)
                for k, r in enumerate(rows.tolist()):
                    found[r] = search(a[k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.float64())], [key, "tokens", "logp"])

    return df.select(key, prefix).mapInArrow(run, f"{key} {kind}, tokens array<int>, logp double")
