"""Likelihood, prefix states, posteriors and expected counts.

Small models run as a fold in an expression; larger ones and everything that
looks back over a sequence run in NumPy on Arrow batches, sequences of like length
side by side (see ``batches`` for missing and unknown tokens).  Scaling: the vector
over states is normalised at every token and the logarithms of the norms are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.hmm.batches import grouped
from seqloom.hmm.model import LOG_ZERO, Hmm

#: Models up to this many states are folded in an expression.
FOLDED = 8


def _literal(values) -> Column:
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in values) + ")")


def fold(tokens: Column, hmm: Hmm) -> Column:
    """struct(a: array of the next state's probabilities, ll: log likelihood)."""
    h = hmm.states
    emit, move = _literal(hmm.emit.T.ravel()), _literal(hmm.move.T.ravel())
    rows = F.sequence(F.lit(0), F.lit(h - 1))
    known = lambda t: t.isNotNull() & (t >= 0)

    def seen(a: Column, t: Column) -> Column:
        inside = known(t) & (t < hmm.tokens)
        here = F.slice(emit, F.when(inside, t * h).otherwise(0) + 1, h)
        return F.when(inside, F.zip_with(a, here, lambda p, q: p * q)).when(known(t), F.transform(a, lambda p: F.lit(0.0))).otherwise(a)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def go_on(s: Column, e: Column, n: Column) -> Column:
        after = F.transform(rows, lambda j: total(F.zip_with(e, F.slice(move, j * h + 1, h), lambda p, q: p * q)) / F.when(n > 0, n).otherwise(1.0))
        return F.struct(after.alias("a"), (s["ll"] + F.when(n > 0, F.log(n)).otherwise(F.lit(LOG_ZERO))).alias("ll"))

    def step(s: Column, t: Column) -> Column:
        # one-element arrays stand for local names, so nothing is computed twice
        inner = F.transform(F.array(seen(s["a"], t)), lambda e: F.struct(e.alias("e"), total(e).alias("n")))
        return F.element_at(F.transform(inner, lambda x: go_on(s, x["e"], x["n"])), 1)

    first = F.struct(_literal(hmm.start).alias("a"), F.lit(0.0).alias("ll"))
    return F.aggregate(tokens, first, step)


def emissions(hmm: Hmm, w: np.ndarray) -> np.ndarray:
    """(n, H): the probabilities of tokens in each state."""
    out = hmm.emit.T[np.clip(w, 0, hmm.tokens - 1)]
    out[w < 0], out[w >= hmm.tokens] = 1.0, 0.0
    return out


def forward(hmm: Hmm, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Filtered state probabilities at every place, and log likelihoods.  Missing
    tokens at the end change nothing."""
    a, ll, out = np.tile(hmm.start, (len(x), 1)), np.zeros(len(x)), []
    for t in range(x.shape[1]):
        e = a * emissions(hmm, x[:, t])
        n = e.sum(1)
        ll += np.where(n > 0, np.log(np.where(n > 0, n, 1)), LOG_ZERO)
        e /= np.where(n > 0, n, 1)[:, None]
        out.append(e)
        a = e @ hmm.move
    return out, ll


def backward(hmm: Hmm, x: np.ndarray, filtered: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray] | None]]:
    """From the last place: (place, P(state | all tokens), and, but for the last, two
    factors a (n, H) and b (n, H): a[i] move[i, j] b[j] is P(state i, next state j |
    all tokens))."""
    b = np.ones((len(x), hmm.states))
    pair = None
    for t in range(x.shape[1] - 1, -1, -1):
        p = filtered[t] * b
        p /= np.maximum(p.sum(1), 1e-300)[:, None]
        yield t, p, pair
        if t:
            later = emissions(hmm, x[:, t]) * b
            pair = filtered[t - 1] / np.maximum(((filtered[t - 1] @ hmm.move) * later).sum(1), 1e-300)[:, None], later
            b = later @ hmm.move.T
            b /= np.maximum(b.sum(1), 1e-300)[:, None]


def log_likelihood(df: DataFrame, hmm: Hmm, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, ll); an empty sequence has 0, a null one null."""
    if hmm.states <= FOLDED:
        return df.select(key, fold(F.col(tokens), hmm)["ll"].alias("ll"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll = np.zeros(b.num_rows)
            for rows, x, _ in grouped(b.column(1), hmm.states):
                ll[rows] = forward(hmm, x)[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ll, mask=b.column(1).is_null().to_numpy(zero_copy_only=False))], [key, "ll"])

    return df.select(key, tokens).mapInArrow(run, f"{key} {kind}, ll double")


def posterior(df: DataFrame, hmm: Hmm, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, pos, i, p): P(state i at place pos | all tokens); 0 for all states of a
    sequence that the model can't emit."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, x, n in grouped(b.column(1), hmm.states):
                for t, p, _ in backward(hmm, x, forward(hmm, x)[0]):
                    rows = np.flatnonzero(n > t)
                    keys = b.column(0).take(pa.array(np.repeat(group[rows], hmm.states)))
                    states = np.tile(np.arange(hmm.states, dtype=np.int32), len(rows))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(states), t, np.int32)), pa.array(states), pa.array(p[rows].ravel())], [key, "pos", "i", "p"])

    return df.select(key, tokens).mapInArrow(run, f"{key} {kind}, pos int, i int, p double")


def flows(df: DataFrame, hmm: Hmm, tokens: str = "tokens") -> DataFrame:
    """(kind, i, k, mass): expected counts of starts (k null), moves i -> k and
    emissions of token k, k = the vocabulary's size for missing tokens.  A sequence
    that the model can't emit counts nothing.  A task sums its sequences, the
    shuffle only sums tasks."""
    h, v = hmm.states, hmm.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(h), np.zeros((h, h)), np.zeros((v + 1, h))
        for b in batches:
            for _, x, n in grouped(b.column(0), h):
                possible = (x < v).all(1)
                x, n = x[possible], n[possible]
                for t, p, pair in backward(hmm, x, forward(hmm, x)[0]):
                    if pair is not None:
                        # summed over sequences by one product, no table of pairs for each
                        move += hmm.move * (pair[0][n > t + 1].T @ pair[1][n > t + 1])
                    there = n > t
                    np.add.at(emit, np.where(x[there, t] < 0, v, x[there, t]), p[there])
                    if t == 0:
                        start += p[there].sum(0)
        place = lambda a, b: (np.repeat(np.arange(a, dtype=np.int32), b), np.tile(np.arange(b, dtype=np.int32), a))
        parts = [("gamma", np.arange(h, dtype=np.int32), None, start), ("alpha", *place(h, h), move.ravel()), ("beta", *place(h, v + 1), emit.T.ravel())]
        for kind, i, k, mass in parts:
            second = pa.nulls(len(i), pa.int32()) if k is None else pa.array(k)
            whole = pa.RecordBatch.from_arrays([pa.repeat(kind, len(i)), pa.array(i), second, pa.array(mass)], ["kind", "i", "k", "mass"])
            yield from (whole.slice(lo, 1 << 16) for lo in range(0, len(i), 1 << 16))

    return df.select(tokens).mapInArrow(run, "kind string, i int, k int, mass double").groupBy("kind", "i", "k").agg(F.sum("mass").alias("mass"))


def narrowed(p: np.ndarray, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None) -> np.ndarray:
    """Rows of probabilities at a temperature, held to the ``top_k`` largest and to the
    fewest that make up ``top_p``, ties to the smaller token; rows sum to 1."""
    p = (p / np.maximum(p.max(1, keepdims=True), 1e-300)) ** (1 / temperature)
    p /= p.sum(1, keepdims=True)
    if top_k is None and top_p is None:
        return p
    order = np.argsort(-p, axis=1, kind="stable")
    falling = np.take_along_axis(p, order, 1)
    keep = np.ones(p.shape, bool)
    if top_k is not None:
        keep[:, top_k:] = False
    if top_p is not None:
        keep &= np.cumsum(np.where(keep, falling, 0), 1) - falling < top_p * np.where(keep, falling, 0).sum(1, keepdims=True)
    out = np.zeros(p.shape)
    np.put_along_axis(out, order, np.where(keep, falling, 0), 1)
    return out / out.sum(1, keepdims=True)


def sample(
    spark: SparkSession, hmm: Hmm, n: int, length: int, seed: int = 0, stop: int | None = None, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, step: int = 1024
) -> DataFrame:
    """(seq_id, tokens): sequences drawn from the model token by token, filled up with
    the stop token once it is drawn.  A sequence depends on the seed and its id alone;
    ``step`` of them are drawn side by side."""

    def drawn(ids: list[int]) -> np.ndarray:
        u = np.array([np.random.default_rng((seed, k)).random(length) for k in ids]).reshape(len(ids), length)
        a, out, ended = np.tile(hmm.start, (len(ids), 1)), np.zeros((len(ids), length), np.int32), np.zeros(len(ids), bool)
        for t in range(length):
            up = np.cumsum(narrowed(a @ hmm.emit, temperature, top_k, top_p), 1)
            # the first token whose sum is beyond the draw; none has no share of its own
            w = (up <= u[:, t : t + 1] * up[:, -1:]).sum(1)
            if stop is not None:
                w = np.where(ended, stop, w)
                ended |= w == stop
            out[:, t] = w
            e = a * emissions(hmm, w)
            a = (e / np.maximum(e.sum(1), 1e-300)[:, None]) @ hmm.move
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(lo, step) for lo in range(0, whole.num_rows, step)):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(drawn(b.column(0).to_pylist()).tolist(), pa.list_(pa.int32()))], ["seq_id", "tokens"])

    return spark.range(n).withColumnRenamed("id", "seq_id").mapInArrow(run, "seq_id long, tokens array<int>")
