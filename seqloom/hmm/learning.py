"""Expectation maximisation: one Spark job a step, parameters on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.hmm.inference import flows, log_likelihood
from seqloom.hmm.model import Hmm
from seqloom.sources.files import append_log


def dropout(tokens: Column, key: Column, stop: int, rate: float, seed: int = 1) -> Column:
    """The last token becomes the stop token in a share ``rate`` of the sequences,
    then any other token becomes missing in the same share, by an arithmetic hash
    of the seed, the key and the place."""
    cut = int(round(rate * 10_000))
    drawn = lambda k: (key * 7919 + k * 104729 + seed * 15485863) % 10_000 < cut
    n = F.size(tokens)
    ended = F.transform(tokens, lambda t, k: F.when((k == n - 1) & drawn(F.lit(-1)), stop).otherwise(t))
    return F.transform(ended, lambda t, k: F.when((t == stop) | ~drawn(k.cast("bigint")), t))


def redistribute(beta: DataFrame, tokens: int, stop: int, floor: float = 1e-7) -> DataFrame:
    """(i, k, mass) without missing tokens: their mass is shared evenly by all
    tokens but the stop token, which has ``floor`` at least."""
    missing = F.coalesce(F.sum(F.when(F.col("k") == tokens, F.col("mass"))).over(Window.partitionBy("i")), F.lit(0.0)) / (tokens - 1)
    shared = beta.withColumn("more", missing).where(F.col("k") < tokens)
    mass = F.when(F.col("k") == stop, F.greatest("mass", F.lit(floor))).otherwise(F.col("mass") + F.col("more"))
    return shared.select("i", "k", mass.alias("mass"))


def normalized(counts: DataFrame, columns: int, pseudocount: float) -> DataFrame:
    """(i, k, p): counts with a share of the pseudocount, rows summing to 1."""
    smoothed = F.col("mass") + pseudocount / columns
    rows = counts.select("i", "k", smoothed.alias("mass"))
    return rows.select("i", "k", (F.col("mass") / F.sum("mass").over(Window.partitionBy("i"))).alias("p"))


def maximize(found: DataFrame, states: int, tokens: int, stop: int, pseudocount: float) -> DataFrame:
    """(kind, i, k, p) from flows; starts have i = 0 and the state as k."""
    part = lambda kind: found.where(F.col("kind") == kind)
    starts = part("gamma").select(F.lit(0).alias("i"), F.col("i").alias("k"), "mass")
    out = normalized(starts, states, pseudocount).select(F.lit("gamma").alias("kind"), "i", "k", "p")
    out = out.union(normalized(part("alpha"), states, pseudocount).select(F.lit("alpha"), "i", "k", "p"))
    return out.union(normalized(redistribute(part("beta"), tokens, stop), tokens, pseudocount).select(F.lit("beta"), "i", "k", "p"))


def step(sequences: DataFrame, hmm: Hmm, stop: int, pseudocount: float = 1e-3) -> Hmm:
    rows = maximize(flows(sequences, hmm), hmm.states, hmm.tokens, stop, pseudocount).collect()
    start, move, emit = np.zeros(hmm.states), np.zeros_like(hmm.move), np.zeros_like(hmm.emit)
    for kind, i, k, p in rows:
        if kind == "gamma":
            start[k] = p
        else:
            (move if kind == "alpha" else emit)[i, k] = p
    return Hmm(start, move, emit)


def schedule(text: str, chunks: int) -> list[list[int]]:
    """"n,c;n,c": n steps over c chunks each; chunks follow round the whole set."""
    out, at = [], 0
    for part in text.split(";"):
        n, c = map(int, part.split(","))
        if c > chunks:
            raise ValueError("a step can't have more chunks than there are")
        for _ in range(n):
            out.append([(at + k) % chunks for k in range(c)])
            at += c
    return out


def fit(
    sequences: DataFrame, hmm: Hmm, plan: list[list[int]], stop: int, pseudocount: float = 1e-3, dev: DataFrame | None = None, save: Callable[[int, Hmm], None] | None = None, every: int = 1, log_path: str | None = None
) -> tuple[Hmm, list[tuple[int, float]]]:
    """EM over ``sequences`` (chunk, tokens): a filter on the chunk column prunes
    folders.  Returns the model and (step, mean log likelihood of ``dev``).
    ``log_path``: a table to which each step appends step, train_ll and dev_ll, means
    over the step's sequences and over ``dev`` (no number without)."""
    log = []
    mean = lambda df: log_likelihood(df.withColumn("_k", F.lit(0)), hmm, "_k").agg(F.avg("ll")).first()[0]
    for n, chunks in enumerate(plan, 1):
        rows = sequences.where(F.col("chunk").isin(*chunks))
        hmm = step(rows, hmm, stop, pseudocount)
        if dev is not None:
            log.append((n, mean(dev)))
        if log_path:
            train_ll = mean(rows)
            append_log(sequences.sparkSession, log_path, {"step": n, "train_ll": float("nan") if train_ll is None else train_ll, "dev_ll": log[-1][1] if log and log[-1][1] is not None else float("nan")})
        if save and n % every == 0:
            save(n, hmm)
    return hmm, log
