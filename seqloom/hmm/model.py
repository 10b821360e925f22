"""Models: probabilities on the driver, tables for Spark.

Sizes: parameters travel to the executors, so their bytes are checked (some 4,000
hidden states with as many tokens); work on a token takes a product with the
transition matrix.  Token ids run from 0; null or -1 is a missing token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of parameters that may travel with a task.
LARGEST = 256 << 20
#: Stands for the logarithm of 0.
LOG_ZERO = -1e30


@dataclass(frozen=True)
class Hmm:
    """``start`` (H), ``move`` (H, H) and ``emit`` (H, V): probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def __post_init__(self) -> None:
        h = len(self.start)
        if self.move.shape != (h, h) or self.emit.shape[0] != h:
            raise ValueError("start, move and emit don't fit together")
        for rows in (self.start[None, :], self.move, self.emit):
            if (rows < 0).any() or not np.allclose(rows.sum(1), 1):
                raise ValueError("rows have to be probabilities that sum to 1")
        if 8 * (self.move.size + self.emit.size) > LARGEST:
            raise ValueError("the model is too large to travel with each task")

    @property
    def states(self) -> int:
        return len(self.start)

    @property
    def tokens(self) -> int:
        return self.emit.shape[1]

    @staticmethod
    def random(states: int, tokens: int, seed: int = 0) -> Hmm:
        rng = np.random.default_rng(seed)
        soft = lambda *shape: (x := np.exp(rng.normal(size=shape))) / x.sum(-1, keepdims=True)
        return Hmm(soft(states), soft(states, states), soft(states, tokens))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """hmm_gamma (i, logp), hmm_alpha (i, j, p), hmm_beta (i, token, logp), hmm_meta."""
        log = lambda p: float(np.log(p)) if p > 0 else LOG_ZERO
        h, v = self.states, self.tokens
        return {
            "hmm_gamma": spark.createDataFrame([(i, log(self.start[i])) for i in range(h)], "i int, logp double"),
            "hmm_alpha": spark.createDataFrame([(i, j, float(self.move[i, j])) for i in range(h) for j in range(h)], "i int, j int, p double"),
            "hmm_beta": spark.createDataFrame([(i, w, log(self.emit[i, w])) for i in range(h) for w in range(v)], "i int, token int, logp double"),
            "hmm_meta": spark.createDataFrame([(h, v)], "hidden_states int, vocab_size int"),
        }

    @staticmethod
    def from_tables(tables: dict[str, DataFrame]) -> Hmm:
        h, v = tables["hmm_meta"].select("hidden_states", "vocab_size").first()
        start, move, emit = np.zeros(h), np.zeros((h, h)), np.zeros((h, v))
        for i, x in tables["hmm_gamma"].select("i", "logp").collect():
            start[i] = np.exp(x)
        for i, j, p in tables["hmm_alpha"].select("i", "j", "p").collect():
            move[i, j] = p
        for i, w, x in tables["hmm_beta"].select("i", "token", "logp").collect():
            emit[i, w] = np.exp(x)
        return Hmm(start, move, emit)
