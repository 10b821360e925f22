"""Automaton and model over token streams, one state a key.

Each key holds the automaton's state, the next hidden state's probabilities, the
log likelihood and the number of tokens.  A batch's rows of a key are sorted
before they are read; rows that arrive in a later batch come after those of
earlier ones.  State is kept by Spark's state store and rebuilt from the
checkpoint after a failure; a key that stays silent for ``idle_ms`` is dropped.
``recomputed`` gives the same state from a key's whole prefix, where a state is
lost or was dropped.  Missing and unknown tokens follow the rule in
``seqloom.hmm.batches``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqloom.dfa import Dfa
from seqloom.dfa.execute import last_state
from seqloom.hmm import Hmm
from seqloom.hmm.inference import emissions, fold
from seqloom.hmm.model import LOG_ZERO
from seqloom.sources.files import shared_folder

STATE = "state int, a array<double>, ll double, n long"


def read(dfa: Dfa, hmm: Hmm, tokens: pd.Series, held: tuple | None = None) -> tuple[int, list[float], float, int]:
    """The state after the tokens, from the one held or from the start."""
    state, a, ll, n = held or (0, hmm.start, 0.0, 0)
    a, x = np.asarray(a, float), np.array([-1 if pd.isna(w) else max(-1, int(w)) for w in tokens], np.int64)
    for w, e in zip(x.tolist(), emissions(hmm, x), strict=True):
        state = dfa.next(state, w) if w >= 0 else dfa.step[state][0]
        e = a * e
        total = e.sum()
        ll += float(np.log(total)) if total > 0 else LOG_ZERO
        a = (e / max(total, 1e-300)) @ hmm.move
    return int(state), [float(p) for p in a], float(ll), int(n) + len(x)


def recomputed(df: DataFrame, dfa: Dfa, hmm: Hmm, key: str, token: str, order: list[str]) -> DataFrame:
    """(key, n, state, accepted, ll) from all rows of a key, as ``follow`` has them
    after the last: what a lost state is rebuilt from."""
    held = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(token).alias("token")))).alias("held"))
    tokens = F.transform("held", lambda x: x["token"])
    state = last_state(tokens.cast("array<int>"), dfa)
    return held.select(key, F.size("held").cast("long").alias("n"), state.cast("int").alias("state"), state.isin(*sorted(dfa.accept)).alias("accepted"), fold(tokens, hmm)["ll"].alias("ll"))


def stepper(dfa: Dfa, hmm: Hmm, key: str, token: str, order: list[str], idle_ms: int | None = None):
    """What a batch does with a key's rows and state; a state that timed out goes."""

    def step(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = read(dfa, hmm, pd.concat(list(parts)).sort_values(order)[token], held.get if held.exists else None)
        held.update(state)
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [keys[0]], "n": [state[3]], "state": [state[0]], "accepted": [state[0] in dfa.accept], "ll": [state[2]]})

    return step


def follow(stream: DataFrame, dfa: Dfa, hmm: Hmm, key: str, token: str, order: list[str], idle_ms: int | None = None) -> DataFrame:
    """(key, n, state, accepted, ll) after each batch, for the keys it has."""
    kind = stream.schema[key].dataType.simpleString()
    step = stepper(dfa, hmm, key, token, order, idle_ms)
    out = f"{key} {kind}, n long, state int, accepted boolean, ll double"
    wait = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.select(key, token, *order).groupBy(key).applyInPandasWithState(step, out, STATE, "update", wait)


def drained(spark: SparkSession, updates: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream of updates has written once its source is drained: batches are
    appended to a folder that driver and executors share."""
    path = f"{folder or shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        updates.writeStream.outputMode("update")
        .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out/batch=*")
