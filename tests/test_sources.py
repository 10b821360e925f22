import numpy as np
import pandas as pd
import pytest

from seqloom.dfa import contains, graph
from seqloom.hmm import Hmm
from seqloom.sources import files, safetensors
from seqloom.streaming import stateful


def test_tensor_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    tensors = {"a": rng.normal(size=(5, 3)).astype(np.float32), "b": np.arange(4), "c": np.array([[True, False]]), "d": rng.normal(size=(2, 2, 2)).astype(np.float16)}
    data = safetensors.encode(tensors)
    assert {k: v.tolist() for k, v in safetensors.parse(data).items()} == {k: v.tolist() for k, v in tensors.items()}
    (tmp_path / "x.safetensors").write_bytes(data)
    rows = sorted(safetensors.read(spark, str(tmp_path), batch=2).collect())
    assert [(r.tensor, r.at) for r in rows] == [*(("a", k) for k in range(5)), ("b", 0), ("c", 0), *(("d", k) for k in range(4))]
    assert [r.x for r in rows if r.tensor == "a"] == tensors["a"].astype(float).tolist()
    made = spark.createDataFrame([(k, p, [float(k), p / 2]) for k in (1, 2) for p in (2, 0, 1)], "k int, pos int, x array<double>")
    for r in safetensors.encoded(made, "k", "pos", "x").collect():
        assert safetensors.parse(bytes(r.content))["embeddings"].tolist() == [[r.k, p / 2] for p in range(3)]


def test_half_numbers_of_sixteen_bits():
    raw = (np.array([1.5, -2.0], np.float32).view(np.uint32) >> 16).astype("<u2").tobytes()
    header = b'{"t":{"dtype":"BF16","shape":[2],"data_offsets":[0,4]}}'
    assert safetensors.parse(len(header).to_bytes(8, "little") + header + raw)["t"].tolist() == [1.5, -2.0]


def test_numbers_of_many_runs(spark):
    values = spark.createDataFrame([(k * 3,) for k in range(100)], "state int")
    assert sorted((r.state, r.n) for r in graph.numbered(values, "state", run=7).collect()) == [(k * 3, k) for k in range(100)]


def test_state_of_a_stream_from_pieces_from_a_whole_and_by_recomputing(spark):
    hmm, dfa = Hmm.random(3, 4, seed=1), contains([1, 2])
    tokens = [0, 1, None, 1, 2, -1, 3, 7, 0]
    whole = stateful.read(dfa, hmm, pd.Series(tokens, dtype="Int64"))
    held = None
    for part in (tokens[:2], tokens[2:5], tokens[5:]):
        held = stateful.read(dfa, hmm, pd.Series(part, dtype="Int64"), held)
    assert held[0] == whole[0] and held[1] == pytest.approx(whole[1]) and held[2:] == whole[2:]
    df = spark.createDataFrame([(5, k, t) for k, t in enumerate(tokens)], "k int, at int, token int")
    (row,) = stateful.recomputed(df, dfa, hmm, "k", "token", ["at"]).collect()
    assert (row.k, row.n, row.state, row.accepted) == (5, len(tokens), whole[0], True) and row.ll == pytest.approx(whole[2])


class Held:
    """A key's state as the step sees it."""

    def __init__(self):
        self.state, self.wait, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.state is not None)
    get = property(lambda self: self.state)

    def update(self, state):
        self.state = state

    def remove(self):
        self.state = None

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_a_key_that_stays_silent_is_dropped_and_starts_anew():
    step, held = stateful.stepper(contains([1]), Hmm.random(2, 3, seed=1), "k", "token", ["at"], idle_ms=1500), Held()
    batch = lambda tokens: list(step((7,), iter([pd.DataFrame({"at": range(len(tokens)), "token": tokens})]), held))
    (out,) = batch([1, 0])
    assert (out.k[0], out.n[0], out.accepted[0]) == (7, 2, True) and held.wait == 1500
    (out,) = batch([0])
    assert (out.n[0], out.accepted[0]) == (3, True)
    held.hasTimedOut = True
    assert list(step((7,), iter([]), held)) == [] and not held.exists
    held.hasTimedOut = False
    (out,) = batch([0])
    assert (out.n[0], out.accepted[0]) == (1, False)


def test_a_log_grows_by_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(3):
        files.append_log(spark, path, {"step": n, "x": n / 2})
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(n, n / 2) for n in range(3)]


def test_what_was_not_generated_is_dropped(spark):
    from seqloom.operators import corpus

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, g string")
    assert sorted(r.k for r in corpus.drop_missing(df, "g").collect()) == [1, 3]
