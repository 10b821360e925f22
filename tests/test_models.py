import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.constraint import Constraint, decode, next_tokens, satisfaction
from seqloom.dfa import contains, stop_once
from seqloom.functions import logspace
from seqloom.hmm import Hmm, inference, learning

M = Hmm.random(3, 5, seed=3)
SEQUENCES = [[3, 0, 3], [2, 1, 1, 4, 0], [0, None, 4], [1], [], [None, None]]


def paths(n):
    return itertools.product(range(M.states), repeat=n)


def weight(path, x):
    p = 1.0
    for t, (z, w) in enumerate(zip(path, x)):
        p *= (M.start[z] if t == 0 else M.move[path[t - 1], z]) * (1.0 if w is None else M.emit[z, w])
    return p


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, s) for k, s in enumerate(SEQUENCES)], "k int, tokens array<int>")


def test_likelihood_by_all_paths(rows):
    want = {k: math.log(sum(weight(p, s) for p in paths(len(s)))) for k, s in enumerate(SEQUENCES)}
    for got in (rows.select("k", inference.fold(F.col("tokens"), M)["ll"].alias("ll")), inference.log_likelihood(rows, M, "k")):
        assert {r.k: pytest.approx(r.ll, abs=1e-9) for r in got.collect()} == want
    wide = Hmm.random(12, 5, seed=1)
    folded = {r.k: r.ll for r in rows.select("k", inference.fold(F.col("tokens"), wide)["ll"].alias("ll")).collect()}
    assert {r.k: pytest.approx(r.ll, abs=1e-9) for r in inference.log_likelihood(rows, wide, "k").collect()} == folded


def test_tokens_beyond_the_vocabulary_have_probability_zero(spark):
    df = spark.createDataFrame([(1, [0, 5, 1]), (2, [9]), (3, [0, 1])], "k int, tokens array<int>")
    wide = Hmm.random(12, 5, seed=1)
    for hmm in (M, wide):
        got = {r.k: r.ll for r in inference.log_likelihood(df, hmm, "k").collect()}
        assert got[1] <= -1e30 and got[2] <= -1e30 and got[3] > -100
    assert {r.k for r in inference.posterior(df, M, "k").collect() if r.p == 0} == {1, 2}
    flow = lambda rows: {(r.kind, r.i, r.k): r.mass for r in inference.flows(rows, M).collect()}
    assert flow(df) == pytest.approx(flow(df.where("k = 3")))
    c = Constraint(contains([0]), M, 0, 2)
    assert {r.k: r.feasible for r in satisfaction(df, c, "k").collect()} == {1: False, 2: False, 3: True}
    assert all(r.num == r.den == 0 for r in next_tokens(df.select("k", F.array().cast("array<int>").alias("prefix"), "tokens"), c, "k").where("k < 3").collect())


def test_sequences_of_any_length_are_grouped_within_bounds():
    import pyarrow as pa

    from seqloom.hmm.batches import grouped

    rng = np.random.default_rng(2)
    rows = [None, [], *[rng.integers(0, 5, n).tolist() for n in (3, 20_000, 1, 7, 7)], [None, -3, 2]]
    for cells in (1, 50, 1 << 20):
        seen = {}
        for at, x, n in grouped(pa.array([[0], *rows], pa.list_(pa.int32())).slice(1), 4, cells):
            assert len(at) == 1 or x.size * 4 <= cells
            seen |= {int(r): [None if w < 0 else int(w) for w in x[k, : n[k]]] for k, r in enumerate(at)}
        assert [seen[k] for k in range(len(rows))] == [[None if w is None or w < 0 else w for w in r or []] for r in rows]


def test_one_long_sequence_among_many(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(0, 5, 3).tolist()) for k in range(2000)] + [(9999, rng.integers(0, 5, 20_000).tolist())]
    df, wide = spark.createDataFrame(rows, "k int, tokens array<int>"), Hmm.random(40, 5, seed=2)
    assert inference.posterior(df.coalesce(1), wide, "k").groupBy("k", "pos").agg(F.sum("p").alias("p")).agg(F.min("p"), F.max("p"), F.count("*")).first() == (pytest.approx(1), pytest.approx(1), 26_000)
    starts = inference.flows(df, wide).where("kind = 'gamma'").agg(F.sum("mass")).first()[0]
    assert starts == pytest.approx(2001)


def test_missing_is_the_sum_over_fillings():
    one = lambda s: inference.forward(M, np.array([s]))[1][0]
    assert one([1, -1, 0, 2]) == pytest.approx(math.log(sum(math.exp(one([1, w, 0, 2])) for w in range(5))))


def test_posteriors_and_flows_by_all_paths(rows):
    post, flow = Counter(), Counter()
    for k, s in enumerate(SEQUENCES):
        total = sum(weight(p, s) for p in paths(len(s)))
        for p in paths(len(s)):
            x = weight(p, s) / total
            for t, z in enumerate(p):
                post[k, t, z] += x
                flow["beta", z, 5 if s[t] is None else s[t]] += x
                if t:
                    flow["alpha", p[t - 1], z] += x
            if p:
                flow["gamma", p[0], None] += x
    assert {(r.k, r.pos, r.i): pytest.approx(r.p, abs=1e-9) for r in inference.posterior(rows, M, "k").collect()} == dict(post)
    got = {(r.kind, r.i, r.k): r.mass for r in inference.flows(rows, M).collect()}
    assert all(got[key] == pytest.approx(flow[key], abs=1e-9) for key in got) and set(flow) <= set(got)


def test_em_never_lowers_the_likelihood(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = spark.createDataFrame([(k, k % 4, rng.integers(0, 5, 6).tolist()) for k in range(64)], "k int, chunk int, tokens array<int>")
    hmm, lls = Hmm.random(3, 5, seed=9), []
    for _ in range(4):
        lls.append(inference.log_likelihood(data, hmm, "k").agg(F.sum("ll")).first()[0])
        hmm = learning.step(data, hmm, stop=4, pseudocount=1e-8)
    assert all(b >= a - 1e-6 for a, b in zip(lls, lls[1:]))
    saved, table = [], str(tmp_path / "log")
    fitted, log = learning.fit(data, hmm, learning.schedule("1,2;1,4", 4), 4, dev=data, save=lambda n, m: saved.append(n), every=2, log_path=table)
    rows = sorted(spark.read.parquet(table).select("step", "dev_ll").collect())
    assert [tuple(r) for r in rows] == [(n, pytest.approx(x)) for n, x in log]
    assert saved == [2] and len(log) == 2 and np.allclose(fitted.move.sum(1), 1)


def test_schedule_and_redistribution(spark):
    assert learning.schedule("2,1;1,3", 4) == [[0], [1], [2, 3, 0]]
    with pytest.raises(ValueError):
        learning.schedule("1,5", 4)
    beta = spark.createDataFrame([(0, k, 1.0) for k in range(4)] + [(0, 4, 0.3)], "i int, k int, mass double")
    got = {r.k: r.mass for r in learning.redistribute(beta, 4, 3).collect()}
    assert got == {0: pytest.approx(1.1), 1: pytest.approx(1.1), 2: pytest.approx(1.1), 3: 1.0}


def test_dropout(spark):
    df = spark.range(500).select("id", F.array(*[F.lit(k) for k in (1, 2, 3, 1)]).alias("t"))
    out = [r.t for r in df.select(learning.dropout(F.col("t"), F.col("id"), 3, 0.2).alias("t")).collect()]
    assert all(t[2] == 3 for t in out)
    assert 0.1 < np.mean([t[0] is None for t in out]) < 0.3 and 0.1 < np.mean([t[3] == 3 for t in out]) < 0.3


def test_tables_round_trip(spark):
    again = Hmm.from_tables(M.tables(spark))
    assert np.allclose(again.move, M.move) and np.allclose(again.emit, M.emit) and np.allclose(again.start, M.start)


@pytest.mark.parametrize("suffix", [(), (1, 3), (4,)])
@pytest.mark.parametrize("dfa", [contains([0]), stop_once(2), contains([1, 0]) | contains([3])])
def test_constraint_by_enumeration(spark, dfa, suffix):
    c = Constraint(dfa, M, 2, 4, suffix)
    one = lambda s: math.exp(inference.forward(M, np.array([s]))[1][0]) if s else 1.0
    complete = [g + suffix for n in range(2, 5) for g in itertools.product(range(5), repeat=n) if dfa.accepts(g)]
    prefix = [2, 0]
    for tokens in ([], [0], [1, 3], [0, 1]):
        num, den = c.next(prefix, list(tokens), c.range_sums(), c.suffix_costs())
        base = one([*prefix, *tokens])
        for w in range(5):
            start = (*tokens, w)
            # several readings of one sequence (where the suffix begins) each count
            want = sum(one([*prefix, *s]) for s in complete if s[: len(start)] == start)
            assert num[w] == pytest.approx(want / base, abs=1e-12)
            assert den[w] == pytest.approx(one([*prefix, *start]) / base, abs=1e-12)
    df = spark.createDataFrame([(1, [0]), (2, [])], "k int, tokens array<int>")
    got = {r.k: r.p for r in satisfaction(df, c, "k").collect()}
    for k, tokens in ((1, [0]), (2, [])):
        want = sum(one([*tokens, *g, *suffix]) for n in range(2, 5) for g in itertools.product(range(5), repeat=n) if dfa.accepts([*tokens, *g]))
        assert got[k] == pytest.approx(want / one(tokens), abs=1e-12)


def test_missing_tokens_and_ranges_of_rows(spark):
    c = Constraint(contains([0]), M, 1, 3, (4,))
    one = lambda s: math.exp(inference.forward(M, np.array([s]))[1][0])
    rows = [(1, [0, None, 2], 1, 2), (2, [-1, 1], 0, 3), (3, [0, -1, 2], None, None), (4, None, 2, 2), (5, [1], 3, 1)]
    df = spark.createDataFrame(rows, "k int, tokens array<int>, lo int, hi int")
    got = {r.k: (r.p, r.feasible) for r in satisfaction(df, c, "k", least="lo", most="hi").collect()}
    for k, tokens, lo, hi in rows:
        x = [-1 if w is None else w for w in tokens or []]
        lo, hi = (1 if lo is None else lo), (3 if hi is None else hi)
        want = sum(one([*x, *g, 4]) for n in range(lo, hi + 1) for g in itertools.product(range(5), repeat=n) if c.dfa.accepts([*x, *g])) / (one(x) if x else 1)
        assert got[k] == (pytest.approx(want, abs=1e-12), want > 0)
    with pytest.raises(Exception, match="ranges have to lie"):
        satisfaction(df.withColumn("hi", F.lit(4)), c, "k", most="hi").collect()
    # a missing token is summed over by the model and no constraint's token
    asked = df.select("k", F.lit(None).cast("array<int>").alias("prefix"), "tokens")
    free = {(r.k, r.token): r.den for r in next_tokens(asked, c, "k").collect()}
    assert free[1, 3] == pytest.approx(one([0, -1, 2, 3]) / one([0, -1, 2])) and free == pytest.approx({(k, w): x for (k, w), x in free.items()})


def best_by_search(c, prefix):
    """Every sequence, each token weighed as the decoder does."""
    sums, costs, goal, done = c.range_sums(), c.suffix_costs(), len(c.suffix), []

    def grow(tokens, lp):
        if goal in c.overlaps(tokens):
            done.append((lp, tokens))
        if len(tokens) < c.most + goal:
            num, _ = c.next(prefix, tokens, sums, costs)
            for w in np.flatnonzero(num).tolist():
                grow([*tokens, w], lp + math.log(num[w] / num.sum()))

    grow([], 0.0)
    return min(done, key=lambda x: (-x[0], x[1]))


def test_decode_finds_the_best_of_all_sequences(spark):
    c = Constraint(contains([0]) & contains([3]), M, 1, 3, (4,))
    df = spark.createDataFrame([(1, [2, 0]), (2, []), (3, None), (4, [1, None])], "k int, prefix array<int>")
    for r, prefix in zip(sorted(decode(df, c, "k", beam=600).collect()), ([2, 0], [], [], [1, -1]), strict=True):
        lp, tokens = best_by_search(c, prefix)
        assert r.tokens == tokens and r.logp == pytest.approx(lp)


def test_decode_reports_infeasible(spark):
    c = Constraint(contains([0]) & contains([3]), M, 1, 3, (4,))
    df = spark.createDataFrame([(1, [2, 0]), (2, [])], "k int, prefix array<int>")
    for r in decode(df, c, "k", beam=600).collect():
        body = r.tokens[:-1]
        assert r.tokens[-1] == 4 and c.dfa.accepts(body) and 1 <= len(body) <= 3
    never = Constraint(contains([0]) & ~contains([0]), M, 1, 2, (4,))
    assert all(r.tokens is None for r in decode(df, never, "k").collect())
    assert all(r.num == 0 for r in next_tokens(df.withColumn("tokens", F.array().cast("array<int>")), never, "k").collect())


def test_logspace(spark):
    df = spark.createDataFrame([([-1e30, 0.0, 1.0],), ([700.0, 701.0],)], "x array<double>")
    a, b = [r[0] for r in df.select(logspace.logsumexp(F.col("x"))).collect()]
    assert a == pytest.approx(math.log(1 + math.e)) and b == pytest.approx(701 + math.log(1 + math.exp(-1)))
    assert spark.range(1).select(logspace.log(F.lit(0.0))).first()[0] == -1e30
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "src int, cls int, dst int")
    weights = spark.createDataFrame([(1, 0, -1.0), (2, 0, -2.0)], "state int, i int, x double")
    (row,) = logspace.from_edges(logspace.to_edges(edges, weights)).collect()
    assert (row.state, row.i) == (0, 0) and row.x == pytest.approx(math.log(math.exp(-1) + math.exp(-2)))


def test_sampling_follows_the_model(spark):
    rows = inference.sample(spark, M, 3000, 2, seed=5).collect()
    assert rows == inference.sample(spark, M, 3000, 2, seed=5).collect()
    share = np.bincount([r.tokens[0] for r in rows], minlength=5) / 3000
    assert np.allclose(share, M.start @ M.emit, atol=0.04)
    assert all(4 not in r.tokens or set(r.tokens[r.tokens.index(4) :]) == {4} for r in inference.sample(spark, M, 50, 8, stop=4).collect())


def test_narrowed_probabilities():
    p = np.array([[0.1, 0.4, 0.4, 0.1], [0.7, 0.1, 0.1, 0.1]])
    assert np.allclose(inference.narrowed(p), p)
    assert np.allclose(inference.narrowed(p, top_k=1), [[0, 1, 0, 0], [1, 0, 0, 0]])
    assert np.allclose(inference.narrowed(p, top_p=0.75), [[0, 0.5, 0.5, 0], [0.875, 0.125, 0, 0]])
    assert np.allclose(inference.narrowed(p, temperature=0.5)[1], np.array([0.49, 0.01, 0.01, 0.01]) / 0.52)
    assert np.allclose(inference.narrowed(p, top_k=3, top_p=0.5), [[0, 0.5, 0.5, 0], [1, 0, 0, 0]])


def test_sampling_with_one_choice_is_the_likeliest_token_each_time(spark):
    rows = inference.sample(spark, M, 5, 6, seed=1, top_k=1, step=2).collect()
    a, want = M.start, []
    for _ in range(6):
        want.append(int((a @ M.emit).argmax()))
        e = a * M.emit[:, want[-1]]
        a = (e / e.sum()) @ M.move
    assert all(r.tokens == want for r in rows)


def test_shards_and_small_batches_change_nothing(spark, rows):
    flow = lambda df: {(r.kind, r.i, r.k): r.mass for r in inference.flows(df, M).collect()}
    assert flow(rows.repartition(1)) == pytest.approx(flow(rows.repartition(5, "k")))
    c = Constraint(contains([0]), M, 1, 3, (4,))
    asked = rows.select("k", F.slice("tokens", 1, 1).alias("prefix"), F.slice("tokens", 2, 2).alias("tokens"))
    got = [{(r.k, r.token): r.num - 2 * r.den for r in next_tokens(asked.coalesce(1), c, "k", step=step).collect()} for step in (1, 2, 1024)]
    assert got[0] == pytest.approx(got[2]) and got[1] == pytest.approx(got[2])
