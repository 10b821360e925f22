import numpy as np
import pytest

from seqloom.llm import op3_topk as op
from seqloom.llm.common import table


def brute(rows, queries, k=20):
    ok = [(i, np.floor(64 * np.asarray(v, np.float32).astype(np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if queries(i)}):
        mine = {tuple(v) for i, v in ok if i == q}
        best = sorted((-int(sum(a * b for a, b in zip(m, v))), i) for i, v in ok if i != q for m in mine)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_given_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    want = brute(rows, lambda i: i % 20 == 0)
    assert got(op.op3_exact_topk(spark, sf_dir)) == want
    assert got(op.top_k(v, v.where("vec_id % 20 = 0"), block_rows=70, group_rows=6)) == want


def test_hard_rows_and_empty(spark):
    nan = float("nan")
    rows = [(20, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [3.0]), (6, []), (40, [float("inf"), 0.0]), (60, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    r = got(op.top_k(df, df.where("vec_id % 20 = 0"), k=3))
    assert [(q, k, i) for q, k, i, _ in r] == [(20, 1, 5), (20, 2, 1), (20, 3, 1), (60, 1, 1), (60, 2, 1), (60, 3, 5)]
    assert op.top_k(df.limit(0), df.limit(0)).count() == 0


def test_query_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 5.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, lambda i: i == 0, 5)
    assert [i for _, _, i, _ in want] == [2, 1, 3, 3, 1]
    for _ in range(2):
        assert got(op.top_k(df.repartition(3), df.where("vec_id = 0").repartition(2), k=5, block_rows=2)) == want


def test_how_much_is_looked_at(spark):
    """Far less than all pairs where vectors lie in clusters; all of them where 64
    numbers are drawn apart from each other."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(64, 64)) * 60
    data = np.floor(centres[rng.integers(0, 64, 8192)] + rng.normal(size=(8192, 64)) * 3)
    ids, scored = np.arange(8192), []
    top, _, _ = op.search(data[::20], ids[::20], data, ids, 20, scored=scored)
    share = sum(scored) / (len(data[::20]) * len(data))
    assert share < 0.5 and (top[0] == np.sort(np.delete(data @ data[0], 0))[::-1][:20].astype(int)).all()
    even, scored = np.floor(rng.normal(size=(4096, 64)) * 10), []
    op.search(even[::20], np.arange(4096)[::20], even, np.arange(4096), 20, scored=scored)
    print("share looked at: clusters", share, "even", sum(scored) / (len(even[::20]) * len(even)))


@pytest.mark.parametrize("kind", ["clusters", "copies", "wide"])
def test_search_is_exact(kind):
    rng = np.random.default_rng(4)
    data = np.floor(rng.normal(size=(700, 8)) * (2**27 if kind == "wide" else 40))
    if kind == "clusters":
        data[:500] = np.floor(data[rng.integers(0, 5, 500)] + rng.normal(size=(500, 8)))
    if kind == "copies":
        data[100:600] = data[0]
    ids = rng.permutation(700).astype(np.int64)
    q = data[:90]
    top, names, n = op.search(q, ids[:90], data, ids, 7, 8, 16)
    scores = np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in data] for x in q])
    for k in range(90):
        want = sorted((-int(s), int(i)) for s, i in zip(scores[k], ids) if i != ids[k])[:7]
        assert [(-int(s), int(i)) for s, i in zip(top[k], names[k])] == want and n[k] == 7
