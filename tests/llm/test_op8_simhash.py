import random

import numpy as np
import xxhash

from seqloom.llm import op8_simhash as op
from seqloom.llm.common import table
from seqloom.llm.components import components


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, pairs):
    up = list(range(n))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows):
    fps = [plain(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = roots(len(rows), links)
    least = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((i, f"{f:016x}", least.get(r)) for f, r, (i, _) in zip(fps, root, rows) if i is not None)


def got(df):
    return sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect() if r.doc_id is not None)


def test_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(op.groups(docs)) == brute(rows)


def test_hard_rows_and_empty(frame, hard):
    assert got(op.groups(frame(hard))) == brute([r[:2] for r in hard])
    assert op.groups(frame([])).count() == 0


def test_large_buckets_are_chunked_without_loss(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b for b in base} | {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))) for b in base for _ in range(90)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    for block in (5, 4096):
        links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in op.links(df, 3, block).collect()]
        at = {f: k for k, f in enumerate(fps)}
        assert roots(len(fps), [(at[a], at[b]) for a, b in links]) == want


def test_counters_against_popcount():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 200, np.uint64)
    b = a ^ np.uint64(0b1011) * (rng.integers(0, 2, 200).astype(np.uint64))
    for radius in (0, 1, 2, 3, 5):
        over = op._lanes(op.over_radius(op.to_planes(a ^ b), None, radius), 200)
        assert (over == (np.bitwise_count(a ^ b) > radius)).all()


def test_keep_one_leaves_a_row_a_group(frame):
    text = "one two three four five six"
    rows = [(5, text), (2, text.replace("one", "ONE")), (2, text.replace("one", "ONE")), (9, "other words stand here in full"), (None, "z"), (None, "z"), (None, text)]
    kept = op.keep_one(docs := frame(rows))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect()) == [(False, 2, text.replace("one", "ONE")), (False, 9, rows[3][1]), (True, None, "z")]
    assert kept.columns == docs.columns


def test_keep_one_loses_no_text_of_repeated_ids(frame):
    shared, own = "a text that two ids share word for word", "quite another text stands here under the same id"
    kept = op.keep_one(frame([(3, shared), (5, shared), (5, own), (5, own), (7, None), (7, "")]))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, shared), (5, own), (7, "")]


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 151)}
