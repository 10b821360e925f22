import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from seqloom.llm import op6_mixing as op
from seqloom.llm.common import table


def wanted(sizes):
    """Targets by the rule as it is stated: share, stop at the cap, reshare."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, held = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return share | held
        for s in over:
            held[s] = 2.0 * sizes[s]
            left -= held[s]


def check(rows, docs_per_block):
    sizes, taken, target = defaultdict(int), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        assert len(r.shards) == (r.taken // r.size if r.size else 0)
    want = wanted(dict(sizes))
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        small = max((r.size for r in rows if r.source == s), default=0)
        assert taken[s] <= target[s] + 1e-6 and target[s] - taken[s] <= small


def test_targets_and_quotas(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for n in (4, 64):
        rows = op.mix(docs, docs_per_block=n, blocks_per_shard=4, blocks_per_step=3).collect()
        assert len(rows) == docs.count()
        check(rows, n)
        again = op.mix(docs.repartition(5), docs_per_block=n, blocks_per_shard=4, blocks_per_step=3).collect()
        key = lambda r: (r.doc_id, r.taken, r.shards, r.shuffle_keys)
        assert sorted(map(key, rows)) == sorted(map(key, again))


def slow_mix(rows, hashes, docs_per_block):
    """Words taken of each (doc_id, source, size), one document after the other."""
    by_source = defaultdict(Counter)
    for r in rows:
        by_source[r.source][r.doc_id, r.size] += 1
    want, out = wanted({s: sum(size * n for (_, size), n in units.items()) for s, units in by_source.items()}), {}
    for s, units in by_source.items():
        k, words = math.ceil(len(units) / docs_per_block), sum(size * n for (_, size), n in units.items())
        passes = min(2, math.floor(want[s] / words)) if words else 0
        room, blocks = want[s] - passes * words, defaultdict(list)
        for (i, size), n in units.items():
            blocks[hashes[s, i, size] % k].append((hashes[s, i, size], i, size, n))
            out[i, s, size] = Counter({passes * size if size else 0: n})
        for b in sorted(blocks):
            whole = sum(size * n for _, _, size, n in blocks[b])
            last = whole > room
            for _, i, size, n in sorted(blocks[b], key=lambda x: x[0]):
                fits = n if not last else min(n, int(room // size)) if size else 0
                room -= fits * size
                if size:
                    out[i, s, size] = Counter({(passes + 1) * size: fits}) + Counter({passes * size: n - fits})
            if last:
                break
    return out


def hashed(docs):
    from seqloom.llm.common import WORD

    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    h = F.xxhash64(F.lit(op.SEED), F.coalesce("source", F.lit("\0null")), F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null")), size)
    return {(r.source, r.doc_id, r.size): r.h for r in docs.select("source", "doc_id", size.alias("size"), h.alias("h")).collect()}


def test_what_is_taken_of_each_document(spark, sf_dir, frame, hard):
    repeated = [(k % 3, "some words of a text that comes many times", "s") for k in range(300)] + [(9, "a b", "s"), (10, "c", None), (11, "d e f", "t")]
    for docs, n in ((table(spark, sf_dir, "documents"), 64), (table(spark, sf_dir, "documents"), 5), (frame(hard), 64), (frame(repeated), 2)):
        rows = op.mix(docs, docs_per_block=n).collect()
        got = defaultdict(Counter)
        for r in rows:
            got[r.doc_id, r.source, r.size][r.taken] += 1
        assert got == slow_mix(rows, hashed(docs), n)


def test_a_hot_unit_is_taken_in_part(frame):
    # one document, many times over, is nearly all of its source
    docs = frame([(1, "five words are in here", "a")] * 900 + [(2, "x " * 7, "a"), (3, "y " * 2000, "b")])
    rows = op.mix(docs, docs_per_block=1).collect()
    for s in ("a", "b"):
        mine = [r for r in rows if r.source == s]
        assert 0 <= mine[0].target - sum(r.taken for r in mine) < max(r.size for r in mine)


def test_shards_hold_every_copy_once_in_an_order_of_their_own(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = op.mix(docs, docs_per_block=4, blocks_per_shard=4)
    rows, copies = mixed.collect(), op.shuffled_copies(mixed).collect()
    want = Counter((r.doc_id, s, k) for r in rows for s, k in zip(r.shards, r.shuffle_keys, strict=True))
    assert want == Counter((c.doc_id, c.shard, c.shuffle_key) for c in copies) and max(want.values()) == 1
    assert sum(c.size for c in copies) == sum(r.taken for r in rows)
    by_shard = defaultdict(list)
    for c in copies:
        by_shard[c.shard].append((c.shuffle_key, c.doc_id))
    orders = [[i for _, i in sorted(x)] for x in by_shard.values() if len(x) > 8]
    # shuffled: neither by id nor by block, and another order in each shard
    assert len(orders) > 1 and all(o != sorted(o) for o in orders)


def test_hard_rows_and_empty(frame, hard):
    rows = op.mix(frame(hard)).collect()
    assert len(rows) == len(hard)
    assert sum(r.taken for r in rows if r.size == 0) == 0
    assert op.mix(frame([])).count() == 0


def test_tree_keeps_quotas_and_evens_shards(spark):
    counts = spark.createDataFrame([(0, 700), (1, 200), (2, 100), (3, 0)], "i int, c long")
    parts = op.split_tree(counts, 1000, 8).collect()
    by_source, by_shard = Counter(), Counter()
    for r in parts:
        by_source[r.i] += r.c
        by_shard[r.shard] += r.c
    assert by_source == {0: 700, 1: 200, 2: 100}
    assert all(by_shard[k] == 125 for k in range(8))


def test_hypergeometric_quantiles(spark):
    def cdf(pop, marked, drawn):
        total, at = 0.0, []
        for k in range(max(0, drawn + marked - pop), min(drawn, marked) + 1):
            total += math.comb(marked, k) * math.comb(pop - marked, drawn - k) / math.comb(pop, drawn)
            at.append((k, total))
        return at

    for pop, marked, drawn in ((10, 4, 5), (50, 20, 25), (7, 7, 3), (300, 9, 150)):
        for u in (0.03, 0.4, 0.73, 0.98):
            want = next(k for k, c in cdf(pop, marked, drawn) if c >= u - 1e-9)
            df = spark.range(1).select(F.lit(pop).cast("long").alias("p"), F.lit(marked).cast("long").alias("m"), F.lit(drawn).cast("long").alias("d"), F.lit(u).alias("u"))
            assert df.select(F.expr(op.hypergeometric("p", "m", "d", "u"))).first()[0] == want
