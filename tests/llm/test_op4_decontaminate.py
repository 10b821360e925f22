from collections import Counter

from seqloom.llm import op4_decontaminate as op
from seqloom.llm.common import table


def brute(docs, items, threshold=0.6, similarity=0.8):
    """Every passage against every item, no bound and no index."""
    import math

    parts = [op.parts_of(t) for _, t in items]
    words = [q + a for q, a in parts]
    df = Counter(w for ws in words for w in set(ws))
    mean = max(1.0, sum(map(len, words)) / len(words))
    out = set()
    for d, text in docs:
        ws = op.words_of(text)
        for (i, _), item, (q, a) in zip(items, words, parts):
            cell = op.cell_of(len(item))
            for p in range(-(-len(ws) // cell) if item else 0):
                passage = ws[p * cell : (p + 2) * cell]
                have = set(passage)
                weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(item) / mean)) for w, tf in Counter(item).items()}
                if sum(x for w, x in weight.items() if w in have) < threshold * sum(weight.values()):
                    continue
                asked = op.shingles(q)
                n = len(next(iter(asked))) if asked else 1
                there = {tuple(passage[k : k + n]) for k in range(len(passage))}
                if asked and len(asked & there) < similarity * len(asked):
                    continue
                if a and sum((Counter(a) & Counter(passage)).values()) < similarity * len(a):
                    continue
                out.add((d, i))
    return out


def test_against_brute_force(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want
    for shard in (32 << 20, 3000):
        assert {(r.doc_id, r.item_id) for r in op.find_leaks(docs, items, shard_bytes=shard).collect()} == want
    assert {r.doc_id for r in op.clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_wand_retrieves_what_full_scoring_does(spark, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    index = next(op.indexes(table(spark, sf_dir, "benchmark")))
    for _, text in items[:20]:
        terms = [index.term[w] for w in dict.fromkeys(op.words_of(text)[::2])]
        for size in index.sizes:
            for threshold in (0.05, 0.2, 0.5):
                full = Counter()
                for t in terms:
                    for doc, x in zip(*size.lists.get(t, ((), ()))[:2]):
                        full[doc] += x
                assert {d for d, _ in size.wand(terms, threshold)} == {d for d, x in full.items() if x >= threshold - 1e-9}


QUESTION = "where does the old grey heron stand in the long evening beside the quiet mill pond?"
ANSWER = "It stands upon the broken wooden sluice gate."


def test_an_item_is_found_whatever_else_the_benchmark_holds(spark, frame):
    filler = " ".join(f"word{k}" for k in range(900))
    docs = frame([(1, f"{QUESTION} {filler} {ANSWER}"), (2, f"{filler} {QUESTION} {ANSWER} {filler}"), (3, filler)])
    other = [(k, f"unrelated item {k} has other words? number {k} it is.") for k in range(2, 40)] + [(40, " ".join(f"w{k}" for k in range(2000)))]
    for items in ([(1, f"{QUESTION} {ANSWER}")], [(1, f"{QUESTION} {ANSWER}"), *other]):
        for kind in ("long", "int", "string"):
            marks = spark.createDataFrame(items, "item_id long, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
            for shard in (8 << 20, 3000) if kind == "int" else (8 << 20,):
                assert [(r.doc_id, int(r.item_id)) for r in op.find_leaks(docs, marks, shard_bytes=shard).collect()] == [(2, 1)]
                assert {r.doc_id for r in op.clean(docs, marks, shard_bytes=shard).collect()} == {1, 3}


def test_long_texts_are_numbered_in_steps():
    index = op.Index([(1, f"{QUESTION} {ANSWER}")], Counter(op.words_of(f"{QUESTION} {ANSWER}")), 1, 20.0)
    text = f"xy {QUESTION} none " * 50
    for step in (1, 7, 100, 1 << 20):
        assert index.numbers(text, step).tolist() == index.numbers(text).tolist()


def test_hard_rows_and_empty(spark, frame, hard):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (None, "Where? There now."), (1, "a b c d e f g")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op.find_leaks(frame(hard), items).collect()}
    assert got == {(1, 1)}
    assert op.clean(frame(hard), items).count() == len(hard) - 2
    assert op.find_leaks(frame([]), items).count() == 0
    assert op.clean(frame(hard), items.limit(0)).count() == len(hard)
