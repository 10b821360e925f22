import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import op1_lm_scoring as op
from seqloom.llm.attention import Adam, Attention, transitions, values_of
from seqloom.llm.common import table


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*plain_words(t), " "])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ws = [*plain_words(t), " "]
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0], r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_base_score_and_a_better_model_however_rows_are_dealt(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want, before = brute([(r.doc_id, r.text) for r in docs.collect()]), None
    for parts in (1, 8, 32):
        rows = op.score(docs.repartition(parts, "doc_id"), hot=500).collect()
        same(rows, want)
        out = [r for r in rows if r.held_out]
        assert out and all(r.score < 0 for r in rows)
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
        scores = {r.doc_id: r.score for r in rows}
        assert before is None or all(math.isclose(x, before[i], rel_tol=1e-6) for i, x in scores.items())
        before = scores


def test_how_many_words_are_hot_changes_nothing(spark, frame, hard):
    got = [sorted((r.doc_id or -1, r.n_tokens, round(r.base_score, 6), round(r.score, 5)) for r in op.score(frame(hard), hot=h, word_share=0.4, rounds=2).collect()) for h in (0, 3, 1000)]
    assert got[0] == got[1] == got[2]
    same(op.score(frame(hard), rounds=2).collect(), brute([r[:2] for r in hard]))
    assert op.score(frame([]), rounds=2).count() == 0


def slow_log_probs(model, values, seq, start):
    """One class at a time, a loop over what its window may see."""
    p, out = model.p, []
    inputs = [start, *seq[:-1]]
    for i, y in enumerate(seq):
        lo = max(0, (i // model.half - 1) * model.half)
        x = np.array(inputs[lo : i + 1])
        lag = i - np.arange(lo, i + 1)
        s = p["K"][x] @ p["Q"][x[-1]] / math.sqrt(model.width) + p["key"][x] + p["lag"][lag]
        a = np.exp(s) / np.exp(s).sum()
        out.append(math.log((a * values[np.minimum(lag, len(values) - 1), x, y]).sum()))
    return out


def made(rng, classes=9, distances=3, half=4, width=5):
    values = values_of(rng.integers(0, 50, (distances, classes, classes)), np.full(classes, 1 / classes))
    theta = rng.normal(size=Attention(values, width, half).size) * 0.5
    return values, theta, Attention(values, width, half, theta)


def test_batched_attention_against_a_loop():
    rng = np.random.default_rng(3)
    values, _, model = made(rng)
    sizes = [1, 0, 4, 7, 20]
    seqs = [rng.integers(0, 9, n) for n in sizes]
    for step in (2, 4096):
        got = model.log_probs(np.concatenate(seqs).astype(np.uint8), np.array(sizes), 0, step)
        want = np.concatenate([slow_log_probs(model, values, s.tolist(), 0) for s in seqs])
        assert np.allclose(got, want, atol=1e-4)


def test_mixtures_are_distributions():
    rng = np.random.default_rng(4)
    _, _, model = made(rng)
    seen = rng.integers(0, 9, 6).tolist()
    ends = [np.array([*seen, y], np.uint8) for y in range(9)]
    assert sum(math.exp(model.log_probs(x, np.array([7]), 0)[-1]) for x in ends) == pytest.approx(1, abs=1e-4)


def test_gradient_against_differences():
    rng = np.random.default_rng(5)
    values, theta, model = made(rng, 6, 2, 3, 3)
    ids, n = rng.integers(0, 6, 11).astype(np.uint8), np.array([4, 7])
    lp, gradient = model.gradient(ids, n, 0)
    assert np.allclose(lp, model.log_probs(ids, n, 0), atol=1e-6)

    def total(k, by):
        moved = theta.copy()
        moved[k] += by
        return sum(sum(slow_log_probs(Attention(values, 3, 3, moved), values, s.tolist(), 0)) for s in (ids[:4], ids[4:]))

    for k in range(model.size):
        assert gradient[k] == pytest.approx((total(k, 1e-4) - total(k, -1e-4)) / 2e-4, abs=1e-4)


def test_transitions_count_all_pairs():
    rng = np.random.default_rng(6)
    seqs = [rng.integers(0, 5, n) for n in (3, 1, 9)]
    got = transitions(np.concatenate(seqs), np.array([3, 1, 9]), 0, 5, 2, 4)
    want = np.zeros((2, 5, 5), int)
    for s in ([0, *x] for x in seqs):
        for i in range(1, len(s)):
            for lag in range(min(4, i)):
                want[min(lag, 1), s[i - 1 - lag], s[i]] += 1
    assert (got == want).all()


def test_training_learns_what_to_attend_to():
    # the class three places back is repeated, what lies between is noise
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, 4000)
    for k in range(3, len(x)):
        if k % 4 == 3:
            x[k] = x[k - 3]
    values = values_of(transitions(x, np.array([len(x)]), 0, 4, 8, 8), np.full(4, 0.25))
    model = Attention(values)
    adam, fits = Adam(model.size), []
    for _ in range(30):
        lp, g = model.gradient(x, np.array([len(x)]), 0)
        fits.append(lp.mean())
        model = Attention(values, theta=adam.step(model.theta, g / len(x)))
    assert fits[-1] > fits[0] + 0.02 and model.p["lag"].argmax() == 2


def test_pieces_of_words_one_by_one_and_together(spark):
    here = op.Encoder(op.VOCABULARY)
    words = [b"the", "größe".encode(), op.END, b"x" * 5000, op.END, op.END, bytes([255]), b"a.b,c", op.END]
    ids, lengths = here.pieces(words)
    alone = [here.pieces([w]) for w in words]
    assert ids.tolist() == [k for a, _ in alone for k in a] and lengths.tolist() == [int(n[0]) for _, n in alone]
    assert here.pieces([])[0].size == 0 and here.pieces([op.END])[0].tolist() == [here.size - 1]


def test_stretches_hold_every_word_once(monkeypatch):
    words = [f"w{k}".encode() for k in range(1000)]
    text = b" ".join(words)
    for size in (1, 7, 999, 1000, 1001):
        got = list(op.stretches(text, size))
        assert [w for s in got for w in s] == [*words, op.END] and all(len(s) == size for s in got[:-1])
    assert list(op.stretches(None)) == [[op.END]]
    assert [w for part in op.parts_of(text, 10) for w in part] == words


def test_every_training_text_is_in_one_round_and_counts_are_whole(spark, frame):
    spark.sparkContext.addFile(op.VOCABULARY)
    name = op.VOCABULARY.rsplit("/", 1)[-1]
    docs = frame([(k, "the a " * 50) for k in range(40)])
    here = op.Encoder(op.VOCABULARY)
    counts = op.piece_counts(op.word_counts(docs), name, here.size)
    pieces = op.Pieces(counts, here.begins, 256, 224)
    shared = spark.sparkContext.broadcast(("test", pieces, [b"a"], np.array([50])))
    read = op.spelled(docs, shared, name, 3, 1.0, 0.001)
    rows = read.collect()
    texts = sum(zlib.crc32(str(k).encode()) % 10 != 0 for k in range(40))
    assert len(rows) == texts and {r.turn for r in rows} == {0, 1, 2}
    assert sum(len(r.classes) for r in rows) == counts.sum() == 101 * texts
    found = op.count_transitions(read, 256, 2, 4)
    # 102 with the start, each after all before it at up to eight distances
    assert found[0].sum() == 101 * texts and found[1].sum() == sum(101 - k for k in range(1, 8)) * texts
