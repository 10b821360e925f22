import random
import zlib

import numpy as np

from seqloom.llm import op7_toxicity as op
from seqloom.llm.common import table


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in op.op7_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    out = [(labels[i], scored[i].score) for i in labels if held(i)]
    assert all(scored[i].held_out == held(i) for i in scored) and len(scored) == table(spark, sf, "documents").count()
    hits = sum((s >= 0.5) == (t == 1) for t, s in out)
    toxic = [s for t, s in out if t == 1]
    assert hits / len(out) > 0.97 and sum(s >= 0.5 for s in toxic) / len(toxic) > 0.85


def biased():
    """Toxic sentences name one group more often; insults decide the label."""
    rng = random.Random(1)
    plain = "the day was long and we went home over the old bridge with friends".split()
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(plain, k=12)
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(12)] = rng.choice(["idiot", "scum"])
        if rng.random() < (0.8 if toxic else 0.1):
            words[rng.randrange(12)] = "muslims"
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_swaps_move_no_score(spark, frame):
    rows, labels = biased()
    docs, marks = frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    sentence = "we went home with {} over the bridge"
    gap = {}
    for penalty in (0.0, 20.0):
        c = op.train(docs, marks, penalty=penalty)
        s = c.scores([sentence.format(t) for t in ("muslims", "christians", "friends")] + ["you idiot went home"], op.Features(c.chosen))
        z = np.log(s / (1 - s))
        gap[penalty] = abs(z[0] - z[1])
        assert s[3] > 0.5
    assert gap[20.0] < 0.2 * gap[0.0]


def test_neutral_mentions_of_groups_on_held_out_rows(spark):
    """In held-out texts that aren't toxic a group is named; the score should not
    rise for that.  The labels are biased: in the training part a group is named in
    most toxic texts."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = [(r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect() if r.doc_id in labels]
    rng, biased = random.Random(4), []
    for i, t in rows:
        named = not held(i) and rng.random() < (0.7 if labels[i] else 0.05)
        biased.append((i, t + (" muslims" if named else "")))
    docs = spark.createDataFrame(biased, "doc_id long, text string")
    neutral = [t for i, t in rows if held(i) and not labels[i]]
    wrong = {}
    for penalty in (0.0, 20.0):
        c = op.train(docs, table(spark, sf, "labels"), penalty=penalty)
        score = lambda texts, c=c: c.scores(texts, op.Features(c.chosen))
        before, after = score(neutral), score([t + " muslims" for t in neutral])
        toxic = score([t for i, t in rows if held(i) and labels[i]])
        wrong[penalty] = (int((after >= 0.5).sum()), float(np.abs(after - before).mean()), float((toxic >= 0.5).mean()))
    print("held-out neutral texts", len(neutral), "toxic", len(toxic), "false positives, mean change and toxic found by penalty", wrong)
    assert wrong[20.0][0] <= wrong[0.0][0] and wrong[20.0][1] < 0.5 * wrong[0.0][1] and wrong[20.0][2] >= wrong[0.0][2]


def plain_rows(features, texts):
    """One text, one word at a time."""
    import math
    from collections import Counter

    out = []
    for t in texts:
        counts = Counter()
        for w in op._WORD.findall((t or "").lower()):
            counts.update(features.of_word(w))
        out.append({f: 1 + math.log(n) for f, n in sorted(counts.items())})
    return out


def test_scores_against_one_word_at_a_time(spark, sf_dir):
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()] + [None, "", "z" * 5000, "word " * 9000]
    every = op.Features()
    chosen = {f: k for k, f in enumerate(sorted({f for x in plain_rows(every, texts[:40]) for f in x})[::3])}
    weights, features = np.random.default_rng(1).normal(size=len(chosen)), op.Features(chosen, cached=500)
    want = plain_rows(features, texts)
    assert [sorted(x) for x in features.rows(texts)] == [sorted(x) for x in want]
    z = np.array([0.3 + sum(weights[f] * x for f, x in row.items()) for row in want])
    got = op.Classifier(chosen, weights, 0.3).scores(texts, features)
    assert np.allclose(got, 1 / (1 + np.exp(-np.clip(z, -500, 500))))
    at = [(k, f, n) for room in (10, 1 << 20) for k, f, n in zip(*features.counted(texts, room))]
    assert at[: len(at) // 2] == at[len(at) // 2 :]


def test_words_are_runs_of_letters_and_digits():
    for t in ("", "a_b-c d", "Größe, ñandú! x\u00a0y\u2003z", "what\u2014ever \u201cit\u201d e\u0301", "\x1c1\x85 2", "İstanbul ǅ 한국어 ١٢", "\U0001f600 a"):
        assert op.words_of(t) == op._WORD.findall(t.lower())


def test_every_named_sentence_is_swapped_and_long_ones_whole():
    terms, named = ("women", "men", "gays"), {"women", "men", "gays"}
    text = "x " * 1500 + "the women left. Men stayed here. none. " + "y " * 70 + "gays " + "y " * 70
    pairs = list(op.swaps(text, terms, named))
    assert len(pairs) == 3 and all(len(a.split()) == len(b.split()) <= op.RUN for a, b in pairs)
    assert all(sum(w in named for w in a.split()) == 1 for a, _ in pairs) and pairs == list(op.swaps(text, terms, named))
    (one,) = op.swaps("plain words only. more of them here.", terms, named)
    assert sum(a != b for a, b in zip(one[0].split(), one[1].split())) == 1 and {w for w in one[0].split() + one[1].split()} & named
    assert not list(op.swaps(None, terms, named)) and not list(op.swaps("...", terms, named))


def test_labels_of_the_held_out_part_are_never_read(spark, frame):
    rows, labels = biased()
    docs = frame(rows)
    a = op.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    turned = [(i, 1 - t if held(i) else t) for i, t in labels]
    b = op.train(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert a.chosen == b.chosen and np.array_equal(a.weights, b.weights)


def test_hard_rows_and_empty(spark, frame, hard):
    marks = spark.createDataFrame([(1, 1, 5), (1, 0, 5), (4, 0, 5), (None, 1, 5), (6, None, 5)], "doc_id long, toxic int, score int")
    c = op.train(frame(hard), marks)
    got = op.score(frame(hard), c).collect()
    assert len(got) == len(hard) and all(0 <= r.score <= 1 for r in got)
    none = op.train(frame(hard), marks.limit(0))
    assert {r.score for r in op.score(frame(hard), none).collect()} == {0.5}
    assert op.score(frame([]), none).count() == 0
