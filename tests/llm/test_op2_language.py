import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import op2_language as op
from seqloom.llm.common import table


def plain_buckets(text):
    raw = (text or "").lower().encode()
    letter = [0 if not (97 <= b < 123 or b >= 128 or b in (9, 10, 11, 12, 13, 32)) else 32 if b <= 32 else b for b in raw]
    out = []
    for a, b, c in zip(letter, letter[1:], letter[2:]):
        if a and b and c:
            mixed = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
            out.append((mixed >> 11) % op.BUCKETS)
    return out


def brute(rows, full_weight=200, accept=0.5):
    """Every count and posterior by loops over all rows."""
    langs, m = op.LANGUAGES, len(op.LANGUAGES)
    counts = np.full((m + 1, op.BUCKETS), 0.5)
    grams = [plain_buckets(r[1]) for r in rows]
    for r, g in zip(rows, grams):
        if r[3] in langs:
            np.add.at(counts[langs.index(r[3])], g, 1)
    counts[-1] = 1
    model = np.log(0.5 * counts / counts.sum(1, keepdims=True) + 0.5 / op.BUCKETS)
    ll = [model[:, g].sum(1) * min(1, full_weight / max(1, len(g))) for g in grams]
    best = [int(np.argmax(x[:m])) if g else None for x, g in zip(ll, grams)]
    smooth = lambda c, p, a: (np.array(c) + a * np.array(p)) / (sum(c) + a)
    tally = lambda pick: {v: [sum(1 for k, r in zip(best, rows) if k == x and pick(r) == v) for x in range(m)] for v in {pick(r) for r, k in zip(rows, best) if k is not None}}
    whole = smooth([best.count(x) for x in range(m)], [1 / m] * m, 1.0)
    parent, host, declared = tally(lambda r: None)[None], tally(lambda r: r[2]), tally(lambda r: r[3])
    out = []
    for r, x, g, k in zip(rows, ll, grams, best):
        own = np.eye(m)[k] if g else np.zeros(m)
        lp = x[:m] + np.log(smooth(host[r[2]] - own, smooth(parent - own, whole, 20.0), 20.0) if r[2] in host else whole)
        if r[3] is not None and r[3] in declared:
            lp = lp + np.log(smooth(declared[r[3]] - own, whole, 1.0)) - np.log(whole)
        lp = np.append(lp, x[m] + math.log(0.01) if g else -1e30)
        p = np.exp(lp - lp.max())
        k = int(lp.argmax())
        out.append((r[0], (*langs, "und")[k], round(float(1 / p.sum()), 6), k < m and 1 / p.sum() >= accept))
    return out


def got(df):
    return [(r.doc_id, r.lang, round(r.posterior, 6), r.accepted) for r in df.select("doc_id", "lang", "posterior", "accepted").collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


def identify(df):
    return op.identify_documents(df, {"doc_id": F.col("doc_id")})


def test_against_loops(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    a, b = sorted(got(identify(docs)), key=key), sorted(brute(rows), key=key)
    assert [(x[0], x[1], x[3]) for x in a] == [(x[0], x[1], x[3]) for x in b]
    assert all(x[2] == pytest.approx(y[2], abs=1e-4) for x, y in zip(a, b))
    assert op.accepted_only(docs).columns == docs.columns and op.accepted_only(docs).count() == sum(x[3] for x in b)


def test_wrong_declarations_are_overruled_and_noise_is_rejected(frame, spark, sf_dir):
    texts = defaultdict(list)
    for r in table(spark, sf_dir, "documents").collect():
        texts[r.lang].append(r.text)
    noise = "".join(chr(97 + int(x)) for x in np.random.default_rng(1).integers(0, 26, 900))
    rows = [(k, t, "h", lang) for k, (lang, t) in enumerate((lang, t) for lang in ("en", "de") for t in texts[lang][:30])]
    rows += [(900, texts["de"][0] + " " + texts["de"][1], "h", "en"), (901, "q" + noise + "x", "h", "en")]
    found = {r.doc_id: r for r in identify(frame(rows)).collect()}
    assert found[900].lang == "de" and found[900].accepted
    assert found[901].lang == "und" and not found[901].accepted
    assert sum(found[k].accepted for k in range(len(rows) - 2)) == len(rows) - 2


def test_short_clean_texts_stay(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    short = spark.createDataFrame([(10**9, "A. All rights reserved.", "en", "src1"), (10**9 + 1, "CC BY 4.0, no warranty.", "en", "src2"), (10**9 + 2, "xqzjv wkpqx zzjqk vvxwq jjkqz", None, "src1")], docs.schema)
    found = {r.doc_id: r for r in identify(docs.union(short)).collect()}
    assert found[10**9].accepted and found[10**9 + 1].accepted and not found[10**9 + 2].accepted


def test_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = op.identify_pages(pages, {"page_id": F.col("page_id")})
    hits = Counter(r.lang == r.declared for r in found.collect())
    assert hits[True] >= 0.95 * pages.count()


def test_hard_rows_and_empty(frame, hard):
    found = identify(frame(hard)).collect()
    assert len(found) == len(hard)
    assert op.accepted_only(frame(hard)).columns == frame(hard).columns
    assert identify(frame([])).count() == 0 and op.accepted_only(frame([])).count() == 0
    told_nothing = identify(frame([(1, "some words"), (2, None)])).collect()
    assert {r.doc_id: r.accepted for r in told_nothing} == {1: True, 2: False}


def test_query_identifies_every_document_and_every_page(spark, sf_dir):
    rows = op.op2_language_id(spark, sf_dir).collect()
    for name, one in (("documents", "doc_id"), ("pages", "page_id")):
        want = sorted(r[0] for r in table(spark, sf_dir, name).select(one).collect())
        assert sorted(r[one] for r in rows if r[one] is not None) == want
    assert all((r.doc_id is None) != (r.page_id is None) and r.lang is not None for r in rows)


def test_pages_on_hard_rows(spark):
    html = "<html lang='de'><body>" + "der die das und ist nicht mit von zu auf " * 5
    rows = [(1, "http://a.b.de/x", html, 1), (1, "http://a.b.de/x", html, 1), (2, None, None, 1), (None, "no address", "", 1), (3, "http://c.org/en/", "<p>" + "w " * 40000, 1), (4, "http://[", "<html lang=>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").withColumn("parent", F.lit("x")).withColumn("lang", F.lit("y"))
    found = op.identify_pages(df, {"page_id": F.col("page_id")}).collect()
    assert len(found) == len(rows) and {r.lang for r in found if r.page_id == 1} == {"de"}
    assert op.identify_pages(df.limit(0), {"page_id": F.col("page_id")}).count() == 0


def test_suffix_and_host_move_what_the_text_leaves_open(spark):
    """Texts that read alike in two languages go with their address."""
    rng = np.random.default_rng(3)
    words = {"en": ["the", "and", "with", "house"], "de": ["der", "und", "mit", "haus"]}
    page = lambda lang, n: f"<html lang={lang}>" + " ".join(rng.choice(words[lang], n))
    rows = [(k, f"http://h{k % 3}.{end}/{path}/p", page(lang, 30)) for k, (lang, end, path) in enumerate([("en", "org", "en"), ("de", "de", "de")] * 30)]
    rows += [(100, "http://h1.de/de/p", "<p>x1"), (101, "http://h1.org/en/p", "<p>x1")]
    found = {r.page_id: r.lang for r in op.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), {"page_id": F.col("page_id")}).collect()}
    assert found[100] == "de" and found[101] == "en"
