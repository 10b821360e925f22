import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.dfa import always, contains, graph, stop_once, word_count
from seqloom.dfa.execute import class_table, contains_text, edge_table, matches, state_table
from seqloom.operators import corpus, evaluate, latent, leaderboard, ranking, tokens
from seqloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def array(*xs, kind="int"):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast(f"array<{kind}>")


def test_matches_runs_as_one_fold_without_python(spark):
    df = spark.createDataFrame([(1, [0, 1, 2]), (2, [1, 1]), (3, []), (4, None)], "k int, t array<int>")
    both = df.select("k", matches(F.col("t"), contains([1]), ~contains([1, 1])).alias("hit"))
    assert {r.k: r.hit for r in both.collect()} == {1: True, 2: False, 3: False, 4: None}
    plan = both._jdf.queryExecution().toString()
    assert plan.count("aggregate(") <= 8 and "Python" not in plan
    assert {r[0] for r in df.select(matches(F.col("t"), always())).collect()} == {True, False}
    assert df.where(matches(F.col("t"), contains([1]) & ~contains([1]))).count() == 0


def test_contains_text_agrees_with_the_fold(spark):
    df = spark.createDataFrame([("of the\nof",), ("the of",), ("softhe",), ("a of\nthe",)], "t string")
    got = df.select(contains_text(F.col("t"), "of the").alias("a"), matches(F.split("t", "[ \n]"), contains(["of", "the"])).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [True, False, False, True]


def test_graph_operations_agree_with_the_compiler(spark):
    dfa = stop_once(1) & contains([1])
    edges, states = edge_table(spark, dfa), state_table(spark, dfa)
    assert {r[0] for r in graph.reach(edges, states.where("is_initial").select("state")).collect()} == dfa.reachable()
    assert {r[0] for r in graph.live(edges, states.where("is_accept").select("state")).collect()} == dfa.live()
    assert graph.state_groups(edges, states).select("grp").distinct().count() == len(dfa.step)
    assert class_table(spark, dfa).count() == 1


def test_word_tokens(spark):
    df = spark.createDataFrame([("",), (" a",), ("b",), (",",), ("é1",), ("##",)], "t string")
    sep, word = tokens.classify(F.col("t"))
    assert [(r[0], r[1]) for r in df.select(sep, word).collect()] == [(False, False), (True, True), (False, True), (True, False), (False, True), (False, False)]
    assert one(spark, tokens.count_words(array("a", "##", "b", kind="string"), 2, 2)) is True
    assert one(spark, tokens.count_words(array(kind="string"), 0, 0)) is True
    assert word_count({}, 0, 0).accepts([])
    patterns = spark.createDataFrame([(["b", "c"],), (["a", "b", "c"],), (["b", "c"],), (["a"],), (["aa"],)], "pattern array<string>")
    assert sorted(r[0] for r in tokens.reduce_pattern_table(patterns).collect()) == [["a"], ["aa"], ["b", "c"]]


def test_evaluation(spark):
    assert one(spark, evaluate.extract_answers(F.lit("Answer: 3\nAnswer:\n 4 \nAnswer: "))) == ["3", "4"]
    assert [one(spark, evaluate.adjacent_repeats(array(*x)) > 1) for x in ((3, 3, 4, 4), (3, 3, 4), (), (1,))] == [True, False, False, False]
    table = spark.createDataFrame([("a", "x", 5.0)], "cnst_type string, file string, pct double")
    assert evaluate.pivot_percentages(table, "cnst_type", "file", ["x", "y"]).collect() == [("a", 5.0, 0.0)]


def test_leaderboard(spark):
    means = [("m", "p", 95.0), ("m", "j", 60.0), ("m", "s", 66.0)]
    df = spark.createDataFrame(means, "model string, lang string, x double")
    assert leaderboard.mean_of_means(df, ["model"], "lang", F.col("x")).first().score == pytest.approx(73.6667, abs=1e-4)
    assert (73.67 + 96 + 91.5 + 88) / 4 == pytest.approx(87.29, abs=0.01)
    ranks = leaderboard.ranked(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "m string, s double"), "s", "m")
    assert [(r.m, r["rank"]) for r in ranks.orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert leaderboard.error_rollup(spark.createDataFrame([("a:x",), ("a:y",), ("b",)], "e string"), F.col("e")).count() == 6


def test_corpus(spark):
    assert one(spark, corpus.pad(array(1, 2), 4, F.lit(3))) == [1, 2, 3, 3]
    assert one(spark, corpus.pad(array(1, 2, 5), 2, F.lit(3))) == [1, 2]
    assert one(spark, corpus.template(F.lit(" <image> q\n"), "!")) == "q!"
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"])], "k int, tokens array<string>")
    vocab = corpus.vocabulary(docs)
    assert {r.word: r.id for r in vocab.collect()} == {"b": 0, "a": 1, "c": 2}
    ids = corpus.encode(docs, vocab, "k")
    assert {r.k: r.text for r in corpus.decode(ids, vocab, "k").collect()} == {1: "b a b", 2: "c"}
    assert {r.k: r.text for r in corpus.decode(ids, vocab, "k", special=(0,)).collect()} == {1: "a", 2: "c"}
    chat = corpus.messages(F.lit("user"), F.lit("hi"), F.lit("data:image/png;base64,aGV5"))
    assert one(spark, corpus.has_image(chat)) and bytes(one(spark, corpus.images(chat))[0].raw) == b"hey"
    assert not one(spark, corpus.has_image(corpus.messages(F.lit("u"), F.lit("t"), F.lit(None).cast("string"))))


def test_trimming_and_scoring(spark):
    trim = lambda t, p, s: one(spark, ranking.generated(array(*t), array(*p), array(*s), 3))
    assert trim([9, 1, 2, 5, 3, 3], [9], [5, 6, 3]) == [1, 2]
    assert trim([3, 3], [3], [5]) == [] and trim([], [], []) == [] and trim([9, 5, 6, 5], [9], [5, 6]) == [5, 6]
    parts = spark.createDataFrame([(1, 0, "prompt", -9.0, 1), (1, 1, "generated", -1.0, 1), (1, 2, "generated", -2.0, 2), (1, 3, "suffix", -3.0, 1), (2, 0, "generated", -1.0, 1)], "k int, pos int, part string, logp double, nth int")
    score = lambda **kw: {r.k: r.score for r in ranking.score(parts, "k", **kw).collect()}
    assert score() == {1: -2.0, 2: None} and score(penalty=0.0)[1] == -6.0 and score(suffix_only=True)[1] == -3.0


def test_latent_counts(spark):
    def counts(rows, full):
        df = spark.createDataFrame([(0, p, t, [float(t)]) for p, t in enumerate(rows)], "seq_id int, pos int, token int, embedding array<float>")
        a = latent.assign(latent.positions(df, 3), [[1.0], [2.0], [9.0]])
        get = lambda x: {(r.i, r.k): r.mass for r in x.collect()}
        return get(latent.transition_counts(a, 4)), get(latent.emission_counts(a, 4, 3)), get(latent.start_counts(a))

    alpha, beta, gamma = counts([1, 2, 3, 3], 4)
    assert alpha == {(0, 1): 1, (1, 3): 1, (3, 3): 1} and beta == {(0, 1): 1, (1, 2): 1, (3, 3): 1} and gamma == {(0, 0): 1}
    assert counts([1, 2], 2)[0] == {(0, 1): 1, (3, 3): 1}
    assert counts([3, 3], 2) == ({(3, 3): 1}, {(3, 3): 1}, {})


def test_k_means_finds_two_groups(spark):
    df = spark.createDataFrame([([0.0, 0.1],), ([0.1, 0.0],), ([5.0, 5.0],), ([5.2, 5.0],)], "embedding array<float>")
    got = latent.k_means(df, [[0.0, 0.0], [1.0, 1.0]])
    assert got[0] == pytest.approx([0.05, 0.05], abs=1e-6) and got[1] == pytest.approx([5.1, 5.0], abs=1e-6)


def test_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(["a", "b\nc"]))
    assert [r.prompt for r in files.read_prompts(spark, str(tmp_path / "p.json")).collect()] == ["a", "b\nc"]
    (tmp_path / "r.json").write_text(json.dumps([{"prompt": "q", "img_b64": "aGV5", "mime_type": "image/png"}]))
    assert files.read_prompt_records(spark, str(tmp_path / "r.json")).first().prompt == "q"
    (tmp_path / "o.json").write_text(json.dumps([{"output": "x", "cnst_type": "c"}]))
    assert files.read_outputs(spark, str(tmp_path / "o.json")).first() == ("o.json", "x", "c")
    (tmp_path / "s.json").write_text('{"accuracy": 0.5, "correct_count": 1, "total_count": 2}\n{"id": "a", "valid": false, "error": ["e"], "error_type": "t:x"}\n')
    header, failures = files.read_scores(spark, str(tmp_path / "s.json"))
    assert header.first().total_count == 2 and failures.first().error_type == "t:x"
    (tmp_path / "l.csv").write_text("Rank,Model,Overall Acc\n1,m,87.29%\n2,n,N/A\n")
    assert [r[2] for r in files.read_leaderboard(spark, str(tmp_path / "l.csv")).collect()] == [87.29, None]
    (tmp_path / "x.json").write_text('{"id": "a", "result": "[]", "latency": 1.5}\n')
    assert files.read_results(spark, str(tmp_path / "x.json")).first().latency == 1.5
    files.write_chunks(spark.range(40), str(tmp_path / "c"), 4, "id")
    assert sum(files.read_chunks(spark, str(tmp_path / "c"), [k]).count() for k in range(4)) == 40


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    from seqloom.hmm import Hmm, inference
    from seqloom.streaming import stateful

    rows = [(u, t, (u * 7 + t * t) % 3) for t in range(12) for u in range(5)]
    schema = "user int, at int, token int"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == k], schema).coalesce(1).write.parquet(str(tmp_path / f"in/f{k}"))
    hmm, dfa = Hmm.random(2, 3, 1), contains([1, 1])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = stateful.drained(spark, stateful.follow(stream, dfa, hmm, "user", "token", ["at"]), str(tmp_path)).collect()
    last = {r.user: r for r in sorted(got, key=lambda r: r.n)}
    for u in range(5):
        want = [t for x, _, t in rows if x == u]
        assert last[u].n == 12 and last[u].accepted == dfa.accepts(want)
        assert last[u].ll == pytest.approx(inference.forward(hmm, np.array([want]))[1][0])
