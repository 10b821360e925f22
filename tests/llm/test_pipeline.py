import corpus_pipeline
from pyspark.sql import functions as F

from seqloom.llm import op2_language, op4_decontaminate, op5_secrets, op8_simhash
from seqloom.llm.common import table, written


def test_every_stage_does_its_part(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontaminate", "secrets", "mixture"]
    held = docs
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, held, sf_dir), f"test-{name}")
        if name == "language":
            accepted = op2_language.identify_documents(held, {"doc_id": F.col("doc_id")}).where("accepted")
            assert ids(out) == ids(accepted)
        if name == "near_duplicates":
            groups = op8_simhash.groups(held).collect()
            assert ids(out) == {r.component_id for r in groups} and out.count() == len({r.component_id for r in groups}) < held.count()
        if name == "decontaminate":
            leaks = ids(op4_decontaminate.find_leaks(held, table(spark, sf_dir, "benchmark")))
            assert leaks and ids(out) == ids(held) - leaks
        if name == "secrets":
            assert ids(out) == ids(held)
            before = op5_secrets.digest(op5_secrets.find_spans(held)).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0]
            after = op5_secrets.digest(op5_secrets.find_spans(out)).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0]
            assert before > 0 and after == 0
        if name == "mixture":
            assert ids(out) <= ids(held) and out.agg(F.min("taken")).first()[0] > 0
        else:
            assert out.columns == docs.columns
            held = out
    assert corpus_pipeline.run(spark, sf_dir).count() == written(corpus_pipeline.mixture(spark, held, sf_dir), "again").count()


def _folder(spark, tmp_path, docs, items):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def _stages(spark, sf_dir):
    held = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        held = written(stage(spark, held, sf_dir), f"test-{name}")
        yield name, held


def test_stages_stand_hard_rows_and_clashing_columns(spark, frame, hard, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here password=hunter22"
    docs = frame([*hard, (7, text, "s", "en"), (8, text, "t", "en"), (9, "where is the fox and what does the dog see in the long field today? it sees nothing", None, "en")])
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    sf_dir = _folder(spark, tmp_path, docs, [(1, "where is the fox and what does the dog see in the long field today? it sees nothing"), (2, None), (None, "")])
    for name, out in _stages(spark, sf_dir):
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "mixture":
            assert set(ids) <= {1, 4, 5, 7, None}
            continue
        assert out.columns == docs.columns and 7 in ids
        assert (name == "language") == (8 in ids) and (name in ("language", "near_duplicates")) == (9 in ids)
        if name == "secrets":
            row = out.where("doc_id = 7").first()
            assert "[SECRET]" in row.text and "hunter22" not in row.text and row.n_chars == len(row.text) and row.host == "x"


def test_stages_stand_empty_tables(spark, frame, tmp_path):
    docs = frame([]).withColumn("n_chars", F.lit(0).cast("long"))
    sf_dir = _folder(spark, tmp_path, docs, [])
    assert [out.count() for _, out in _stages(spark, sf_dir)] == [0] * len(corpus_pipeline.STAGES)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
