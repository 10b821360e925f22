"""Evaluation and leaderboard queries.

The given tables have no outputs of models.  These stand in: documents are the
outputs, words after "of" the answers, ``lang`` the constraint, ``source`` the
file, ``labels.quality`` correctness, ``events.value`` latency, and event types
with the key in ``props`` the error types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import evaluate, leaderboard
from seqloom.sources import streams

FILES = [f"src{k}" for k in range(20)]


def extract_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = streams.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(evaluate.extract_answers(F.col("text"), "[.]"), "|").alias("answers"))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: first letters of words."""
    docs = streams.table(spark, sf_dir, "documents")
    first = F.transform(streams.words(F.col("text")), lambda w: F.substring(w, 1, 1))
    return docs.select("doc_id", F.col("source").alias("file"), F.col("lang").alias("cnst_type"), first.alias("answers"))


def adjacent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).select("doc_id", evaluate.adjacent_repeats(F.col("answers")).cast("bigint").alias("repeats"))


def repeat_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluate.repeat_table(_outputs(spark, sf_dir), 20, ["cnst_type", "file"])
    return table.select("cnst_type", "file", F.round("pct", 6).alias("pct"))


def repeat_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pivot_percentages(repeat_pct(spark, sf_dir), "cnst_type", "file", FILES)


def prompt_x_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark prompt with every constraint of a list of three: the list
    has a fixed length, so it is exploded, not joined."""
    constraints = F.array(*[F.struct(F.lit(k).alias("clp_id"), F.lit(c).alias("cnst_type")) for k, c in enumerate(("contains", "count", "stop"))])
    items = streams.table(spark, sf_dir, "benchmark")
    return items.select("item_id", "text", F.explode(constraints).alias("c")).select("item_id", "c.clp_id", "c.cnst_type", F.concat_ws(" ", "c.cnst_type", "text").alias("prompt"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = streams.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(streams.table(spark, sf_dir, "labels"), "doc_id")


def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = leaderboard.accuracy(_judged(spark, sf_dir), ["source", "lang"], F.col("quality"))
    return table.withColumn("accuracy", F.round("accuracy", 6))


def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = leaderboard.mean_of_means(_judged(spark, sf_dir), ["source"], "lang", F.col("quality") * 100.0)
    return table.select("source", F.round("score", 6).alias("score"))


def weighted_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the score and a twentieth of the share of clean documents; the
    categories that were not run count as 0."""
    judged = _judged(spark, sf_dir)
    parts = leaderboard.mean_of_means(judged, ["source"], "lang", F.col("quality") * 100.0)
    clean = judged.groupBy("source").agg(evaluate.percentage(F.col("toxic") == 0).alias("clean"))
    table = parts.join(clean, "source").withColumn("live", F.lit(None).cast("double"))
    return table.select("source", F.round(leaderboard.weighted({"score": 0.1, "clean": 0.05, "live": 0.4}), 6).alias("overall"))


def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = weighted_overall(spark, sf_dir).withColumn("overall", F.round("overall", 0))
    return leaderboard.ranked(table, "overall", "source")


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = leaderboard.latency(streams.table(spark, sf_dir, "events"), ["event_type"], F.col("value"))
    return table.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "p95")])


def error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat("event_type", F.lit(":"), (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 7).cast("string"))
    return leaderboard.error_rollup(streams.table(spark, sf_dir, "events"), kind)


def queries():
    own = (extract_answers, adjacent_repeats, repeat_pct, repeat_pivot, prompt_x_constraint, accuracy_by_group, mean_of_means, weighted_overall, leaderboard_rank, latency_stats, error_rollup)
    return {f.__name__: f for f in own}


def oracle_sql():
    letters = "list_transform(list_filter(string_split_regex(text, '[ \\n]'), lambda x: x <> ''), lambda x: substr(x, 1, 1))"
    repeats = f"(select count(*) from (select unnest(range(2, len(a) + 1)) as i) where a[i] = a[i - 1])"
    outputs = f"o as (select doc_id, source as file, lang as cnst_type, {letters} as a from documents), r as (select doc_id, file, cnst_type, {repeats} as repeats from o)"
    pct = "round(100 * avg(case when repeats > 20 then 1.0 else 0.0 end), 6)"
    judged = "j as (select d.doc_id, d.lang, d.source, l.quality, l.toxic from documents d join labels l using (doc_id))"
    means = "m as (select source, avg(mean) as score from (select source, lang, avg(100.0 * quality) as mean from j group by all) group by 1)"
    overall = f"with {judged}, {means}, c as (select source, 100 * avg(case when toxic = 0 then 1.0 else 0.0 end) as clean from j group by 1), o as (select source, round(0.1 * score + 0.05 * clean, 6) as overall from m join c using (source))"
    return {
        "extract_answers": r"""select doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[.][ \t\n\x0B\f\r]*([^\n\r]*)', 1),
            lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda x: x <> ''), '|') as answers from documents""",
        "adjacent_repeats": f"with {outputs} select doc_id, repeats from r",
        "repeat_pct": f"with {outputs} select cnst_type, file, {pct} as pct from r group by 1, 2",
        "repeat_pivot": f"with {outputs}, p as (select cnst_type, file, {pct} as pct from r group by 1, 2) select cnst_type, "
        + ", ".join(f"coalesce(max(pct) filter (where file = '{f}'), 0.0) as {f}" for f in FILES) + " from p group by 1",
        "prompt_x_constraint": "select item_id, clp_id, cnst_type, cnst_type || ' ' || text as prompt from benchmark, (values (0, 'contains'), (1, 'count'), (2, 'stop')) c(clp_id, cnst_type)",
        "accuracy_by_group": f"with {judged} select source, lang, cast(sum(quality) as bigint) as correct_count, count(*) as total_count, round(sum(quality) / count(*), 6) as accuracy from j group by 1, 2",
        "mean_of_means": f"with {judged}, {means} select source, round(score, 6) as score from m",
        "weighted_overall": f"{overall} select * from o",
        "leaderboard_rank": f"{overall} select source, round(overall, 0) as overall, cast(row_number() over (order by round(overall, 0) desc, source) as int) as rank from o",
        "latency_stats": "select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1",
        "error_rollup": """select event_type as family, event_type || ':' || cast(cast(regexp_extract(props, '(\\d+)', 1) as int) % 7 as varchar) as error_type, count(*) as n from events group by all
            union all select event_type, null, count(*) from events group by 1 union all select null, null, count(*) from events""",
    }
