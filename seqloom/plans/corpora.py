"""Corpus preparation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import corpus
from seqloom.sources import streams

ASK = "\nGive the answer on a last line."


def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" <image> "), F.col("text"), F.lit("\n<image>"))
    return streams.table(spark, sf_dir, "benchmark").select("item_id", corpus.template(text, ASK).alias("prompt"))


def nested_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as arrays of messages; the first one's content."""
    turns = streams.table(spark, sf_dir, "conversations")
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("source_prompt"))
    return held.select("conv_id", F.col("source_prompt")[0]["role"].alias("role"), F.col("source_prompt")[0]["content"].alias("content"))


def shuffle_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 100 documents."""
    return corpus.sample(streams.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", 100)


def head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limiting operator: the 50 first documents."""
    return streams.table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(50)


def replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.replicate(streams.table(spark, sf_dir, "benchmark").select("item_id"), 10)


def pad_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.padded(streams.events(spark, sf_dir), "tokens", F.lit(-1))
    fixed = corpus.pad(F.col("tokens"), 16, F.lit(-1))
    return rows.select("user_id", F.array_join("padded", ",").alias("padded"), F.array_join("mask", ",").alias("mask"), F.array_join(fixed, ",").alias("fixed"))


def chunk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of five chunks of the event sequences, united again."""
    rows = streams.table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 5).cast("int").alias("chunk"))
    out = rows.where("chunk = 0")
    for k in (2, 4):
        out = out.unionByName(rows.where(f"chunk = {k}"))
    return out.groupBy("chunk", "user_id").agg(F.count("*").alias("n"))


def eos_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.label_sequences(spark, sf_dir)
    return rows.agg(F.count_if(F.array_contains("tokens", 9)).alias("with_eos"), F.count("*").alias("n"))


def chat_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flatten_chat(streams.table(spark, sf_dir, "conversations"))


def chat_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats of one turn; every third one carries its text as an image."""
    turns = streams.table(spark, sf_dir, "conversations")
    url = F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", ""))
    chat = corpus.messages(F.col("role"), F.col("text"), F.when(F.col("turn") % 3 == 0, url))
    rows = turns.select("conv_id", "turn", chat.alias("chat"))
    found = corpus.images(F.col("chat"))
    return rows.select(
        "conv_id", "turn", corpus.has_image(F.col("chat")).alias("has_image"),
        F.array_join(F.transform(found, lambda x: x["mime"]), ",").alias("mime"),
        F.array_join(F.transform(found, lambda x: F.decode(x["raw"], "UTF-8")), ",").alias("payload"),
    )


def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the words of benchmark items and the text they give back, without
    the most frequent word (id 0) as a special one."""
    items = streams.table(spark, sf_dir, "benchmark").select("item_id", streams.words(F.col("text")).alias("tokens"))
    vocab = corpus.vocabulary(items)
    ids = corpus.encode(items, vocab, "item_id")
    back = corpus.decode(ids, vocab, "item_id", special=(0,))
    return ids.join(back, "item_id", "left").select("item_id", F.array_join("ids", ",").alias("ids"), "text")


def drop_null_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' purchases as what was generated; without any, nothing was."""
    ev = streams.table(spark, sf_dir, "events")
    held = ev.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("event_type") == "purchase", F.col("event_id")))).alias("ids"))
    rows = held.select("user_id", F.when(F.size("ids") > 0, F.array_join("ids", ",")).alias("generated"))
    return corpus.drop_missing(rows, "generated")


def seq_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether prompt and output make up the full sequence; every seventh has a
    token changed."""
    rows = streams.label_sequences(spark, sf_dir)
    prompt, output = F.slice("tokens", 1, 3), F.expr("slice(tokens, 4, size(tokens))")
    full = F.when(F.col("seq_id") % 7 == 0, F.concat(F.array(F.lit(-1)), F.expr("slice(tokens, 2, size(tokens))"))).otherwise(F.col("tokens"))
    return rows.select("seq_id", (F.concat(prompt, output) == F.slice(full, 1, F.size(F.concat(prompt, output)))).alias("whole"))


def queries():
    own = (prompt_template, nested_project, shuffle_limit, head_limit, replicate, pad_sequences, chunk_union, eos_tally, chat_flatten, chat_extract, encode_decode, drop_null_generations, seq_integrity)
    return {f.__name__: f for f in own}


def oracle_sql():
    ev = """ev as (select user_id, list(token order by ts, event_id) as t from (select *, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as token from events) group by 1)"""
    labels = "s as (select vec_id // 10 as seq_id, list(label order by vec_id % 10) as t from embeddings group by 1)"
    w = "list_filter(string_split_regex(text, '[ \\n]'), lambda x: x <> '')"
    fill = lambda n, x: f"list_transform(range(greatest({n} - len(t), 0)), lambda i: {x})"
    return {
        "prompt_template": f"select item_id, regexp_replace(replace(' <image> ' || text || chr(10) || '<image>', '<image>', ''), '^\\s+|\\s+$', '', 'g') || chr(10) || '{ASK[1:]}' as prompt from benchmark",
        "nested_project": "select conv_id, min_by(role, turn) as role, min_by(text, turn) as content from conversations group by 1",
        "shuffle_limit": "select doc_id, lang, source from documents order by (doc_id * 7919 + 104729) % 1000003, doc_id limit 100",
        "head_limit": "select doc_id, n_chars from documents order by doc_id limit 50",
        "replicate": "select item_id, cast(copy as int) as copy from benchmark, range(1, 11) r(copy)",
        "pad_sequences": f"""with {ev}, m as (select max(len(t)) as n from ev) select user_id, array_to_string(t || {fill('n', '-1')}, ',') as padded,
            array_to_string(list_transform(t, lambda x: 1) || {fill('n', '0')}, ',') as mask, array_to_string(t[1:16] || {fill('16', '-1')}, ',') as fixed from ev, m""",
        "chunk_union": "select cast(event_id % 5 as int) as chunk, user_id, count(*) as n from events where event_id % 5 in (0, 2, 4) group by 1, 2",
        "eos_tally": f"with {labels} select count(*) filter (where list_contains(t, 9)) as with_eos, count(*) as n from s",
        "chat_flatten": "select conv_id, cast(count(*) as int) as n_turns, string_agg('<|' || role || '|>' || text, chr(10) order by turn) as chat from conversations group by 1",
        "chat_extract": "select conv_id, turn, turn % 3 = 0 as has_image, case when turn % 3 = 0 then 'image/png' else '' end as mime, case when turn % 3 = 0 then text else '' end as payload from conversations",
        "encode_decode": f"""with i as (select item_id, unnest({w}) as word, generate_subscripts({w}, 1) as pos from benchmark),
            v as (select word, row_number() over (order by count(*) desc, word) - 1 as id from i group by word)
            select item_id, string_agg(cast(id as varchar), ',' order by pos) as ids, string_agg(word, ' ' order by pos) filter (where id <> 0) as text from i join v using (word) group by 1""",
        "drop_null_generations": "select user_id, string_agg(cast(event_id as varchar), ',' order by event_id) as generated from events where event_type = 'purchase' group by 1",
        "seq_integrity": f"with {labels} select seq_id, seq_id % 7 <> 0 or t[1] = -1 as whole from s",
    }
