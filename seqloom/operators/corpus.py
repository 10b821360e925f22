"""Corpus preparation: templates, samples, padding, chunks, chat, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.evaluate import strip


def template(text: Column, instruction: str) -> Column:
    """The text without image marks, stripped, and an instruction."""
    return F.concat(strip(F.replace(text, F.lit("<image>"))), F.lit(instruction))


def shuffled(key: Column, seed: int = 7919) -> Column:
    """A portable arithmetic hash of an integer id to order by."""
    return (key * seed + 104729) % 1000003


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of the hash, ties by id; rows stay whole, so columns
    stay aligned."""
    return df.orderBy(shuffled(F.col(key)), key).limit(n)


def drop_missing(df: DataFrame, generated: str) -> DataFrame:
    """``df`` without the rows for which nothing was generated."""
    return df.dropna(subset=[generated])


def replicate(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def pad(tokens: Column, length: int, stop: Column) -> Column:
    """Cut to ``length``, filled up with the stop token."""
    return F.concat(F.slice(tokens, 1, length), F.array_repeat(stop, F.greatest(F.lit(0), F.lit(length) - F.size(tokens))))


def padded(df: DataFrame, tokens: str, stop: Column) -> DataFrame:
    """Padded to the longest row, with a 0/1 mask; the length is one number."""
    longest = F.broadcast(df.agg(F.max(F.size(tokens)).alias("_longest")))
    rows = df.crossJoin(longest)  # one row
    room = F.col("_longest") - F.size(tokens)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), room))
    return rows.withColumn("mask", mask).withColumn("padded", F.concat(F.col(tokens), F.array_repeat(stop, room))).drop("_longest")


def flatten_chat(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, chat): turns in order as "role: text" lines."""
    held = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("held"))
    lines = F.transform("held", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>"), x["text"]))
    return held.select(key, F.size("held").alias("n_turns"), F.array_join(lines, "\n").alias("chat"))


DATA_URL = r"data:([a-z]+/[a-z0-9.+-]+);base64,([A-Za-z0-9+/=]+)"


def messages(role: Column, text: Column, image: Column) -> Column:
    """Chat messages of a text part and, where there is one, an image part."""
    part = lambda kind, t, url: F.struct(F.lit(kind).alias("type"), t.alias("text"), url.alias("image_url"))
    parts = F.array(part("image_url", F.lit(None).cast("string"), image), part("text", text, F.lit(None).cast("string")))
    return F.array(F.struct(role.alias("role"), F.filter(parts, lambda p: (p["type"] == "text") | p["image_url"].isNotNull()).alias("content")))


def has_image(chat: Column) -> Column:
    return F.exists(chat, lambda m: F.exists(m["content"], lambda p: p["type"] == "image_url"))


def images(chat: Column) -> Column:
    """(mime, bytes) of every data URL in a chat."""
    urls = F.flatten(F.transform(chat, lambda m: F.transform(F.filter(m["content"], lambda p: p["type"] == "image_url"), lambda p: p["image_url"])))
    return F.transform(urls, lambda u: F.struct(F.regexp_extract(u, DATA_URL, 1).alias("mime"), F.unbase64(F.regexp_extract(u, DATA_URL, 2)).alias("raw")))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(word, id): ids by falling count, then by word.  One row a word is ranked
    in parts: by count first, then within equal counts."""
    counts = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    per = counts.groupBy("n").agg(F.count("*").alias("m"))
    before = per.withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    within = F.row_number().over(Window.partitionBy("n").orderBy("word"))
    return counts.withColumn("within", within).join(before, "n").select("word", (F.col("before") + F.col("within") - 1).cast("bigint").alias("id"), "n")


def encode(tokens: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, ids) in the order of the tokens; unknown words are -1."""
    long = tokens.select(key, F.posexplode("tokens").alias("pos", "word")).join(vocab.select("word", "id"), "word", "left")
    held = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(-1)).alias("id")))).alias("held"))
    return held.select(key, F.transform("held", lambda x: x["id"]).alias("ids"))


def decode(encoded: DataFrame, vocab: DataFrame, key: str, special: tuple[int, ...] = ()) -> DataFrame:
    """(key, text): the words of the ids but special ones."""
    long = encoded.select(key, F.posexplode("ids").alias("pos", "id")).where(~F.col("id").isin(*special) if special else F.lit(True)).join(vocab.select("word", "id"), "id")
    held = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("held"))
    return held.select(key, F.array_join(F.transform("held", lambda x: x["word"]), " ").alias("text"))
