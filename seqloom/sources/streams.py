"""Token streams over the given tables: what is a sequence, in which order, of
which tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text: split at blanks and newlines, no empty ones."""
    return F.filter(F.split(text, "[ \n]"), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of words."""
    return table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("tokens"))


def ordered(df: DataFrame, key: str, order: list[str], token: Column) -> DataFrame:
    """(key, tokens): a row's tokens in the order given, which must be total."""
    held = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, token.alias("token")))).alias("held"))
    return held.select(key, F.transform("held", lambda x: x["token"]).alias("tokens"))


def event_token() -> Column:
    return (F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1).cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, tokens): numbers of event types in the order of time."""
    return ordered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], event_token())


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, tokens): roles in the order of turns."""
    return ordered(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, token, embedding): ten vectors make a sequence, labels are
    its tokens, 9 ends it."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_id"), (F.col("vec_id") % 10).cast("int").alias("pos"), F.col("label").alias("token"), "embedding"
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, tokens): return flags of an order's lines."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return ordered(table(spark, sf_dir, "lineitem"), "l_orderkey", keys, F.col("l_returnflag"))


def label_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, tokens): labels of the embedding sequences."""
    return ordered(embeddings(spark, sf_dir), "seq_id", ["pos"], F.col("token"))
