"""Readers and writers of the file formats around sequence models."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line 1 of a score file is its header, the others are failures.
SCORE_SCHEMA = """accuracy double, correct_count int, total_count int, id string, model_name string, test_category string, valid boolean,
    error array<string>, error_type string, prompt string, model_result_raw string, model_result_decoded string, possible_answer string"""
RESULT_SCHEMA = "id string, result string, input_token_count int, output_token_count int, latency double"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, or one of our own where all runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return tempfile.mkdtemp(prefix="seqloom-")


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` cut from its lineage: written to the shared folder and reread."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_log(spark: SparkSession, path: str, row: dict[str, float]) -> None:
    """A row more for a table of numbers by name."""
    spark.createDataFrame([row], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in row.items())).coalesce(1).write.mode("append").parquet(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt): a JSON list of strings, one list a file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("prompt"))


def read_prompt_records(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, img_b64, mime_type): a JSON list of records."""
    return spark.read.json(path, multiLine=True, schema="prompt string, img_b64 string, mime_type string")


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(file, output, cnst_type): evaluation outputs with their file's name."""
    df = spark.read.json(path, multiLine=True, schema="output string, cnst_type string")
    return df.select(F.col("_metadata.file_name").alias("file"), "output", "cnst_type")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=RESULT_SCHEMA)


def read_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A score file's headers and its failures."""
    df = spark.read.json(path, schema=SCORE_SCHEMA).withColumn("file", F.col("_metadata.file_name"))
    header = df.where("accuracy is not null").select("file", "accuracy", "correct_count", "total_count")
    failures = df.where("accuracy is null").drop("accuracy", "correct_count", "total_count")
    return header, failures


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Leaderboard rows; percentages as numbers, N/A as null."""
    df = spark.read.csv(path, header=True, nullValue="N/A")
    number = lambda c: F.rtrim(F.regexp_replace(F.col(f"`{c}`"), "%$", "")).cast("double").alias(c)
    return df.select(*[F.col(c) if c == "Model" else F.col(c).cast("int") if c == "Rank" else number(c) for c in df.columns])


def write_chunks(df: DataFrame, path: str, chunks: int, key: str) -> None:
    """Parquet in ``chunks`` folders by a hash of the key."""
    df.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")).write.partitionBy("chunk").parquet(path)


def read_chunks(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """Some of the chunks; the others are not read."""
    return spark.read.parquet(path).where(F.col("chunk").isin(*wanted))


def write_model(path: str, tables: dict[str, DataFrame]) -> None:
    """A checkpoint: a Parquet folder for each table."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
