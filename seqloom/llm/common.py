"""What the training-data operators share: tables, words, row keys and tables
written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where
    the session names none and all runs on this machine, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` cut from its lineage: written once as Parquet to the shared
    folder, in a folder for each value of ``by``, and reread, so that a lost
    executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``df``, which nothing may read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def words_below(words: list[bytes], longest: int = 64) -> list[bytes]:
    """Words of at most ``longest`` bytes, which bounds what a broadcast of a
    bounded number of them can hold."""
    return [w for w in words if len(w) <= longest]
