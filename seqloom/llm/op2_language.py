"""Language identification by Bayesian evidence fusion.

Evidence, all of it counted over the whole input:

* the text: a multinomial model of trigrams of letter bytes (hashed to
  ``buckets``) for each language, learned from all texts by what they declare; half
  of the trigrams may be of no language, so that a few that no text has don't
  outweigh the others of a short text;
* the declared markup language and the address suffix: how often each value
  stands with texts that read as each language, by grouped aggregation;
* the host: a prior smoothed from the host to its parent domain to the whole,
  again by grouped aggregation, so that a host with few pages leans on what
  stands above it.  Hosts without a domain (a document's source) have all of their
  like as parent.

What a row's own text adds to these counts is taken out for the row itself.

A text's likelihood is tempered: trigrams overlap and repeat, so beyond
``full_weight`` trigrams their sum counts as their mean does.  One more outcome,
``und``, reads trigrams as uniform: a text that no language explains better is
rejected, as is one whose best language stays below ``accept``.

Nulls: a null or empty text has no likelihood and is judged by the other
evidence alone; a null declaration, suffix or host says nothing or is a host of
its own.  Declarations outside ``languages`` are evidence like any other value
but train no model; if nothing is declared at all, texts aren't judged by their
trigrams and those that have a letter are accepted.  Repeated rows and ties each
give a row; equal posteriors go to the language listed first.  An empty table
gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import table, written

LANGUAGES = ("en", "de", "fr", "es")
BUCKETS = 8192


#: What a byte counts as: letters as themselves, white space as a blank, digits
#: and other signs as nothing, so that numbers and keys say nothing of a language.
_LETTER = np.zeros(256, np.uint32)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_LETTER[[9, 10, 11, 12, 13, 32]] = 32


def trigram_buckets(raw: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of the trigrams of letters and blanks."""
    x = _LETTER[raw]
    there = (x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0)
    mixed = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    return (mixed[there] >> np.uint32(11)) % np.uint32(buckets)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls and each value's bounds."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes whose trigrams are handled at once.
_STEP = 1 << 20


def _pieces(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, buckets of some of its trigrams), every trigram once, texts in order;
    never more than _STEP trigrams of a text at a time."""
    for k in range(len(at) - 1):
        lo, hi = int(at[k]), int(at[k + 1])
        for s in range(lo, hi - 2, _STEP):
            yield k, trigram_buckets(raw[s : min(hi, s + _STEP + 2)])


def _text_bytes(column: str = "text") -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary")


def trigram_model(docs: DataFrame, declared: Column, languages: tuple[str, ...], buckets: int = BUCKETS) -> tuple[np.ndarray, bool]:
    """Log probabilities (languages and und, buckets), and whether any text
    declared one of the languages.  What comes to the driver is one sum for each
    language and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), buckets), np.int64)
        for b in batches:
            raw, at = _bytes_of(b.column(1))
            which = b.column(0).to_numpy(zero_copy_only=False)
            for k, grams in _pieces(raw, at):
                counts[which[k]] += np.bincount(grams, minlength=buckets)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])], ["lang", "bucket", "n"])

    index = F.array_position(F.array(*map(F.lit, languages)), F.coalesce(declared, F.lit(""))) - 1
    known = docs.select(index.cast("int").alias("lang"), _text_bytes().alias("text")).where("lang >= 0")
    sums = known.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.full((len(languages) + 1, buckets), 0.5)
    for lang, bucket, n in sums:
        counts[lang, bucket] += n
    counts[-1] = 1
    model = np.log(0.5 * counts / counts.sum(1, keepdims=True) + 0.5 / buckets)
    # a language that no text declares has no model: no text reads as it
    model[[k for k in range(len(languages)) if k not in {r[0] for r in sums}]] = -50
    return model, bool(sums)


def read_texts(docs: DataFrame, keep: dict[str, Column], model: np.ndarray, full_weight: int = 200) -> DataFrame:
    """``keep``'s columns, ``n`` trigrams and ``ll``: the tempered log likelihood
    of each language and und."""
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], _text_bytes().alias("lid_text"))
    out = rows.drop("lid_text").schema.add("n", T.LongType()).add("ll", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            raw, at = _bytes_of(b.column(b.num_columns - 1))
            n = np.zeros(len(at) - 1, np.int64)
            ll = np.zeros((len(n), table.shape[1]))
            for k, grams in _pieces(raw, at):
                n[k] += len(grams)
                # the sum over buckets: a text has at most as many as the model
                if len(grams) > 4 * len(table):
                    ll[k] += np.bincount(grams, minlength=len(table)) @ table
                else:
                    ll[k] += table[grams].sum(0)
            ll *= (np.minimum(1, full_weight / np.maximum(1, n)))[:, None]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n), pa.array(list(ll), pa.list_(pa.float64()))], [*b.schema.names[:-1], "n", "ll"])

    return rows.mapInArrow(run, out)


def _logs(counts: Column, prior: Column, alpha: float) -> Column:
    """Log of counts smoothed towards a prior distribution."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + alpha * p) / (total + alpha))


def _counts(best: Column, n: int) -> Column:
    return F.array(*[F.sum(F.when(best == k, 1.0).otherwise(0.0)) for k in range(n)])


def fuse(read: DataFrame, languages: tuple[str, ...], trained: bool, accept: float = 0.5, alpha: float = 20.0) -> DataFrame:
    """``read``'s columns but ll, with lang, posterior and accepted.

    ``read`` has declared, suffix, host and parent; counts by declared value and
    suffix are smoothed to the whole, by host to its parent and that to the
    whole, each without what the row itself adds.  Values are joined, not broadcast
    by us: their number is not bounded."""
    m = len(languages)
    best = F.expr(f"array_position(slice(ll, 1, {m}), array_max(slice(ll, 1, {m}))) - 1")
    told = read.where("n > 0").withColumn("best", best)
    flat = F.array(*[F.lit(1.0 / m)] * m)
    whole = told.agg(_counts(F.col("best"), m).alias("w")).select(F.transform("w", lambda x: F.coalesce(x, F.lit(0.0))).alias("w")).select(_logs(F.col("w"), flat, 1.0).alias("whole"))
    whole = F.array(*[F.lit(float(x)) for x in whole.first()[0]])
    parents = told.groupBy("parent").agg(_counts(F.col("best"), m).alias("pc")).select(F.col("parent").alias("p_parent"), "pc")
    hosts = told.groupBy("host", "parent").agg(_counts(F.col("best"), m).alias("c")).join(parents, F.col("parent").eqNullSafe(F.col("p_parent")))
    hosts = hosts.select(F.col("host").alias("h_host"), F.col("parent").alias("h_parent"), F.col("c").alias("h_counts"), F.col("pc").alias("p_counts"))
    out = read.join(written(hosts, "hosts"), F.col("host").eqNullSafe(F.col("h_host")) & F.col("parent").eqNullSafe(F.col("h_parent")), "left")
    # a row's own guess counts for others only
    out = out.withColumn("own", F.transform(F.array(*map(F.lit, range(m))), lambda k: ((F.col("n") > 0) & (k == best)).cast("double")))
    others = lambda c: F.zip_with(F.col(c), F.col("own"), lambda a, b: a - b)
    prior = F.coalesce(_logs(others("h_counts"), _logs(others("p_counts"), whole, alpha), alpha), whole)
    if not trained:
        names = F.array(*map(F.lit, languages))
        declared = F.when(F.array_contains(names, F.col("declared")), F.col("declared"))
        return out.select(*[c for c in read.columns if c != "ll"], declared.alias("lang"), F.lit(None).cast("double").alias("posterior"), (F.col("n") > 0).alias("accepted"))
    parts = [F.slice("ll", 1, m), F.transform(prior, lambda p: F.log(p))]
    for name in ("declared", "suffix"):
        # P(value | language), up to what is common to all languages
        values = told.where(F.col(name).isNotNull()).groupBy(name).agg(_counts(F.col("best"), m).alias("c"))
        values = values.select(F.col(name).alias(f"v_{name}"), F.col("c").alias(f"c_{name}"))
        out = out.join(written(values, name), F.col(name) == F.col(f"v_{name}"), "left")
        said = F.zip_with(_logs(others(f"c_{name}"), whole, 1.0), whole, lambda a, w: F.log(a) - F.log(w))
        parts.append(F.coalesce(said, F.array(*[F.lit(0.0)] * m)))
    total = parts[0]
    for x in parts[1:]:
        total = F.zip_with(total, x, lambda a, b: a + b)
    # und: uniform trigrams, one in a hundred, nothing said by the rest
    total = F.concat(total, F.when(F.col("n") > 0, F.array(F.element_at("ll", m + 1) + F.log(F.lit(0.01)))).otherwise(F.array(F.lit(-1e30))))
    out = out.select(*[c for c in read.columns if c != "ll"], total.alias("lp"))
    out = out.withColumn("top", F.array_max("lp"))
    out = out.withColumn("posterior", 1 / F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    out = out.withColumn("lang", F.element_at(F.array(*map(F.lit, (*languages, "und"))), F.array_position("lp", F.col("top")).cast("int")))
    return out.withColumn("accepted", (F.col("lang") != "und") & (F.col("posterior") >= accept)).drop("lp", "top")


def identify(
    docs: DataFrame, keep: dict[str, Column], declared: Column, host: Column, suffix: Column | None = None, languages: tuple[str, ...] = LANGUAGES, full_weight: int = 200, accept: float = 0.5
) -> DataFrame:
    """``keep``'s columns, declared, n, lang, posterior and accepted."""
    declared = F.lower(F.regexp_extract(declared.cast("string"), "^[a-zA-Z]{2,3}", 0))
    declared = F.when(declared != "", declared)
    model, trained = trigram_model(docs, declared, languages)
    parent = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    keep = keep | {"declared": declared, "suffix": suffix if suffix is not None else F.lit(None).cast("string"), "host": host, "parent": F.when(parent != "", parent)}
    read = written(read_texts(docs, keep, model, full_weight), "languages")
    return fuse(read, languages, trained, accept).drop("suffix", "host", "parent")


def identify_documents(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """Documents declare ``lang`` and come from ``source``."""
    return identify(docs, keep, F.col("lang"), F.col("source").cast("string"))


def identify_pages(pages: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """Pages declare ``<html lang>``; the suffix is the first part of the path or
    else of the host's end that is two letters long; html without tags is the text."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    rows = pages.select(*[c.alias(f"keep_{k}") for k, c in keep.items()], F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z-]+)", 1).alias("lang"), url.alias("url"), F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ").alias("text"))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    path, end = F.regexp_extract("url", r"^[^:]*://[^/]*/([a-z]{2})(?=[/?#]|$)", 1), F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return identify(rows, {k: F.col(f"keep_{k}") for k in keep}, F.col("lang"), host, F.when(path != "", path).when(end != "", end))


def _keys(names: list[str]) -> dict[str, Column]:
    cols = [F.col(f"`{c}`") for c in names]
    return {"key1": F.xxhash64(*cols), "key2": F.hash(*cols)}


def accepted_only(docs: DataFrame) -> DataFrame:
    """``docs`` without those that are rejected.  The rejects, by hashes of their
    rows, are written first, so that Spark knows their size when it picks the join."""
    names = docs.columns
    key = [c for c in ("doc_id", "text", "lang", "source") if c in names]
    rejected = written(identify_documents(docs, _keys(key)).where("not accepted").select("key1", "key2").distinct(), "rejected")
    keys = _keys(key)
    return docs.join(rejected, (keys["key1"] == rejected.key1) & (keys["key2"] == rejected.key2), "left_anti")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document (page_id null) and for every page (doc_id null)."""
    names = ("lang", "posterior", "declared", "accepted")
    docs = identify_documents(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}).select("doc_id", *names)
    pages = identify_pages(table(spark, sf_dir, "pages"), {"page_id": F.col("page_id")}).select("page_id", *names)
    return docs.unionByName(pages, allowMissingColumns=True)
