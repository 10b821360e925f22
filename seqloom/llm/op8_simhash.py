"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint takes the XXH64 of each of its word shingles, repeats
included; a bit is 1 if set in over half of them.  Fingerprints that differ in
at most ``radius`` bits are linked, and components of links are the groups.

Candidates: the 64 bits are cut into ``radius + 3`` bands.  Two fingerprints
within the radius agree in at least three whole bands, so each distinct
fingerprint goes to one bucket for every choice of three bands (some 32 bits
each) and no link is lost.  A bucket is compared bit-sliced: its fingerprints
are stored as 64 vertical bit planes, a query's bits select each plane or its
complement, and carry-save counters add up the differences of all lanes at once;
a block of lanes is abandoned once every lane is past the radius.  A bucket
emits a spanning forest of its links, not the pairs.  Buckets above
``block`` fingerprints are cut into chunks of that size and compared chunk by
chunk in a second pass, so one huge bucket spreads over many tasks.

Nulls: a null text is an empty one; texts without words have fingerprint zero,
linked like any other.  A null id is the largest of its group unless all are
null, and then the group's id is null.  Repeated rows and ties each keep a row.
An empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import table, text_of, written
from seqloom.llm.components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles that are hashed, and lanes that are compared, at once.
_STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n, join, ones = max(1, len(words) - shingle + 1), b" ".join, np.zeros(64, np.int64)
    for k in range(0, n, _STEP):
        part = words[k : k + _STEP + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [part]
        h = np.array([xxh64_intdigest(join(x), 42) for x in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): fp holds the 64 bits as a signed number."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def over_radius(planes: np.ndarray, query: np.ndarray | None, radius: int) -> np.ndarray:
    """``planes`` (64, lanes / 64) of uint64, lane bits side by side; ``query``
    the 64 bits to compare with, as 0 or all ones, or None where the planes hold
    differences.  Bits of lanes past the radius, by three carry-save counters
    and a sticky overflow for radii up to 3, by comparison of the counters
    beyond."""
    n = radius.bit_length()
    counter = [np.zeros_like(planes[0]) for _ in range(n)]
    over = np.zeros_like(planes[0])
    for k in range(64):
        carry = planes[k] if query is None else planes[k] ^ query[k]
        for i in range(n):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if k % 8 == 7:
            # more than the radius: compare the counters with it from the top
            above, equal = np.zeros_like(over), ~np.zeros_like(over)
            for i in reversed(range(n)):
                if radius >> i & 1:
                    equal = equal & counter[i]
                else:
                    above |= equal & counter[i]
                    equal = equal & ~counter[i]
            if not (~(over | above)).any():
                break
    return over | above


def to_planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes; lanes are filled up with zeros to a multiple of 64."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


_ONES = np.array([0, 0xFFFFFFFFFFFFFFFF], np.uint64)


def _lanes(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), bitorder="little")[:n].astype(bool)


def _root(parent: dict, x: int) -> int:
    while (p := parent.get(x, x)) != x:
        parent[x] = parent.get(p, p)
        x = p
    return x


def _unite(parent: dict, a: int, b: int) -> None:
    a, b = _root(parent, a), _root(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def link_block(rows: np.ndarray, columns: np.ndarray, radius: int, parent: dict) -> None:
    """Unites what is within the radius of each other between two arrays of
    fingerprints.  Labels of all lanes stand in one array, so a query costs a
    pass over the planes and over the labels, not a step for each pair."""
    planes = to_planes(columns)
    every = np.unique(np.concatenate([rows, columns]))
    label = np.arange(len(every))
    at = np.searchsorted(every, columns)
    for q, own in zip(rows.tolist(), np.searchsorted(every, rows).tolist(), strict=True):
        bits = _ONES[(np.uint64(q) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)]
        near = label[at[~_lanes(over_radius(planes, bits, radius), len(columns))]]
        if (near != label[own]).any():
            merged = np.unique(np.append(near, label[own]))
            label[np.isin(label, merged)] = merged[0]
    for k in np.flatnonzero(label != np.arange(len(every))).tolist():
        _unite(parent, int(every[k]), int(every[label[k]]))


def link_runs(key: np.ndarray, fps: np.ndarray, radius: int, parent: dict, small: int = 48) -> None:
    """Runs of equal keys, each compared within itself.  The pairs of short runs
    at one distance apart make up the lanes of one comparison."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    for k in np.flatnonzero(size > small).tolist():
        run = fps[edge[k] : edge[k + 1]]
        link_block(run, run, radius, parent)
    run_of = np.repeat(np.arange(len(size)), size)
    short = (size <= small) & (size > 1)
    keep = short[run_of]
    f, r = fps[keep], run_of[keep]
    for apart in range(1, int(size[short].max(initial=1))):
        same = np.flatnonzero(r[apart:] == r[:-apart])
        for k in range(0, len(same), _STEP):
            i = same[k : k + _STEP]
            near = ~_lanes(over_radius(to_planes(f[i] ^ f[i + apart]), None, radius), len(i))
            for a, b in zip(f[i][near].tolist(), f[i + apart][near].tolist(), strict=True):
                _unite(parent, a, b)


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _out(parent: dict, kinds=("a", "b")) -> pa.RecordBatch:
    nodes = [x for x in parent]
    return pa.RecordBatch.from_arrays([pa.array(_signed(nodes)), pa.array(_signed([_root(parent, x) for x in nodes]))], list(kinds))


def bands(radius: int) -> list[list[tuple[int, int]]]:
    """Choices of three of radius + 3 bands, each band (shift, width)."""
    n = radius + 3
    cuts = [64 * k // n for k in range(n + 1)]
    return [list(x) for x in combinations([(cuts[k], cuts[k + 1] - cuts[k]) for k in range(n)], 3)]


def links(fps: DataFrame, radius: int = 3, block: int = 4096) -> DataFrame:
    """``fps`` (fp long, distinct) -> (a, b): a forest over every set of
    fingerprints that links within the radius connect."""
    keys = []
    for k, choice in enumerate(bands(radius)):
        mask = sum(((1 << w) - 1) << s for s, w in choice)
        masked = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        keys.append(F.struct(F.lit(k).cast("byte").alias("t"), masked.alias("key")))
    buckets = fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.t", "x.key", "fp")
    buckets = buckets.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    flush = 1 << 18

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        deferred, at = None, 0  # the large bucket under way, and rows of it that are passed on

        def emit(t, key, fp, chunk):
            n = len(fp)
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(key), pa.array(fp), pa.array(chunk), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64))], ["t", "key", "fp", "chunk", "a", "b"])

        def work(t, key, fp, last):
            """Compares whole buckets; passes large ones on; returns the rest."""
            nonlocal deferred, at
            edge = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]), True])
            done = edge[-1] if last else edge[-2]
            size = np.diff(edge)
            out, big = [], []
            for k in ([0] if len(size) and deferred == (t[0], key[0]) and size[0] <= block else []) + np.flatnonzero(size > block).tolist():
                lo, hi = edge[k], edge[k + 1]
                if deferred != (t[lo], key[lo]):
                    deferred, at = (t[lo], key[lo]), 0
                big.append((lo, hi))
                out.append(emit(t[lo:hi], key[lo:hi], fp[lo:hi], (at + np.arange(hi - lo)) // block))
                at += hi - lo
                done = max(done, hi)
            keep = np.zeros(len(fp), bool)
            keep[:done] = True
            for lo, hi in big:
                keep[lo:hi] = False
            run = np.cumsum(np.r_[False, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
            if keep.any():
                link_runs(run[keep], fp[keep].view(np.uint64), radius, parent)
            return out, (t[done:], key[done:], fp[done:])

        def forest():
            a = _out(parent)
            n, none = a.num_rows, lambda kind: pa.nulls(a.num_rows, kind)
            parent.clear()
            return pa.RecordBatch.from_arrays([none(pa.int8()), none(pa.int64()), none(pa.int64()), none(pa.int64()), a.column(0), a.column(1)], ["t", "key", "fp", "chunk", "a", "b"]) if n else None

        for b in batches:
            held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            if sum(len(x[0]) for x in held) < max(flush, 2 * block):
                continue
            out, rest = work(*(np.concatenate(x) for x in zip(*held, strict=True)), False)
            held = [rest] if len(rest[0]) else []
            yield from out
            if len(parent) > flush:
                yield forest()
        if held:
            out, _ = work(*(np.concatenate(x) for x in zip(*held, strict=True)), True)
            yield from out
        if (f := forest()) is not None:
            yield f

    first = written(buckets.mapInArrow(near, "t byte, key long, fp long, chunk long, a long, b long"), "simhash")
    found = first.where("t is null").select("a", "b")
    large = first.where("t is not null").select("t", "key", "fp", "chunk")
    if large.isEmpty():
        return found
    # every chunk of a large bucket meets every chunk of it once
    chunks = large.groupBy("t", "key").agg((F.max("chunk") + 1).alias("n"))
    pairs = large.join(chunks, ["t", "key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.select("t", "key", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "fp")

    def across(pdf):
        import pandas as pd

        parent: dict = {}
        one = pdf.fp[pdf.chunk == pdf.x].to_numpy().view(np.uint64)
        two = pdf.fp[pdf.chunk == pdf.y].to_numpy().view(np.uint64)
        link_block(one, two, radius, parent)
        nodes = list(parent)
        return pd.DataFrame({"a": _signed(nodes), "b": _signed([_root(parent, x) for x in nodes])})

    return found.union(pairs.groupBy("t", "key", "x", "y").applyInPandas(across, "a long, b long"))


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, block: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius, block))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, a null
    id last; of rows of one group that share that id, the text with the smallest
    hash, and of rows that share id and text, one by a hash of the row.  Ids
    needn't be unique: rows of one id with texts of different groups all stay."""
    mark = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("h"))
    first = groups(docs.select(mark.alias("doc_id"), "text"), shingle, radius).select("component_id.id", "component_id.h").distinct()
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    # columns lie in a struct, so that no name can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("of_id"), F.xxhash64(text_of()).alias("of_h"), F.xxhash64(*hashable).alias("tie"))
    kept = rows.join(first, F.col("of_id").eqNullSafe(F.col("id")) & (F.col("of_h") == F.col("h")), "left_semi")
    place = F.row_number().over(Window.partitionBy("of_id", "of_h").orderBy("tie"))
    return kept.withColumn("place", place).where("place = 1").select("row.*")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
