"""Benchmark decontamination: BM25 retrieval with block-max WAND, then a check
of question and answer.

The test items are indexed, not the corpus.  Items are indexed by size: an
item's cell is the least ``64 * 2**k`` words that hold it and a quarter more, so
the cell depends on the item alone.  For each size a document is read as
overlapping passages of two cells; an item's whole occurrence lies in one of
them, and what counts as one occurrence is never longer than some four times the
item (128 words for the short ones).  Every passage is a query.  Term weights
are BM25's, divided by the item's score for itself; an item is retrieved if its
score is ``threshold`` or more.

Upper bounds come first: the largest weight of every term in each block of
items, summed over a passage's terms for all blocks of a batch of documents at
once.  Passages with no block at the threshold can retrieve nothing.  The others
run block-max WAND over the posting lists of the blocks that are left: a pivot by
the terms' maxima, then the maxima of the posting blocks around the pivot, then
the exact score.

A retrieved item counts as a leak if the passage holds ``similarity`` or more of
the five-word shingles of its question and of the words of its answer.  The
answer is the item's last sentence, or, of a single sentence, its last third.

Words are lower-cased runs of characters other than ASCII blanks, controls and
punctuation.  A text is turned into numbers of the items' terms at once, some
``at_once`` code points at a time, so neither a long text nor a batch of them is
held as words.  The index is broadcast in shards of at most ``shard_bytes`` of
item text, each a pass over the corpus; one shard is on the driver at a time.
Document frequencies and the mean length are those of all items and passages
those of each item, so the number of shards changes nothing, and other items
change a result only through these frequencies.

Nulls: a null text or item is an empty one and never a leak; a null id is kept.
Ids may have any type.  Items without words are never retrieved.  Repeated items
and rows each give a row.  Empty tables give an empty result (or, filtering, the
documents as they are).  Columns other than the ids and texts pass through unread.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.llm.common import table, written

_PUNCTUATION = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_BLANK = re.compile(r"[\x20\x09-\x0d]")
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def parts_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """An item's question and answer."""
    sentences = [w for s in re.split(r"(?<=[.?!])\s+", text or "") if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = [w for s in sentences for w in s]
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def cell_of(n_words: int) -> int:
    """Words of a cell for an item of ``n_words``."""
    cell = 64
    while cell < n_words + n_words // 4:
        cell *= 2
    return cell


def shingles(words: list, n: int = 5) -> set[tuple]:
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


class Sized:
    """Inverted index of the BM25 weights of items of one size.  Terms are the
    numbers that the shard gives them."""

    def __init__(self, cell: int, items: list[tuple[object, list[int], list[int]]], n_terms: int, weight, block: int = 4, posting_block: int = 8, most_blocks: int = 256):
        # a table of terms by blocks: larger blocks keep its size in proportion to the items
        block = max(block, -(-len(items) // most_blocks))
        self.cell, self.block, self.posting_block = cell, block, posting_block
        self.ids, self.parts = [i for i, _, _ in items], [(q, a) for _, q, a in items]
        self.shingles = [shingles(q) for q, _ in self.parts]
        entries: dict[int, list[tuple[int, float]]] = {}
        for k, (q, a) in enumerate(self.parts):
            weights = {t: weight(t, tf, len(q) + len(a)) for t, tf in Counter(q + a).items()}
            own = sum(weights.values())
            for t, x in weights.items():
                entries.setdefault(t, []).append((k, x / own))
        self.upper = np.zeros((n_terms, max(1, -(-len(items) // block))), np.float32)
        self.lists: dict[int, tuple[list[int], list[float], list[float], float]] = {}
        for t, found in entries.items():
            for k, x in found:
                # rounded up, so that the bound stays one
                self.upper[t, k // block] = max(self.upper[t, k // block], np.nextafter(np.float32(x), np.float32(2)))
            docs, ws = [k for k, _ in found], [x for _, x in found]
            self.lists[t] = (docs, ws, [max(ws[j : j + posting_block]) for j in range(0, len(ws), posting_block)], max(ws))

    def wand(self, terms: list[int], threshold: float, lo: int = 0, hi: int | None = None) -> list[tuple[int, float]]:
        """Items from ``lo`` to before ``hi`` whose score for ``terms`` is the
        threshold or more."""
        n, found, eps = self.posting_block, [], 1e-9
        hi = len(self.ids) if hi is None else hi
        lists = [x for t in terms if (x := self.lists.get(t))]
        at = [[x, p] for x in lists if (p := bisect_left(x[0], lo)) < len(x[0]) and x[0][p] < hi]
        while at:
            at.sort(key=lambda x: x[0][0][x[1]])
            total, pivot = 0.0, -1
            for k, (x, _) in enumerate(at):
                total += x[3]
                if total >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = at[pivot][0][0][at[pivot][1]]
            while pivot + 1 < len(at) and at[pivot + 1][0][0][at[pivot + 1][1]] == doc:
                pivot += 1
            # the blocks that hold the pivot or what follows it
            bound, beyond = 0.0, at[pivot + 1][0][0][at[pivot + 1][1]] if pivot + 1 < len(at) else math.inf
            for x, p in at[: pivot + 1]:
                b = p // n
                while b * n < len(x[0]) and x[0][min(len(x[0]), (b + 1) * n) - 1] < doc:
                    b += 1
                if b * n < len(x[0]):
                    bound += x[2][b]
                    beyond = min(beyond, x[0][min(len(x[0]), (b + 1) * n) - 1] + 1)
            if bound >= threshold - eps:
                score = 0.0
                for entry in at[: pivot + 1]:
                    x, p = entry
                    while p < len(x[0]) and x[0][p] < doc:
                        p += 1
                    if p < len(x[0]) and x[0][p] == doc:
                        score += x[1][p]
                        p += 1
                    entry[1] = p
                if score >= threshold - eps:
                    found.append((doc, score))
            else:
                goal = max(beyond, doc + 1)
                for entry in at[: pivot + 1]:
                    x, p = entry
                    while p < len(x[0]) and x[0][p] < goal:
                        p += 1
                    entry[1] = p
            at = [x for x in at if x[1] < len(x[0][0]) and x[0][0][x[1]] < hi]
        return found

    def overlap(self, item: int, passage: list[int]) -> tuple[float, float]:
        question, answer = self.parts[item]
        asked, there = self.shingles[item], shingles(passage, min(5, len(question)) or 1)
        both = Counter(answer) & Counter(passage)
        return len(asked & there) / len(asked) if asked else 1.0, sum(both.values()) / len(answer) if answer else 1.0

    def leaks(self, texts: list[np.ndarray], threshold: float, similarity: float, room: int = 1 << 21) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(text, item, passage, score, question and answer overlap) of texts as
        terms, -1 for other words; ``room`` numbers are gathered at once."""
        cell, (n_terms, blocks) = self.cell, self.upper.shape
        lengths = np.array([len(t) for t in texts], np.int64)
        counts = -(-lengths // cell)
        first = np.concatenate([[0], np.cumsum(counts)])
        ids = np.concatenate(texts)
        cells = np.repeat(first[:-1], lengths) + (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // cell
        known = ids >= 0
        of, term = np.divmod(np.unique(cells[known] * n_terms + ids[known]), n_terms)
        # a passage is a cell and the next; past a text's last cell the bound is only larger
        step = max(1, room // (blocks * cell))
        for c in range(0, int(first[-1]), step):
            lo, hi = np.searchsorted(of, [c, c + step + 1])
            if lo == hi:
                continue
            here, bounds = of[lo:hi] - c, np.zeros((step + 1, blocks), np.float32)
            starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            bounds[here[starts]] = np.add.reduceat(self.upper[term[lo:hi]], starts, axis=0)
            hot = c + np.flatnonzero((bounds[:-1] + bounds[1:]).max(axis=1) >= threshold - 1e-4)
            for c_hot in hot[hot < first[-1]].tolist():
                k = int(np.searchsorted(first, c_hot, "right")) - 1
                p = c_hot - int(first[k])
                if p and p == counts[k] - 1:
                    continue  # a last cell alone is part of the passage before
                passage = texts[k][p * cell : (p + 2) * cell].tolist()
                terms = [t for t in dict.fromkeys(passage) if t >= 0]
                # without what both cells have counted twice, few blocks are left
                for block in np.flatnonzero(self.upper[terms].sum(0) >= threshold - 1e-4).tolist():
                    for item, score in self.wand(terms, threshold, block * self.block, (block + 1) * self.block):
                        q, a = self.overlap(item, passage)
                        if q >= similarity and a >= similarity:
                            yield k, item, p, score, q, a


class Index:
    """A shard of the items: their terms, and an index for each size."""

    def __init__(self, items: list[tuple[object, str]], df: dict[bytes, int], n_items: int, mean_len: float):
        self.term: dict[bytes, int] = {}
        rarity: list[float] = []
        by_cell: dict[int, list] = {}

        def number(word: bytes) -> int:
            t = self.term.setdefault(word, len(rarity))
            if t == len(rarity):
                rarity.append(math.log(1 + (n_items - df[word] + 0.5) / (df[word] + 0.5)))
            return t

        def weight(t: int, tf: int, length: int) -> float:
            return rarity[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_len))

        for i, text in items:
            q, a = parts_of(text)
            if q or a:
                by_cell.setdefault(cell_of(len(q) + len(a)), []).append((i, [number(w) for w in q], [number(w) for w in a]))
        self.sizes = [Sized(cell, own, len(self.term), weight) for cell, own in sorted(by_cell.items())]

    def numbers(self, text: str, step: int = 1 << 20) -> np.ndarray:
        """The text's words as terms, -1 for words that no item has; ``step`` code
        points, on to the next blank, are held as words."""
        out, at = [], 0
        while at < len(text):
            end = at + step
            if end < len(text):
                blank = _BLANK.search(text, end)
                end = blank.start() if blank else len(text)
            words = words_of(text[at:end])
            out.append(np.fromiter(map(self.term.get, words, repeat(-1)), np.int32, len(words)))
            at = end
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.int32)])

    def leaks(self, texts: pa.Array, threshold: float, similarity: float, at_once: int = 1 << 20) -> Iterator[tuple[int, object, int, float, float, float]]:
        """(text, item's id, passage, score, question and answer overlap)."""
        held, lo = [], 0
        size = 0
        for k in range(len(texts)):
            text = texts[k].as_py() or ""
            held.append(self.numbers(text))
            size += len(text)
            if size >= at_once or k == len(texts) - 1:
                if size:
                    for own in self.sizes:
                        for j, item, *rest in own.leaks(held, threshold, similarity):
                            yield lo + j, (own.cell, item, own.ids[item]), *rest
                held, lo, size = [], k + 1, 0


def indexes(benchmark: DataFrame, shard_bytes: int = 8 << 20) -> Iterator[Index]:
    """An index for each shard of the items, one after the other."""
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                ws = Counter(words_of(t))
                yield pa.RecordBatch.from_arrays([pa.array([*ws, None], pa.binary()), pa.array([sum(ws.values())] * (len(ws) + 1), pa.int64())], ["term", "len"])

    terms = items.select("text").mapInArrow(tokens, "term binary, len long")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n:
        return
    mean = max(1.0, terms.where("term is null").agg(F.avg("len")).first()[0] or 1.0)
    shards = max(1, -(-size // shard_bytes))
    df = terms.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    for s in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s) if shards > 1 else items
        own = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is not None, str(r[0]), r[1]))
        mine = df.join(part.select("text").mapInArrow(tokens, "term binary, len long").select("term").distinct(), "term") if shards > 1 else df
        yield Index(own, {bytes(r[0]): r[1] for r in mine.collect()}, n, mean)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, similarity: float = 0.8, shard_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, the
    first passage, the best score and overlaps."""
    spark, kind, item = docs.sparkSession, docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind.simpleString()}, item_id {item.simpleString()}, passage long, score double, question_overlap double, answer_overlap double"
    item_kind, out, shared = to_arrow_type(item), None, None
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for index in indexes(benchmark, shard_bytes):
        if out is not None:
            # a shard's rows are written before the next shard is made
            out = written(out, "leaks")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                best: dict[tuple, tuple] = {}
                for k, i, p, *rest in shared.value.leaks(b.column(1), threshold, similarity):
                    if (k, i) not in best or rest[0] > best[k, i][1]:
                        best[k, i] = (p, *rest)
                ids = b.column(0).take(pa.array([k for k, _ in best], pa.int64()))
                cols = [list(x) for x in zip(*best.values(), strict=True)] or [[], [], [], []]
                items = pa.array([i[2] for _, i in best], item_kind)
                yield pa.RecordBatch.from_arrays([ids, items, pa.array(cols[0], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[1:])], ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, similarity: float = 0.8, shard_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without those that leak an item.  Rows pass through the search,
    so nothing is shuffled."""
    at, out, shared = docs.columns.index("text"), docs, None
    for index in indexes(benchmark, shard_bytes):
        if shared is not None:
            out = written(out, "clean")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gone = {x[0] for x in shared.value.leaks(b.column(at), threshold, similarity)}
                yield b.filter(pa.array([k not in gone for k in range(b.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
