"""Token counts by a linear longest-match automaton.

Greedy longest match cuts a word into the longest vocabulary piece at each
place.  The vocabulary is a trie; its nodes carry failure links and the number
of tokens popped on the way along them, both found once.  A word is then read
symbol by symbol: where the trie has no edge, the popped count is added and the
failure link followed.  The number of pieces comes out without any piece being
built, in time linear in the word's length.

Words are runs other than blanks and the controls 9 to 13, lower-cased by the
rules of Unicode.  A word's UTF-8 bytes are spelled in the byte letters of a
public vocabulary (``word_bpe_49k.json``: its path is a parameter).  Pieces with
the end-of-word mark stand only at a word's end, others only before it; a byte
by itself is always a piece.

Nulls: a null text has no words and no tokens, a null id is kept.  Repeated rows
each give a row.  An empty table gives an empty result.  Only doc_id and text
are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import table

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


def read_pieces(path: str) -> list[tuple[int, ...]]:
    """The vocabulary's pieces as symbols: bytes, END for the end of a word."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters, pieces = byte_letters(), []
    for piece in vocabulary:
        body, end = (piece[:-4], (END,)) if piece.endswith("</w>") else (piece, ())
        if body and all(c in letters for c in body):
            pieces.append(tuple(letters[c] for c in body) + end)
    return pieces


class Automaton:
    """Trie with failure links: ``step[node]`` maps a byte to the next node,
    ``fail[node]`` and ``pops[node]`` are where to go and how many tokens are
    complete if another byte follows for which there is no edge; ``at_end``
    gives the tokens of a node's bytes if the word ends there."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.step: list[dict[int, int]] = [{}]
        self.path: list[tuple[int, ...]] = [()]
        inner, self.last = {0: False}, set()
        for piece in [*pieces, *((b,) for b in range(256))]:  # a byte by itself is always a token
            node, end = 0, piece[-1] == END
            for k, symbol in enumerate(piece[:-1] if end else piece):
                if symbol not in self.step[node]:
                    self.step[node][symbol] = len(self.step)
                    self.step.append({})
                    self.path.append(piece[: k + 1])
                node = self.step[node][symbol]
            if end:
                self.last.add(node)
            else:
                inner[node] = True
        self.fail, self.pops = [0] * len(self.step), [0] * len(self.step)
        #: Length of the longest piece that begins a node's bytes and is shorter.
        self.shorter, self.ends = [0] * len(self.step), {}
        level = [0]
        while level:
            after = []
            for node in level:
                for symbol, child in self.step[node].items():
                    after.append(child)
                    self.shorter[child] = len(self.path[node]) if inner.get(node) else self.shorter[node]
                    if inner.get(child):
                        self.pops[child] = 1
                        continue
                    # pop tokens of the parent's match until the byte goes on
                    z, popped = self.fail[node], self.pops[node]
                    while symbol not in self.step[z]:
                        z, popped = self.fail[z], popped + self.pops[z]
                    self.fail[child], self.pops[child] = self.step[z][symbol], popped
            level = after

    def at_end(self, node: int) -> int:
        """The last piece of a word has to be one that ends words (or a byte)."""
        if node in self.last or len(self.path[node]) == 1:
            return 1
        if node not in self.ends:
            self.ends[node] = 1 + self.count(self.path[node][self.shorter[node] :])
        return self.ends[node]

    def count(self, word) -> int:
        step, fail, pops = self.step, self.fail, self.pops
        node = total = 0
        for s in word:
            while (after := step[node].get(s)) is None:
                total += pops[node]
                node = fail[node]
            node = after
        return total + self.at_end(node)


@lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(read_pieces(path))


def _table() -> dict[int, str]:
    return {c: " " for c in (9, 10, 11, 12, 13)}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, cached: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_tokens, longest: the most tokens in a word).

    ``cached`` words of a task keep their count; the cache starts anew when it
    is full, which changes no result."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    # the vocabulary travels with the job, so executors need no copy of their own
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    blanks = _table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = automaton(SparkFiles.get(name)).count
        seen: dict[str, int] = {}
        for b in batches:
            n_words, n_tokens, longest = [], [], []
            for t in b.column(1).to_pylist():
                ns = []
                # split on a blank alone: str.split() would cut at more spaces
                words = [w for w in (t or "").lower().translate(blanks).split(" ") if w]
                for w in words:
                    n = seen.get(w)
                    if n is None:
                        n = count(w.encode())
                        if len(w) <= 64:
                            if len(seen) >= cached:
                                seen.clear()
                            seen[w] = n
                    ns.append(n)
                n_words.append(len(ns))
                n_tokens.append(sum(ns))
                longest.append(max(ns, default=0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(longest, pa.int64())], ["doc_id", "n_words", "n_tokens", "longest"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, longest long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
