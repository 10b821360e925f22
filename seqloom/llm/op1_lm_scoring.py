"""Language-model scores: corpus counts and a causal self-attention model.

A text is its lower-cased words and one end.  The model mixes, word by word,

* the word's smoothed share of all training tokens, counted over the whole
  training part (the base score's probability);
* the product of the probabilities of its subword pieces (a public byte-level
  vocabulary), each the probability of the piece's class given the pieces before
  it, by causal self-attention, times the piece's share of its class.

So frequent words keep their counts and unseen words still get what their pieces
and context say.  The ``own`` most frequent pieces are classes of their own, the
others share some, by whether they begin a word.

All is learned from the whole training part, nothing capped or sampled: counts of
words, pieces and transitions are sums; the texts are dealt into ``rounds`` by a
hash of the id, and each round's gradient, summed over all its texts, makes one
step of the attention's parameters, so every text is learned from once.  In the
same rounds the mixing weight is found that suits the training texts best, each
word's own occurrence left out of its count.  No held-out text takes part.  Sums
over tasks are all that is passed on: how rows lie in files or tasks changes a
score by rounding only.

A text is read in stretches of ``STRETCH`` words, each with a context of its own,
so a long text needs no more memory than a short one.  Words have their whole
spelling.  The ``hot`` most frequent words (of at most 64 bytes, so the broadcast is
bounded) are scored where the text is read; other occurrences are joined with the
table of counts.

Nulls: a null text is an empty one, only an end.  A null id counts as the empty
text for the split.  Repeated rows each give a row.  Without training rows every
count is 0 and the model is as initialised.  An empty table gives an empty
result.  Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.llm.attention import Adam, Attention, transitions, values_of
from seqloom.llm.common import crc_mod, removed, table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Words that are read with one context.
STRETCH = 8192
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Stands for the end among words: no word holds a blank.
END = b" "
#: The class of the end, which also stands before every stretch.
START = 0
#: Pieces that are looked at together.
_ROOM = 1 << 18
#: What a worker has made of the last vocabulary and of the last broadcast.
_ENCODERS: dict = {}
_WORDS: dict = {}


class Encoder:
    """Pieces of words, each with its leading blank; the end is the last piece."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = len(ranks) + 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[k for piece, k in ranks.items() if piece.startswith(b" ")] + [self.size - 1]] = True
        self.encode = tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words one after the other, and how many each has."""
        spelled = [w for w in words if w != END]
        ids = np.array(self.encode((b" " + b" ".join(spelled)).decode("utf-8", "replace")) if spelled else [], np.int64)
        if len(spelled) < len(words):
            # an end goes before the next word's first piece
            first = np.append(np.flatnonzero(self.begins[ids]), len(ids))
            before = np.cumsum([w != END for w in words])[[w == END for w in words]]
            ids = np.insert(ids, first[before], self.size - 1)
        return ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))


def encoder(name: str) -> Encoder:
    path = SparkFiles.get(name)
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def parts_of(text: bytes | None, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of about ``step`` bytes of text at a time, on to the next blank."""
    at = 0
    while at < len(text or b""):
        end = at + step
        if end < len(text):
            blank = _BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield words_of(text[at:end])
        at = end


def stretches(text: bytes | None, size: int = STRETCH) -> Iterator[list[bytes]]:
    """``size`` words at a time; the last has the rest and the end."""
    held: list[bytes] = []
    for words in parts_of(text):
        held += words
        full = max(0, len(held) - 1) // size * size
        for k in range(0, full, size):
            yield held[k : k + size]
        held = held[full:]
    yield [*held, END]


def gathered(stretched: Iterator[tuple], room: int = _ROOM) -> Iterator[list[tuple]]:
    """(..., words) tuples in lists of about ``room`` words."""
    held, size = [], 0
    for x in stretched:
        held.append(x)
        size += len(x[-1])
        if size >= room:
            yield held
            held, size = [], 0
    if held:
        yield held


def _training(docs: DataFrame, *more) -> DataFrame:
    return docs.where(crc_mod("doc_id", 10) != 0).select(F.col("text").cast("binary").alias("text"), *more)


def word_counts(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """(word, n) over the training part, the end included.  Tasks sum what they
    read before the shuffle, at most some ``held`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return b

        for b in batches:
            for k in range(b.num_rows):
                for words in parts_of(b.column(0)[k].as_py()):
                    counts.update(words)
                    if len(counts) >= held:
                        yield out()
                counts[END] += 1
        yield out()

    return _training(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, hot: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``hot`` words of 64 bytes or fewer, with their counts: all that are
    at least so frequent, the bound found from a histogram of some hundred steps."""
    short = counts.where(F.octet_length("word") <= 64).withColumn("step", F.floor(F.log2("n") * 8))
    steps, held, least = short.groupBy("step").agg(F.count("*").alias("c")).orderBy(F.col("step").desc()).collect(), 0, None
    for s in steps:
        held += s.c
        if held > hot:
            break
        least = s.step
    if least is None:
        return [], np.zeros(0, np.int64)
    got = short.where(F.col("step") >= least).select(F.col("word").cast("binary").alias("word"), "n").toArrow().sort_by("word")
    return got["word"].to_pylist(), got["n"].to_numpy()


def piece_counts(counts: DataFrame, name: str, size: int) -> np.ndarray:
    """Occurrences of every piece, from the words' counts; one row for each piece
    of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sums = encoder(name), np.zeros(size, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                ids, lengths = encode.pieces(part.column(0).to_pylist())
                np.add.at(sums, ids, np.repeat(part.column(1).to_numpy(), lengths))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["piece", "n"])

    rows = counts.select(F.col("word").cast("binary").alias("word"), "n").mapInArrow(run, "piece long, n long")
    out = np.zeros(size)
    got = rows.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out[got["piece"].to_numpy()] = got["n"].to_numpy()
    return out


class Pieces:
    """Classes of pieces, each piece's share of its class, the classes' shares."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray, classes: int, own: int):
        order = np.argsort(-counts, kind="stable")
        order = order[order != len(counts) - 1]
        self.of = np.zeros(len(counts), np.uint8)
        self.of[order[: own - 1]] = np.arange(1, own)
        rest, half = order[own - 1 :], (classes - own) // 2
        self.of[rest] = own + np.where(begins[rest], 0, half) + np.arange(len(rest)) % half
        self.of[-1] = START
        smoothed = counts + 0.1
        mass = np.bincount(self.of, smoothed, classes)
        self.log_share = np.log(smoothed / mass[self.of])
        self.own = mass / mass.sum()


class Words:
    """By number, the classes of a word's pieces, the sum of their log shares and
    the word's count.  The frequent words have the first numbers; others get the
    next ones for the call only, and the count -1."""

    def __init__(self, encode: Encoder, pieces: Pieces, words: list[bytes], counts: np.ndarray):
        self.encode, self.pieces, self.counts = encode, pieces, counts
        self.index = dict(zip(words, range(len(words)), strict=True))
        self.spelled = self._spell(words)

    def _spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [self.encode.pieces(words[k : k + 4096]) for k in range(0, len(words), 4096)]
        ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        share = np.add.reduceat(self.pieces.log_share[ids], np.cumsum(lengths) - lengths) if len(ids) else np.zeros(0)
        return self.pieces.of[ids], lengths, share

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words one after the other: their pieces' classes, how many each has,
        the sums of log shares, and counts (-1: not at hand)."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        cold = np.flatnonzero(at < 0)
        classes, lengths, share = self.spelled
        if len(cold):
            new = {w: len(self.index) + k for k, w in enumerate(dict.fromkeys(words[k] for k in cold.tolist()))}
            at[cold] = [new[words[k]] for k in cold.tolist()]
            more = self._spell(list(new))
            classes, lengths, share = (np.concatenate([x, y]) for x, y in zip(self.spelled, more, strict=True))
        n, ends = lengths[at], np.cumsum(lengths)
        shift = (ends - lengths)[at] - (np.cumsum(n) - n)
        counts = np.append(self.counts, -1)[np.minimum(at, len(self.counts))]
        return classes[np.repeat(shift, n) + np.arange(n.sum())], n, share[at], counts


def _words(shared, name: str) -> Words:
    """The broadcast's words, made once a worker."""
    key, pieces, words, counts = shared.value
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(encoder(name), pieces, words, counts)
    return _WORDS[key]


def _binary(data: np.ndarray, per: np.ndarray) -> pa.Array:
    """``per`` items of ``data`` a row, as bytes."""
    offsets = np.concatenate([[0], np.cumsum(per)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def spelled(docs: DataFrame, shared, name: str, rounds: int, rare: float, per: float) -> DataFrame:
    """(turn, classes, lengths, odds): a row for each stretch of the training part,
    dealt into rounds by the id.  Bytes: the pieces' classes, how many pieces each
    word has, and by what the log of its pieces' shares is above that of its share of
    the tokens, its own occurrence left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words(shared, name)
        for b in batches:
            turns = b.column(1).to_pylist()
            rows = ((turns[k], ws) for k in range(b.num_rows) for ws in stretches(b.column(0)[k].as_py()))
            for held in gathered(rows):
                classes, n, share, counts = known.read(list(chain.from_iterable(ws for _, ws in held)))
                odds = share - np.log(np.maximum(np.where(counts > 0, counts, rare) - 0.9, 0.1) * per)
                words = np.array([len(ws) for _, ws in held])
                pieces = np.add.reduceat(n, np.cumsum(words) - words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in held], pa.int32()), _binary(classes, pieces), _binary(n.astype(np.int32), words), _binary(np.clip(odds, -6e4, 6e4).astype(np.float16), words)], ["turn", "classes", "lengths", "odds"]
                )

    turn = F.pmod(F.xxhash64(F.lit(3), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(rounds)).cast("int")
    return _training(docs, turn.alias("turn")).mapInArrow(run, "turn int, classes binary, lengths binary, odds binary")


def _sequences(batches: Iterator[pa.RecordBatch], room: int = _ROOM) -> Iterator[tuple[np.ndarray, ...]]:
    """Classes, pieces of each stretch, pieces of each word and odds of some
    stretches."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for k in range(b.num_rows):
                yield tuple(np.frombuffer(b.column(c)[k].as_py(), kind) for c, kind in ((1, np.int32), (2, np.float16), (0, np.uint8)))

    for held in gathered(rows(), room):
        lengths, odds, classes = zip(*held, strict=True)
        yield np.concatenate(classes), np.array([len(x) for x in classes]), np.concatenate(lengths), np.concatenate(odds)


def count_transitions(read: DataFrame, classes: int, distances: int, half: int) -> np.ndarray:
    """Sums of the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((distances, classes, classes), np.int64)
        for x, n, _, _ in _sequences(batches):
            sums += transitions(x, n, START, classes, distances, 2 * half)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["at", "n"])

    out = np.zeros(distances * classes * classes)
    got = read.select("classes", "lengths", "odds").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(distances, classes, classes)


def train(read: DataFrame, values: np.ndarray, rounds: int, half: int) -> tuple[np.ndarray, float]:
    """The attention's parameters after a step a round, and the weight of a word's
    share of the tokens that suits all rounds' texts best."""
    sc, grid = read.sparkSession.sparkContext, np.linspace(0.1, 0.9, 17)
    model, fits = Attention(values, half=half), np.zeros(len(grid))
    size, theta, adam = model.size, model.theta, Adam(model.size)
    for turn in range(rounds):
        shared = sc.broadcast((values, theta))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            values, theta = shared.value
            model, gradient, fit, seen = Attention(values, half=half, theta=theta), np.zeros(size), np.zeros(len(grid)), 0
            for x, n, lengths, odds in _sequences(batches):
                lp, g = model.gradient(x, n, START)
                gradient += g
                seen += len(x)
                # over the word's share of the tokens, which is the same for all weights
                over = np.exp(np.minimum(np.add.reduceat(lp, np.cumsum(lengths) - lengths, dtype=float) + odds, 50))
                fit += [np.log(w + (1 - w) * over).sum() for w in grid]
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + len(grid) + 1), pa.int32()), pa.array(np.r_[gradient, fit, seen])], ["at", "x"])

        rows = read.where(F.col("turn") == turn).select("classes", "lengths", "odds").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        shared.unpersist()
        if rows.num_rows:
            sums = np.zeros(size + len(grid) + 1)
            sums[rows["at"].to_numpy()] = rows["x"].to_numpy()
            theta = adam.step(theta, sums[:size] / sums[-1], 1 - 0.7 * turn / rounds)
            fits += sums[size:-1]
    return theta, float(grid[fits.argmax()]) if fits.any() else 0.5


def score(docs: DataFrame, vocabulary: str = VOCABULARY, classes: int = 256, own: int = 224, distances: int = 4, half: int = 4, rounds: int = 8, hot: int = 262_144, word_share: float | None = None) -> DataFrame:
    """One row a document; see the module's text.  ``classes``: 256 at most;
    ``word_share``: the mixing weight, learned if None."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    here = Encoder(vocabulary)
    counts = written(word_counts(docs), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    per = 1.0 / (total + 0.1 * (distinct + 1))
    floor = 0.1 * per
    pieces = Pieces(piece_counts(counts, name, here.size), here.begins, classes, own)
    frequent, n_frequent = frequent_words(counts, hot)
    rare = (total - int(n_frequent.sum())) / max(1, distinct - len(frequent))
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, pieces, frequent, n_frequent))
    read = written(spelled(docs, shared, name, rounds, rare, per), "spelled", "turn")
    values = values_of(count_transitions(read, classes, distances, half), pieces.own)
    theta, best = train(read, values, rounds, half)
    removed(read)
    word_share = best if word_share is None else word_share
    learned = spark.sparkContext.broadcast((values, theta))
    arrow_kind = to_arrow_type(kind)
    out = pa.schema([("uid", pa.int64()), ("word", pa.string()), ("p", pa.float64()), ("doc_id", arrow_kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (values, theta) = _words(shared, name), learned.value
        model = Attention(values, half=half, theta=theta)
        for b in batches:
            rows = ((k, ws) for k in range(b.num_rows) for ws in stretches(b.column(3)[k].as_py()))
            for held in gathered(rows, _ROOM // 4):
                every = list(chain.from_iterable(ws for _, ws in held))
                x, n, share, c = known.read(every)
                words = np.array([len(ws) for _, ws in held])
                first = np.cumsum(words) - words
                lp = model.log_probs(x, np.add.reduceat(n, first), START)
                p = np.exp(np.add.reduceat(lp, np.cumsum(n) - n, dtype=float) + share)
                there = c > 0
                base = np.where(there, c, 0) * per + floor
                m, cold = len(held), np.flatnonzero(~there)
                of = pa.array(np.concatenate([[k for k, _ in held], np.repeat([k for k, _ in held], words)[cold]]).astype(np.int64))
                sums = lambda t: np.add.reduceat(np.where(there, t, 0), first)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(of),
                        pa.array([b" %d" % u for u in b.column(0).take(of[:m]).to_pylist()] + [every[k] for k in cold.tolist()], pa.binary()).cast(pa.string()),
                        pa.array(np.r_[np.zeros(m), p[cold]]),
                        pa.concat_arrays([b.column(1).take(of[:m]), pa.nulls(len(cold), arrow_kind)]),
                        pa.concat_arrays([b.column(2).take(of[:m]), pa.nulls(len(cold), pa.bool_())]),
                        pa.array([*words.tolist(), *[None] * len(cold)], pa.int64()),
                        pa.array(np.r_[sums(1), np.zeros(len(cold), np.int64)]),
                        pa.array(np.r_[sums(np.log10(base)), np.zeros(len(cold))]),
                        pa.array(np.r_[sums(np.log10(word_share * base + (1 - word_share) * p)), np.zeros(len(cold))]),
                    ],
                    schema=out,
                )

    schema = f"uid long, word string, p double, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    # a row for each stretch, with what is known there, and one for each other word
    parts = texts.mapInArrow(run, schema).join(counts.withColumnRenamed("n", "c"), "word", "left")
    is_word, c = F.col("n_tokens").isNull(), F.coalesce("c", F.lit(0))
    share = c * F.lit(per) + F.lit(floor)
    parts = parts.select(
        "uid", "doc_id", "held_out", "n_tokens",
        F.when(is_word, (c > 0).cast("long")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(is_word, F.log10(share)).otherwise(F.col("base_score")).alias("base_score"),
        F.when(is_word, F.log10(F.lit(word_share) * share + F.lit(1 - word_share) * F.col("p"))).otherwise(F.col("score")).alias("score"),
    )
    sums = parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
