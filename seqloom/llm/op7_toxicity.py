"""Toxicity by a counterfactually regularised classifier.

Features of a text are its distinct words and the beginnings (3 to 6 letters) of
its words, hashed; a feature's weight counts once, or by the logarithm of how
often it occurs.  Labels are learned from at most ``sample`` labelled rows, those
with the smallest hashes; of their features the ``kept`` with the largest
chi-square against the label go into a logistic regression fitted in numpy.

Counterfactuals: in every sentence of the sample that names a group the identity
terms are swapped for other terms; of a text that names none, one sentence picked by
hash serves as a carrier in which one word gives way to either of two terms, so the
penalty also covers terms that the sample lacks.  Long sentences are looked at in
runs of ``RUN`` words.  The squared change of the logit is penalised, so that naming
a group moves no score.  Only differences of features leave the executors.

Nulls: a null text is an empty one and gets the score of a text without
features; a null label or id trains nothing; a null id is kept.  Of several
labels for an id the largest counts.  Without labels of both kinds every text
has the share of toxic labels (0.5 without any) as its score.  Repeated rows
each give a row.  An empty table gives an empty result.  Only doc_id and text of
documents, doc_id and toxic of labels are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import crc_mod, table

IDENTITY_TERMS = tuple(
    """women men woman man girls boys muslims muslim christians christian jews jew jewish hindus hindu buddhists atheists blacks black whites white asians asian
    africans african latinos latino gays gay lesbians lesbian straight transgender trans queer immigrants immigrant refugees refugee foreigners disabled deaf blind
    elderly frauen männer muslime christen juden schwarze weiße schwule lesben ausländer flüchtlinge behinderte femmes hommes musulmans chrétiens juifs noirs
    blancs homosexuels immigrés réfugiés étrangers handicapés mujeres hombres musulmanes cristianos judíos negros blancos homosexuales inmigrantes refugiados
    extranjeros discapacitados""".split()
)
_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\s")
_FOREIGN = re.compile(r"[^\w\s\x00-\x7f]")
_LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
SPACE = 1 << 20
#: Words of a sentence that are swapped together.
RUN = 64


def words_of(text: str) -> list[str]:
    """Runs of letters and digits.  Only texts with other signs beyond ASCII need the
    slower search."""
    text = text.lower()
    if _FOREIGN.search(text):
        return _WORD.findall(text)
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).decode("utf-8", "surrogatepass").split()


def _features(word: str) -> tuple[int, ...]:
    from xxhash import xxh32_intdigest

    parts = {"=" + word, *("^" + word[:n] for n in range(3, 7) if len(word) > n)}
    return tuple(sorted({xxh32_intdigest(p.encode()) % SPACE for p in parts}))


def _parts(texts: list[str | None], room: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Numbers of texts and their words, some ``room`` code points at a time; a
    longer text comes in several parts."""
    at, words, held = [], [], 0
    for k, text in enumerate(texts):
        lo = 0
        while lo < len(text or ""):
            hi = lo + room
            if hi < len(text):
                blank = _BLANK.search(text, hi)
                hi = blank.start() if blank else len(text)
            at.append(k)
            words.append(words_of(text[lo:hi]))
            held += min(hi, len(text)) - lo
            lo = hi
            if held >= room:
                yield at, words
                at, words, held = [], [], 0
    if at:
        yield at, words


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(n, starts) if len(key) else n


class Features:
    """Features of words, remembered for up to ``cached`` words of 64 letters or
    fewer.  ``chosen`` names the ones that count, by their numbers."""

    def __init__(self, chosen: dict[int, int] | None = None, cached: int = 200_000):
        self.chosen, self.cached = chosen, cached
        self.size = SPACE if chosen is None else max(1, len(chosen))
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.begun: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _one(self, part: str) -> int:
        from xxhash import xxh32_intdigest

        f = xxh32_intdigest(part.encode()) % SPACE
        return f if self.chosen is None else self.chosen.get(f, -1)

    def of_word(self, word: str) -> list[int]:
        """What ``_features`` gives, of the chosen ones; words share beginnings, so
        these are remembered too."""
        out, begun = {self._one("=" + word)}, self.begun
        for n in range(3, min(7, len(word))):
            part = word[:n]
            f = begun.get(part)
            if f is None:
                f = begun[part] = self._one("^" + part)
            out.add(f)
        out.discard(-1)
        return sorted(out)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.index) >= self.cached:
            self._clear()
        out = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(out < 0)
        if len(missed):
            new = dict.fromkeys(words[k] for k in missed.tolist())
            features = [self.of_word(w) for w in new]
            at = {w: len(self.index) + k for k, w in enumerate(new)}
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(features), np.int64)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(f) for f in features])])
            out[missed] = [at[words[k]] for k in missed.tolist()]
            self.index |= at
        return out

    def counted(self, texts: list[str | None], room: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, how often) of all texts, by text and feature."""
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, words in _parts(texts, room):
            word = self._numbers(list(chain.from_iterable(words)))
            per = self.ends[word + 1] - self.ends[word]
            features = self.flat[np.repeat(self.ends[word] - (np.cumsum(per) - per), per) + np.arange(per.sum())]
            key = np.repeat(np.repeat(at, [len(w) for w in words]) - at[0], per) * self.size + features
            if (at[-1] - at[0] + 1) * self.size <= 1 << 22:
                # a table of texts by features
                table = np.bincount(key)
                key = np.flatnonzero(table)
                n = table[key]
            else:
                key, n = _sums(key, np.ones(len(key), np.int64))
            keys.append(key + at[0] * self.size)
            counts.append(n)
            if len(self.index) > 2 * self.cached or len(self.begun) > 4 * self.cached or len(self.flat) > 1 << 23:
                self._clear()  # many long words
        key, n = np.concatenate(keys), np.concatenate(counts)
        if (key[1:] <= key[:-1]).any():
            key, n = _sums(key, n)  # a text came in several parts
        return *np.divmod(key, self.size), n

    def rows(self, texts: list[str | None]) -> list[dict[int, float]]:
        """For each text, feature -> 1 + log of its count."""
        text, feature, n = self.counted(texts)
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        x = 1 + np.log(n)
        return [dict(zip(feature[lo:hi].tolist(), x[lo:hi].tolist(), strict=True)) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


class Classifier:
    def __init__(self, chosen: dict[int, int], weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def scores(self, texts: list[str | None], features: Features) -> np.ndarray:
        text, feature, n = features.counted(texts)
        z = self.bias + np.bincount(text, (1 + np.log(n)) * self.weights[feature], len(texts)) if len(text) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled ids of the training
    part.  The ids are bounded, so that they are broadcast and no text moves."""
    known = labels.where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "l_id")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic")


def swaps(text: str | None, terms: tuple[str, ...], named: set[str], salt: str = "") -> Iterator[tuple[str, str]]:
    """Pairs of a run of a sentence's words and its counterfactual.  What takes a
    term's place is drawn by a hash of the words and the place."""
    from xxhash import xxh64_intdigest

    plain, least = None, None
    found = False
    for n, sentence in enumerate(_SENTENCE.split(text or "")):
        whole = _WORD.findall(sentence.lower())
        for lo in range(0, len(whole), RUN):
            words = whole[lo : lo + RUN]
            at = [k for k, w in enumerate(words) if w in named]
            drawn = lambda k, words=words: xxh64_intdigest(f"{salt}{k} {' '.join(words)}")
            if at:
                found = True
                other = list(words)
                for k in at:
                    other[k] = terms[drawn(k) % len(terms)]
                yield " ".join(words), " ".join(other)
            elif not found and (least is None or drawn(-1) < least):
                plain, least = words, drawn(-1)
    if not found and plain:
        k, a = least % len(plain), (least >> 20) % len(terms)
        b = (a + 1 + (least >> 40) % max(1, len(terms) - 1)) % len(terms)
        yield tuple(" ".join([*plain[:k], terms[t], *plain[k + 1 :]]) for t in (a, b))


def _sparse(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the lists f and x."""
    lengths = pc.list_value_length(rows["f"]).to_numpy()
    flat = lambda name, kind: pc.list_flatten(rows[name]).to_numpy().astype(kind)
    return np.repeat(np.arange(rows.num_rows), lengths), flat("f", np.int64), flat("x", float)


def fit(rows: tuple, toxic: np.ndarray, swapped: tuple, n_swapped: int, n_features: int, penalty: float = 1.0, ridge: float = 1e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam: balanced log loss, ridge, and the mean squared
    change of the logit under the swaps (differences of features), times ``penalty``."""
    y = toxic.astype(float)
    (r, f, x), (sr, sf, sx) = rows, swapped
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, bias = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(r, x * w[f], len(y))
        d = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.bincount(f, x * d[r], n_features) + ridge * w
        if n_swapped:
            change = np.bincount(sr, sx * w[sf], n_swapped)
            grad += penalty * 2 / n_swapped * np.bincount(sf, sx * change[sr], n_features)
        g = np.append(grad, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, kept: int = 4096, penalty: float = 1.0, terms: tuple[str, ...] = IDENTITY_TERMS) -> Classifier:
    """``sample`` bounds the labelled rows, ``kept`` the features; what comes to the
    driver are features of these rows and of their swapped sentences."""
    rows = labelled_sample(docs, labels, sample)
    rows = rows.persist()
    schema = "feature int, toxic int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(), np.zeros((2, SPACE), np.int64)
        totals = np.zeros(2, np.int64)
        for b in batches:
            toxic = b.column(2).to_numpy() > 0
            text, feature, _ = features.counted(b.column(1).to_pylist())
            for label in (0, 1):
                sums[label] += np.bincount(feature[toxic[text] == bool(label)], minlength=SPACE)
            totals += np.bincount(toxic, minlength=2)
        t, f = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[f, -1, -1].astype(np.int32)), pa.array(np.r_[t, 0, 1].astype(np.int32)), pa.array(np.r_[sums[t, f], totals])], ["feature", "toxic", "n"])

    per = rows.mapInArrow(count, schema).groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    per = per.persist()
    got = per.where("feature = -1").first()
    pos, neg = (got.a, got.b) if got else (0, 0)
    if not pos or not neg:
        rows.unpersist(), per.unpersist()
        share = (pos + 0.5) / (pos + neg + 1)
        return Classifier({}, np.zeros(0), float(np.log(share / (1 - share))) if pos + neg else 0.0)
    n, a, b = pos + neg, F.col("a"), F.col("b")
    chi = n * F.pow(a * (neg - b) - b * (pos - a), 2) / ((a + b) * (n - a - b + 1.0) * float(pos) * float(neg))
    top = per.where("feature >= 0").where(a + b >= 3).orderBy(chi.desc(), "feature").limit(kept).select("feature").collect()
    chosen = {r[0]: k for k, r in enumerate(top)}
    for word in terms:  # the penalty has to see the terms
        for f in _features(word):
            chosen.setdefault(f, len(chosen))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, named = Features(chosen), set(terms)
        lists = lambda rows: [pa.array([list(x) for x in rows], pa.list_(pa.int32())), pa.array([list(x.values()) for x in rows], pa.list_(pa.float32()))]
        for b in batches:
            texts = b.column(1).to_pylist()
            labels = [int(t > 0) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists(features.rows(texts)), pa.array(labels, pa.int32())], ["doc_id", "f", "x", "toxic"])
            for k, text in enumerate(texts):
                if pairs := list(swaps(text, terms, named)):
                    one, two = features.rows([a for a, _ in pairs]), features.rows([c for _, c in pairs])
                    moved = [{f: v for f in sorted({*p, *q}) if (v := p.get(f, 0.0) - q.get(f, 0.0))} for p, q in zip(one, two, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * len(moved))), *lists(moved), pa.nulls(len(moved), pa.int32())], ["doc_id", "f", "x", "toxic"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    local = rows.mapInArrow(sparse, f"doc_id {kind}, f array<int>, x array<float>, toxic int").toArrow().sort_by("doc_id")
    rows.unpersist(), per.unpersist()
    told = local["toxic"].is_valid()
    data, moved = local.filter(told), local.filter(pc.invert(told))
    w, bias = fit(_sparse(data), data["toxic"].to_numpy(), _sparse(moved), moved.num_rows, len(chosen), penalty)
    return Classifier(chosen, w, bias)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score) for every row."""
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        features = Features(c.chosen)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.scores(b.column(1).to_pylist(), features))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
