"""Exact top-k by inner product with a dual tree of cover trees.

Queries and data are both indexed.  A node keeps a centre and its covering
radius (the largest distance of a point below it); its children's centres are
picked farthest first until they cover it at half that radius, so they lie more
than half of it apart.  The inner product of any query below a node with centre
q and radius s and any point below one with centre d and radius r is at most
``q.d + |q| r + |d| s + s r``.  A pair of nodes is pruned if that is below the
worst kth score among the queries of the node; query leaves visit what is left
best bound first.

The work is dealt out in cells: data in blocks of about ``block_rows``, queries
in groups of about ``group_rows``, both by hash of the id.  A cell yields the best
k of its block for each query of its group, and the best k of these are the
result.  No cell depends on how many rows there are, and no bound is dropped:
the result is exact.  A row is sent once for each group of queries and a query
once for each block, so large cells keep the shuffle small: with queries a
twentieth of the rows, a row is copied once for every 330,000 rows.

Vectors are turned into integers, floor(scale * x); sums are exact in doubles as
long as norms allow, otherwise in 64-bit integers.  Scores too wide to make one
number with a row are ranked by two.  Vectors null or with null or
non-finite components, and rows without an id, take no part.  Shorter vectors
count as filled up with zeros.  Ties go to the smaller id; rows that share the
query's id are not its candidates; other repeated rows are each a candidate.  Of
query rows that share an id, equal vectors count once, and different ones share a
ranking: the best of all their pairs.  An empty table gives an empty result.
Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import table


class CoverTree:
    """Flat arrays of nodes: centre, radius, norm, children, points.  Distances
    come from products; radii are widened by what rounding may take from them."""

    def __init__(self, x: np.ndarray, leaf: int, fan: int = 16):
        self.x, self.squares = x, (x**2).sum(1)
        self.slack = 1e-6 * (1 + float(np.sqrt(self.squares.max(initial=0))))
        self.centre, self.radius, self.children, self.points, self._far = [], [], [], [], []
        self._add(np.arange(len(x)), 0)
        at = 0
        while at < len(self.centre):
            points, far = self.points[at], self._far[at]
            if len(points) > leaf and self.radius[at] > 2 * self.slack:
                owner, least, centres = np.zeros(len(points), np.int64), far.copy(), [self.centre[at]]
                while len(centres) < fan and least.max() > max(self.radius[at] / 2, 2 * self.slack):
                    centres.append(points[int(least.argmax())])
                    d = self._distance(points, centres[-1])
                    nearer = d < least
                    owner[nearer], least[nearer] = len(centres) - 1, d[nearer]
                if len(centres) > 1:
                    for k, c in enumerate(centres):
                        if (own := points[owner == k]).size:
                            self.children[at].append(self._add(own, c))
                    self.points[at] = points[:0]
            self._far[at] = None
            at += 1
        self.centres = x[np.array(self.centre)]
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.radii = np.array(self.radius)

    def _distance(self, points: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares[points] + self.squares[centre] - 2 * (self.x[points] @ self.x[centre]), 0))

    def _add(self, points: np.ndarray, centre: int) -> int:
        far = self._distance(points, centre)
        self.centre.append(centre)
        self.radius.append(float(far.max()) + self.slack)
        self.children.append([])
        self.points.append(points)
        self._far.append(far)
        return len(self.centre) - 1


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where the norms leave room."""
    room = np.sqrt((a**2).sum(1).max(initial=0)) * np.sqrt((b**2).sum(1).max(initial=0))
    if room < 2.0**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _bounded(queries: np.ndarray, data: np.ndarray) -> float:
    """No score is larger."""
    return float(np.sqrt((queries**2).sum(1).max(initial=0)) * np.sqrt((data**2).sum(1).max(initial=0)))


class Best:
    """The k best (score, row) of each query, ties to the smaller row.  Where there
    is room, a score and a row make one number that sorts by both."""

    def __init__(self, n_queries: int, n_rows: int, k: int, wide: float):
        self.none, self.n, self.k = np.iinfo(np.int64).min, n_rows, k
        self.packed = wide * 2 * n_rows < 2.0**62
        self.keys = np.full((n_queries, k), self.none)
        self.rows = None if self.packed else np.full((n_queries, k), n_rows)
        self.worst = np.full(n_queries, -np.inf)  # the kth score, to compare bounds with

    def add(self, q: np.ndarray, part: np.ndarray, scores: np.ndarray, hit: np.ndarray) -> None:
        """Scores of rows ``part`` for queries ``q`` where ``hit``."""
        none, n, k = self.none, self.n, self.k
        if self.packed:
            keys = np.where(hit, scores.astype(np.int64) * n + (n - 1 - part)[None, :], none)
            self.keys[q] = np.partition(np.concatenate([self.keys[q], keys], axis=1), -k, axis=1)[:, -k:]
            worst = self.keys[q].min(1)
            self.worst[q] = np.where(worst == none, -np.inf, worst // n)
            return
        keys = np.concatenate([self.keys[q], np.where(hit, scores.astype(np.int64), none)], axis=1)
        rows = np.concatenate([self.rows[q], np.where(hit, part[None, :], n)], axis=1)
        first = np.lexsort((rows, ~keys), axis=1)[:, :k]
        self.keys[q], self.rows[q] = np.take_along_axis(keys, first, 1), np.take_along_axis(rows, first, 1)
        # a bound in doubles, below the score whatever rounding takes
        self.worst[q] = np.where(self.rows[q][:, -1] == n, -np.inf, np.nextafter(self.keys[q][:, -1].astype(float), -np.inf))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, rows, how many), best first."""
        if self.packed:
            best = -np.sort(-np.maximum(self.keys, self.none + 1), axis=1)
            there = best > self.none + 1
            return np.where(there, best // self.n, 0), np.where(there, self.n - 1 - best % self.n, 0), there.sum(1)
        there = self.rows < self.n
        return np.where(there, self.keys, 0), np.where(there, self.rows, 0), there.sum(1)


def search(queries: np.ndarray, q_ids: np.ndarray, data: np.ndarray, d_ids: np.ndarray, k: int, q_leaf: int = 64, d_leaf: int = 256, scored: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best (scores, ids), best first, and how many there
    are; rows of ``data`` with the query's own id are passed over.  ``scored``
    gets how many pairs were looked at, a number at a time."""
    order = np.argsort(d_ids, kind="stable")
    data, d_ids = data[order], d_ids[order]
    wide = _bounded(queries, data)
    best = Best(len(queries), len(data), k, wide)
    kth = best.worst
    qt, dt = CoverTree(queries, q_leaf), CoverTree(data, d_leaf)
    q_norm = np.sqrt((queries**2).sum(1))
    slack = 1e-9

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        b = dt.centres[nodes] @ qt.centres[q] + qt.norms[q] * dt.radii[nodes] + (dt.norms[nodes] + dt.radii[nodes]) * qt.radii[q]
        return b + slack * (1 + np.abs(b) + qt.norms[q] * dt.norms[nodes])

    def take(q: np.ndarray, part: np.ndarray) -> None:
        if scored is not None:
            scored.append(len(q) * len(part))
        s = queries[q] @ data[part].T if wide < 2.0**52 else _product(queries[q], data[part])
        hit = s >= kth[q][:, None]
        some = np.flatnonzero(hit.any(1))
        if some.size:
            rows = q[some]
            best.add(rows, part, s[some], hit[some] & (d_ids[part][None, :] != q_ids[rows][:, None]))

    def look(rows: np.ndarray, leaves: list[int]) -> None:
        # single queries may be past what the group has to look at
        inner, room = queries[rows] @ dt.centres[leaves].T, q_norm[rows][:, None]
        own = inner + room * dt.radii[leaves] + slack * (1 + room * dt.norms[leaves])
        if (own >= kth[rows][:, None]).mean() > 0.5:
            points = np.concatenate([dt.points[x] for x in leaves])
            for lo in range(0, len(points), 2048):
                take(rows[own.max(1) >= kth[rows]], points[lo : lo + 2048])
            return
        for k in np.argsort(-own.max(0), kind="stable").tolist():
            if (some := rows[own[:, k] >= kth[rows]]).size:
                take(some, dt.points[leaves[k]])

    def visit(q: int, nodes: np.ndarray) -> None:
        if qt.children[q]:
            for child in qt.children[q]:
                # data nodes wider than the query node give way to their children
                out, todo = [], nodes.tolist()
                while todo:
                    x = todo.pop()
                    if dt.children[x] and dt.radii[x] > 2 * qt.radii[child] and len(out) + len(todo) < 64:
                        todo += dt.children[x]
                    else:
                        out.append(x)
                visit(child, np.array(out))
            return
        rows = qt.points[q]
        heap = [(-x, m) for x, m in zip(bounds(q, nodes).tolist(), nodes.tolist(), strict=True)]
        heapq.heapify(heap)
        # leaves are looked at together, few at first, so that there is a worst score soon
        held, size, room = [], 0, 256
        while heap:
            bound, m = heapq.heappop(heap)
            worst = kth[rows].min()
            if -bound < worst:
                break
            if dt.children[m]:
                children = np.array(dt.children[m])
                for x, c in zip(bounds(q, children).tolist(), children.tolist(), strict=True):
                    if x >= worst:
                        heapq.heappush(heap, (-x, c))
                continue
            held.append(m)
            size += len(dt.points[m])
            if size >= room:
                look(rows, held)
                held, size, room = [], 0, 2048
        if held:
            look(rows, held)

    visit(0, np.array([0]))
    top, rows, n = best.result()
    return top, d_ids[rows], n


def _matrix(vectors: pd.Series, width: int, scale: float) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = np.floor(scale * np.asarray(v, np.float64))
    return out


def top_k(base: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, block_rows: int = 16_384, group_rows: int = 16_384) -> DataFrame:
    """``base`` and ``queries`` (vec_id, embedding) -> (query_id, rank, vec_id,
    score), the queries being rows of the base."""

    def valid(df: DataFrame) -> DataFrame:
        numbers = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & numbers)

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))).cast("int")

    base, queries = valid(base), valid(queries)
    n_base, n_queries = base.count(), queries.count()
    blocks, groups = max(1, -(-n_base // block_rows)), max(1, -(-n_queries // group_rows))
    data = base.select(dealt(blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "vec_id", "embedding")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), dealt(groups).alias("g"), "vec_id", "embedding")

    def cell(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(data.embedding.map(len).max(), asked.embedding.map(len).max(), 1)
        q_ids, d_ids, x = asked.vec_id.to_numpy(np.int64), data.vec_id.to_numpy(np.int64), _matrix(asked.embedding, width, scale)
        # equal vectors of an id are one query
        first = np.unique(np.column_stack([q_ids, x.view(np.int64)]), axis=0, return_index=True)[1]
        q_ids, x = q_ids[first], x[first]
        top, ids, n = search(x, q_ids, _matrix(data.embedding, width, scale), d_ids, k)
        there = np.arange(k)[None, :] < n[:, None]
        return pd.DataFrame({"query_id": np.repeat(q_ids, n), "vec_id": ids[there], "score": top[there]})

    found = data.groupBy("b", "g").cogroup(asked.groupBy("b", "g")).applyInPandas(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * d.x[i])) as bigint) as score
      from (select distinct vec_id, x from v where vec_id % 20 = 0) q join v d on q.vec_id <> d.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 20"""
