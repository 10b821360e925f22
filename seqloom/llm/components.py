"""Connected components of a table of links, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import removed, written


def _digest(edges: DataFrame) -> tuple:
    """Count and two sums of hashes: equal for equal sets of edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, root), root the smallest node of its component;
    a row for each node that a link names.

    Alternates large-star (larger neighbours move to the smallest neighbour)
    and small-star (the node and its smaller neighbours do), which ends in
    stars after a number of rounds that grows with the logarithm of the
    largest component.  A star's centre may have a large part of all links:
    minima are summed before the shuffle, and the join on the centre is of
    links with one row a node, which adaptive execution splits.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    sums = _digest(edges)
    if not sums[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every node's smaller neighbours and itself move to its least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = written(small, "links")
        sums, was = _digest(new), sums
        removed(edges)
        if sums == was:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = new
