"""Initialising a hidden Markov model from clustered embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.hmm.learning import normalized


def positions(df: DataFrame, stop: int) -> DataFrame:
    """(seq_id, pos, token, is_last, ...) before a sequence's first stop token;
    ``df`` has a row for each place.  The last place of the full length is marked."""
    of = Window.partitionBy("seq_id")
    end = F.min(F.when(F.col("token") == stop, F.col("pos"))).over(of)
    marked = df.withColumn("_end", end).withColumn("is_last", F.col("pos") == F.max("pos").over(of))
    return marked.where(F.col("_end").isNull() | (F.col("pos") < F.col("_end"))).drop("_end")


def predicting(df: DataFrame, prompt: int, output: int) -> DataFrame:
    """(seq_id, pos, token, embedding) of the ``output`` tokens after a prompt of
    ``prompt``, each with the embedding at the place before it, which predicts it.
    ``df`` has a row for each place, from 0; a token without one before has none."""
    states = df.select(F.col("seq_id").alias("of"), (F.col("pos") + 1).alias("next"), F.col("embedding").alias("state"))
    rows = df.where((F.col("pos") >= prompt) & (F.col("pos") < prompt + output))
    rows = rows.join(states, (F.col("seq_id") == F.col("of")) & (F.col("pos") == F.col("next")), "left")
    return rows.select("seq_id", (F.col("pos") - prompt).alias("pos"), "token", F.col("state").alias("embedding"))


def _distance(vector: Column, centre: list[float]) -> Column:
    c = F.expr("array(" + ", ".join(f"{x!r}D" for x in centre) + ")")
    return F.aggregate(F.zip_with(vector, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def assign(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``df`` (embedding) with its nearest centre, the first among equals.  The
    centres are a model's parameters: a list on the driver, a literal in the plan."""
    scored = F.array(*[F.struct(_distance(F.col("embedding"), c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)])
    return df.withColumn("cluster", F.array_min(scored)["k"])


def centre_step(assigned: DataFrame) -> DataFrame:
    """(cluster, dim, mean): Lloyd's step as one aggregation over dimensions."""
    long = assigned.select("cluster", F.posexplode("embedding").alias("dim", "x"))
    return long.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def k_means(df: DataFrame, centres: list[list[float]], rounds: int = 100, least_move: float = 1e-9) -> list[list[float]]:
    """Lloyd's algorithm from given centres; only the centres reach the driver.
    A centre that loses its points stays where it is."""
    for _ in range(rounds):
        new = [list(c) for c in centres]
        for cluster, dim, mean in centre_step(assign(df, centres)).collect():
            new[cluster][dim] = mean
        moved = max(abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True))
        centres = new
        if moved <= least_move:
            break
    return centres


def transition_counts(assigned: DataFrame, states: int) -> DataFrame:
    """(i, k, mass): from a place's cluster to the next place's, or to the last
    state, which stands for the end, if the next place is past the end.  The last
    place of the full length leads nowhere."""
    after = F.lead("cluster").over(Window.partitionBy("seq_id").orderBy("pos"))
    moves = assigned.withColumn("k", F.coalesce(after, F.lit(states - 1))).where("not is_last")
    own = moves.groupBy(F.col("cluster").alias("i"), "k").agg(F.count("*").cast("double").alias("mass"))
    return _with_end(own, states - 1, states - 1)


def emission_counts(assigned: DataFrame, states: int, stop: int) -> DataFrame:
    own = assigned.groupBy(F.col("cluster").alias("i"), F.col("token").alias("k")).agg(F.count("*").cast("double").alias("mass"))
    return _with_end(own, states - 1, stop)


def start_counts(assigned: DataFrame) -> DataFrame:
    return assigned.where("pos = 0").groupBy(F.lit(0).alias("i"), F.col("cluster").alias("k")).agg(F.count("*").cast("double").alias("mass"))


def _with_end(counts: DataFrame, i: int, k: int) -> DataFrame:
    return counts.union(counts.sparkSession.createDataFrame([(i, k, 1.0)], "i int, k int, mass double"))


def full(counts: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every cell of a table of counts, 0 where nothing was counted."""
    spark = counts.sparkSession
    cells = spark.range(rows * columns).select((F.col("id") / columns).cast("int").alias("i"), (F.col("id") % columns).cast("int").alias("k"))
    return cells.join(counts, ["i", "k"], "left").select("i", "k", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def parameters(assigned: DataFrame, states: int, tokens: int, stop: int, pseudocount: float) -> DataFrame:
    """(kind, i, k, p) as em's parameters."""
    parts = (("alpha", transition_counts(assigned, states), states, states), ("beta", emission_counts(assigned, states, stop), states, tokens), ("gamma", start_counts(assigned), 1, states))
    out = None
    for kind, counts, rows, columns in parts:
        own = normalized(full(counts, rows, columns), columns, pseudocount).select(F.lit(kind).alias("kind"), "i", "k", "p")
        out = own if out is None else out.union(own)
    return out
