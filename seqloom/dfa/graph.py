"""Graph operations on automata held as tables: frontier joins and aggregations,
nothing collected.  Rounds are cut from their lineage by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.files import cut


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(state): what can be reached from ``seeds`` (state) along edges (src, dst).
    One join a level; the number of rounds is the graph's depth."""
    steps = edges.select("src", "dst").distinct()
    seen = frontier = cut(seeds.select("state").distinct(), "reach")
    while not frontier.isEmpty():
        after = frontier.join(steps, F.col("state") == F.col("src")).select(F.col("dst").alias("state")).distinct()
        frontier = cut(after.join(seen, "state", "left_anti"), "reach")
        seen = seen.union(frontier)
    return seen


def live(edges: DataFrame, accepting: DataFrame) -> DataFrame:
    """(state): states from which an accepting one can be reached."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), accepting)


def numbered(values: DataFrame, name: str, run: int = 1 << 16) -> DataFrame:
    """``values`` (``name``: distinct whole numbers from 0) with ``n``, their place
    from 0.  Places are summed over runs first, so no task orders all."""
    runs = values.withColumn("run", F.floor(F.col(name) / run))
    before = F.sum("c").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.groupBy("run").agg(F.count("*").alias("c")).select("run", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("run").orderBy(name))
    return runs.withColumn("within", within).join(starts, "run").select(name, (F.col("start") + F.col("within") - 1).cast("int").alias("n"))


def state_groups(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(state, grp): equivalence groups numbered from 0 in the order of their
    smallest state, by refinement until the number of groups holds."""
    group = cut(states.select("state", F.col("is_accept").cast("int").alias("grp")), "groups")
    count = group.select("grp").distinct().count()
    while True:
        after = edges.join(group.select(F.col("state").alias("dst"), F.col("grp").alias("to")), "dst")
        sign = after.groupBy(F.col("src").alias("state")).agg(F.sort_array(F.collect_list(F.struct("cls", "to"))).alias("sign"))
        signed = group.join(sign, "state", "left").withColumn("sign", F.coalesce("sign", F.array().cast(sign.schema["sign"].dataType)))
        least = signed.groupBy("grp", "sign").agg(F.min("state").alias("least"))
        group = cut(signed.join(least, ["grp", "sign"]).select("state", F.col("least").alias("grp")), "groups")
        before, count = count, group.select("grp").distinct().count()
        if before == count:
            return group.join(numbered(group.select("grp").distinct(), "grp"), "grp").select("state", F.col("n").alias("grp"))


def relabel(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``edges`` with states renamed by ``names`` (state, name); others keep theirs."""
    out = edges
    for end in ("src", "dst"):
        new = names.select(F.col("state").alias("named"), F.col("name").alias("to"))
        out = out.join(new, F.col(end) == F.col("named"), "left").withColumn(end, F.coalesce("to", end)).drop("named", "to")
    return out


def reindex(edges: DataFrame) -> DataFrame:
    """``edges`` with states numbered from 0 without gaps, in their order."""
    states = edges.select(F.col("src").alias("state")).union(edges.select("dst")).distinct()
    return relabel(edges, numbered(states, "state").select("state", F.col("n").alias("name")))


def copy_state(edges: DataFrame, state: int, name: int) -> DataFrame:
    """``edges`` and those that leave ``state`` once more, from a state ``name``."""
    return edges.union(edges.where(F.col("src") == state).withColumn("src", F.lit(name).cast(edges.schema["src"].dataType)).select(*edges.columns))
