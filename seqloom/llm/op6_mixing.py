"""Mixing sources to target weights by a multivariate-hypergeometric splitting
tree (DataFrame functions only).

1. Every source's share of the mix is found by weight, held to ``most`` times
   its size, the excess reshared: targets are ``min(cap, level * weight)`` with
   one level, found from prefix sums over the sources sorted by cap / weight.
2. A source's documents are permuted by hash into blocks of about
   ``docs_per_block``.  Whole passes and then a prefix of the blocks make up
   the target; the last block is filled by first fit, so a source misses its
   target by less than the smallest document left in that block.
3. The block quotas of all sources are divided among the output shards by a
   binary tree.  Each node draws its left child's count of every source from
   the hypergeometric law given what is left of population and draw, so each
   shard is an exact random sample of the quotas, without replacement.
4. Each source's blocks, in a second permutation, are dealt to the shards by
   these counts; within a shard, copies are shuffled: their order is that of
   ``shuffle_keys``, a hash of shard, pass and document.

Sources are in code point order, null last.  Nulls: a null text has size 0, a
null id or source is a value like any other.  Rows that agree in id, source and
size are copies of one unit: each takes part in the passes, and first fit takes as
many of them as there is room for.  Sizes of zero are never taken and their
target is 0.  An empty table gives an empty result.  Other columns are not read.
Equal hashes are told apart by the id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import WORD, table, written

SEED = 20240601


def _log_factorial(z: str) -> str:
    z = f"cast({z} as double)"
    return f"if({z} < 2, 0D, {z} * ln({z}) - {z} + 0.5D * ln(2 * pi() * {z}) + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)))"


def hypergeometric(pop: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the quantile ``u`` of the number of marked ones among ``drawn``
    of ``pop``.  The sum runs over the support within nine deviations and nine
    of the mean: what lies outside is below the resolution of ``u``."""
    mean = f"({drawn} * cast({marked} as double) / {pop})"
    dev = f"sqrt({mean} * (1 - {marked} / cast({pop} as double)) * ({pop} - {drawn}) / greatest(1, {pop} - 1))"
    low = f"greatest(0L, {drawn} + {marked} - {pop}, cast(floor({mean} - 9 * {dev} - 9) as bigint))"
    high = f"least(cast({drawn} as bigint), {marked}, cast(ceil({mean} + 9 * {dev} + 9) as bigint))"
    lf = _log_factorial
    fixed = f"{lf(marked)} + {lf(f'({pop} - {marked})')} + {lf(drawn)} + {lf(f'({pop} - {drawn})')} - {lf(pop)}"
    of_k = f"exp(z.f - {lf('k')} - {lf(f'({marked} - k)')} - {lf(f'({drawn} - k)')} - {lf(f'({pop} - {marked} - {drawn} + k)')})"
    return f"""if({marked} = 0 or {drawn} = 0, 0L, if({drawn} >= {pop}, {marked}, aggregate(
        sequence({low}, {high}), named_struct('f', {fixed}, 'c', 0D, 'x', -1L, 'last', 0L),
        (z, k) -> named_struct('f', z.f, 'c', z.c + {of_k}, 'x', if(z.x < 0 and z.c + {of_k} >= {u}, k, z.x), 'last', k),
        z -> if(z.x < 0, z.last, z.x))))"""


def split_tree(counts: DataFrame, blocks: int, shards: int) -> DataFrame:
    """``counts``: (i int, c long), ``blocks`` in all -> (shard, i, c), every
    shard an exact hypergeometric part of the quotas."""
    at = lambda shard: f"cast(floor({blocks}D * ({shard}) / {shards}) as bigint)"
    nodes = counts.where("c > 0").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("q")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    u = f"((shiftrightunsigned(xxhash64({SEED}, lo, hi, x.i), 11) + 0.5D) / 9007199254740992D)"
    one = f"""aggregate(q, named_struct('pop', {at('hi')} - {at('lo')}, 'draw', {at('(lo + hi) div 2')} - {at('lo')}, 'o', cast(array() as array<bigint>)),
        (a, x) -> element_at(transform(array({hypergeometric('a.pop', 'x.c', 'a.draw', u)}),
             h -> named_struct('pop', a.pop - x.c, 'draw', a.draw - h, 'o', array_append(a.o, h))), 1), a -> a.o)"""
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if level == 8:
            nodes = nodes.repartition("lo")
        left = nodes.select("*", F.expr(f"if(hi - lo > 1, {one}, cast(null as array<bigint>))").alias("l"))
        halves = """if(l is null, array(named_struct('lo', lo, 'hi', hi, 'q', q)), array(
            named_struct('lo', lo, 'hi', (lo + hi) div 2, 'q', filter(transform(q, (x, i) -> named_struct('i', x.i, 'c', l[i])), x -> x.c > 0)),
            named_struct('lo', (lo + hi) div 2, 'hi', hi, 'q', filter(transform(q, (x, i) -> named_struct('i', x.i, 'c', x.c - l[i])), x -> x.c > 0))))"""
        halves = halves.replace("'lo', (lo + hi) div 2", "'lo', cast((lo + hi) div 2 as int)").replace("'hi', (lo + hi) div 2", "'hi', cast((lo + hi) div 2 as int)")
        nodes = left.select(F.explode(F.expr(halves)).alias("n")).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("shard", "x.i", "x.c")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``sources``: (source, words, units) -> also (i, target).  The table of
    sources is ranked as a whole; it has one row for each source."""
    ranked = sources.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("i") % len(weights) + 1)).withColumn("cap", F.col("words") * most)
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "i").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("words").over(every)).withColumn("all_w", F.sum("weight").over(every))
    ranked = ranked.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("held", F.col("cap").cast("double") * (F.col("all_w") - F.col("ws")) <= F.col("weight") * (share * F.col("total") - F.col("caps")))
    ranked = ranked.withColumn("caps", F.coalesce(F.sum(F.when(F.col("held"), F.col("cap"))).over(every), F.lit(0))).withColumn("free", F.sum(F.when(~F.col("held"), F.col("weight"))).over(every))
    target = F.when(F.col("held"), F.col("cap").cast("double")).otherwise((share * F.col("total") - F.col("caps")) * F.col("weight") / F.col("free"))
    return ranked.select("source", "i", "words", "units", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, docs_per_block: int = 64, blocks_per_shard: int = 64, blocks_per_step: int = 1024
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken,
    shards and shuffle_keys (arrays, an entry for each time it is taken)."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    units = units.withColumn("h", F.xxhash64(F.lit(SEED), F.coalesce("source", F.lit("\0null")), F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null")), "size"))
    units = written(units, "mix-units")
    words = F.col("size") * F.col("copies")
    sources = targets(units.groupBy("source").agg(F.sum(words).alias("words"), F.count("*").alias("units")), weights, share, most)
    sources = sources.withColumn("k", F.ceil(F.col("units") / docs_per_block).cast("bigint"))
    sources = sources.withColumn("passes", F.when(F.col("words") == 0, 0).otherwise(F.least(F.lit(most), F.floor(F.col("target") / F.col("words")))).cast("int"))
    sources = sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
    # one row a source: small enough to be broadcast only where Spark finds it so
    sources = written(sources, "mix-sources")
    by_source = sources.select(F.col("source").alias("s_source"), "i", "k", "target", "passes", "rest", F.col("words").alias("source_size"))
    placed = units.join(by_source, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    placed = placed.withColumn("block", F.pmod("h", "k"))

    # the prefix of the blocks that the rest of the target takes, in two steps:
    # over runs of blocks, then over the blocks of the run where it ends
    blocks = placed.groupBy("i", "block", "k", "rest", "passes").agg(F.sum(words).alias("words"))
    blocks = written(blocks, "mix-blocks")
    run = F.floor(F.col("block") / blocks_per_step)
    ended = lambda by: Window.partitionBy("i").orderBy(by)
    runs = blocks.groupBy("i", run.alias("run")).agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    runs = runs.withColumn("upto", F.sum("words").over(ended("run"))).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    runs = runs.select("i", "run", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    inner = blocks.select("i", "block", "words", run.alias("run")).join(runs, ["i", "run"])
    inner = inner.withColumn("upto", F.sum("words").over(ended("block"))).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
    last = written(inner.select("i", F.col("block").alias("last"), (F.col("left") - F.col("upto") + F.col("words")).alias("room")), "mix-last")

    # first fit within each source's last block
    open_block = placed.join(last, "i").where(F.col("block") == F.col("last"))
    fill = """aggregate(us, named_struct('room', room, 'o', cast(array() as array<struct<h:bigint,doc_id:{id},n:bigint>>)),
        (a, x) -> if(x.size > 0 and x.size <= a.room, named_struct('room', a.room - least(x.copies, cast(floor(a.room / x.size) as bigint)) * x.size,
            'o', array_append(a.o, named_struct('h', x.h, 'doc_id', x.doc_id, 'n', least(x.copies, cast(floor(a.room / x.size) as bigint))))), a), a -> a.o)"""
    fill = fill.replace("{id}", units.schema["doc_id"].dataType.simpleString())
    chosen = open_block.groupBy("i").agg(F.first("room").alias("room"), F.sort_array(F.collect_list(F.struct("h", "doc_id", "size", "copies"))).alias("us"))
    chosen = chosen.select("i", F.explode(F.expr(fill)).alias("x")).select(F.col("i").alias("c_i"), F.col("x.h").alias("c_h"), F.col("x.doc_id").alias("c_id"), F.col("x.n").alias("fits"))

    # quotas in blocks, split among the shards
    quota = sources.join(last, "i", "left").select("i", "k", "rest", (F.col("passes") * F.col("k") + F.coalesce(F.col("last") + 1, F.lit(0))).alias("c"))
    quota = written(quota, "mix-quota")
    in_all = quota.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(in_all / blocks_per_shard))
    parts = split_tree(quota.select("i", "c"), in_all, shards)
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("shard"))
    wide = F.greatest(F.lit(1), F.floor(F.col("q") / shards)).cast("bigint")
    parts = parts.select("i", "shard", (upto - F.col("c")).alias("lo"), upto.alias("hi")).join(quota.select("i", F.col("c").alias("q")), "i")
    parts = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide)))).drop("q")
    copies = blocks.join(last, "i", "left").join(quota.select("i", F.col("c").alias("q")), "i")
    copies = copies.withColumn("n", F.col("passes") + F.when(F.col("block") <= F.col("last"), 1).otherwise(0)).where("n > 0")
    copies = copies.select("i", "block", "q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("epoch"), "k")
    copies = copies.withColumn("at", F.pmod((F.col("epoch") * F.col("k") + F.col("block")) * F.lit(2147483647) + F.pmod(F.xxhash64(F.lit(SEED), "i"), F.lit(1 << 30)), F.col("q")))
    copies = copies.withColumn("bin", F.floor(F.col("at") / wide))
    dealt = copies.join(parts, ["i", "bin"]).where("at >= lo and at < hi")
    dealt = dealt.groupBy("i", "block").agg(F.expr("transform(sort_array(collect_list(struct(epoch, shard))), x -> x.shard)").alias("dealt"))

    out = placed.join(last.select("i", "last"), "i", "left").join(dealt, ["i", "block"], "left")
    out = out.join(chosen, (F.col("i") == F.col("c_i")) & (F.col("h") == F.col("c_h")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    # a unit's copies, some thousand at a time, so that no array grows with them
    out = out.withColumn("some", F.explode(F.expr("sequence(0L, (copies - 1) div 4096)"))).withColumn("copy", F.explode(F.expr("sequence(some * 4096 + 1, least(copies, some * 4096 + 4096))")))
    once_more = (F.col("block") < F.col("last")) | (F.col("copy") <= F.col("fits"))
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + F.when(once_more, 1).otherwise(0))
    out = out.withColumn("times", times.cast("int"))
    shards = F.expr("if(times = 0, cast(array() as array<int>), slice(dealt, 1, times))")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("bigint").alias("taken"),
        shards.alias("shards"), F.transform(shards, lambda shard, epoch: F.xxhash64(F.lit(SEED), shard, epoch, "h", "copy")).alias("shuffle_keys"),
    )


def shuffled_copies(mixed: DataFrame) -> DataFrame:
    """One row for each time a document is taken: its shard and its key there, by
    which the shard is to be ordered."""
    taken = F.posexplode(F.arrays_zip("shards", "shuffle_keys")).alias("epoch", "x")
    return mixed.select("doc_id", "source", "size", taken).select("doc_id", "source", "size", "epoch", F.col("x.shards").alias("shard"), F.col("x.shuffle_keys").alias("shuffle_key"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards", "shuffle_keys")
