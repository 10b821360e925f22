"""Latent initialisation, constrained scoring, ranking and streaming queries.

No language model is at hand: event sequences under a small hidden Markov model,
and tables of log probabilities made from event values, stand in for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.constraint import Constraint, decode, next_tokens, overlaps, reweight, satisfaction
from seqloom.functions import logspace
from seqloom.operators import latent, ranking
from seqloom.plans import models
from seqloom.plans.automata import CALM
from seqloom.plans.models import MODEL, H, V
from seqloom.sources import streams
from seqloom.streaming import stateful

CONSTRAINT = Constraint(CALM, MODEL, 1, 3, (0, 4))
STATES, LABELS, STOP = 4, 10, 9


# latent initialisation


def _centres(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """The first STATES - 1 vectors."""
    rows = streams.table(spark, sf_dir, "embeddings").where(F.col("vec_id") < STATES - 1).orderBy("vec_id").collect()
    return [[float(x) for x in r.embedding] for r in rows]


def _places(spark, sf_dir):
    return latent.positions(streams.embeddings(spark, sf_dir), STOP)


def _assigned(spark, sf_dir):
    return latent.assign(_places(spark, sf_dir), _centres(spark, sf_dir))


def lvd_positions(spark, sf_dir):
    return _places(spark, sf_dir).select("seq_id", "pos", "token", "is_last")


def embedding_slice(spark, sf_dir):
    """What predicts five tokens after a prompt of three; its first number."""
    rows = latent.predicting(streams.embeddings(spark, sf_dir), 3, 5)
    return rows.select("seq_id", "pos", "token", F.round(F.col("embedding")[0].cast("double"), 6).alias("x0"))


def kmeans_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("seq_id", "pos", "cluster")


def kmeans_step(spark, sf_dir):
    """One step over all places but the first of each sequence."""
    return latent.centre_step(_assigned(spark, sf_dir).where("pos <> 0")).withColumn("mean", F.round("mean", 6))


def lvd_alpha(spark, sf_dir):
    return latent.transition_counts(_assigned(spark, sf_dir), STATES)


def lvd_beta(spark, sf_dir):
    return latent.emission_counts(_assigned(spark, sf_dir), STATES, STOP)


def lvd_gamma(spark, sf_dir):
    return latent.start_counts(_assigned(spark, sf_dir))


def lvd_params(spark, sf_dir):
    return latent.parameters(_assigned(spark, sf_dir), STATES, LABELS, STOP, 0.5).withColumn("p", F.round("p", 6))


# constrained scoring


def dfa_class_weights(spark, sf_dir):
    """Emission probability of each token class in each state, by a join."""
    classes = spark.createDataFrame([(w, CALM.classes.get(w, 0)) for w in range(V)], "token int, cls int")
    beta = MODEL.tables(spark)["hmm_beta"]
    return beta.join(F.broadcast(classes), "token").groupBy("cls", "i").agg(F.round(F.sum(F.exp("logp")), 9).alias("w"))


def constraint_prob(spark, sf_dir):
    return satisfaction(streams.events(spark, sf_dir), CONSTRAINT, "user_id").withColumn("p", F.round("p", 9))


def constraint_prob_missing(spark, sf_dir):
    """Events of small value are missing: the model sums over them, the automaton
    reads them as an event that no constraint names."""
    return satisfaction(models._partial(spark, sf_dir), CONSTRAINT, "user_id").withColumn("p", F.round("p", 9))


def constraint_prob_ranges(spark, sf_dir):
    """A range of lengths for each user."""
    rows = streams.events(spark, sf_dir).withColumn("least", F.col("user_id") % 3).withColumn("most", F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 3 + 1))
    return satisfaction(rows, CONSTRAINT, "user_id", least="least", most="most").withColumn("p", F.round("p", 9))


def constraint_ranges(spark, sf_dir):
    """Completions summed over each range of lengths: a range join and a log sum."""
    c = CONSTRAINT.completions()
    rows = [(t, q, i, float(c[t, q, i])) for t in range(c.shape[0]) for q in range(c.shape[1]) for i in range(H)]
    table = spark.createDataFrame(rows, "t int, state int, i int, x double").withColumn("x", logspace.log(F.col("x")))
    ranges = spark.createDataFrame(sorted(set(CONSTRAINT.ranges())), "lo int, hi int")
    joined = table.join(F.broadcast(ranges), (F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")))
    sums = logspace.logsumexp_by(joined.select("lo", "hi", "state", "i", "x"), ["lo", "hi", "state", "i"], "x", "x")
    return sums.select("lo", "hi", "state", "i", F.round(F.exp("x"), 9).alias("w"))


def suffix_overlap(spark, sf_dir):
    found = overlaps(F.col("tokens"), CONSTRAINT.suffix, CALM, CONSTRAINT.least)
    return streams.events(spark, sf_dir).select("user_id", F.array_join(found, ",").alias("lengths"))


def _split(spark, sf_dir):
    """A user's last two events are what has been generated."""
    rows = streams.events(spark, sf_dir).where("size(tokens) >= 2")
    return rows.select("user_id", F.expr("slice(tokens, 1, size(tokens) - 2)").alias("prefix"), F.expr("slice(tokens, -2, 2)").alias("tokens"))


def constraint_next_token(spark, sf_dir):
    found = next_tokens(_split(spark, sf_dir), CONSTRAINT, "user_id")
    return found.select("user_id", "token", F.round("num", 9).alias("num"), F.round("den", 9).alias("den"))


def constraint_reweight(spark, sf_dir):
    """Base scores: a tenth of how often a user had the event."""
    counts = streams.table(spark, sf_dir, "events").groupBy("user_id", streams.event_token().alias("token")).agg((F.count("*") / 10).alias("logit"))
    scores = next_tokens(_split(spark, sf_dir), CONSTRAINT, "user_id").join(counts, ["user_id", "token"], "left").na.fill(0.0, ["logit"])
    out = reweight(scores, "user_id", alpha=0.7, temperature=1.5)
    return out.select("user_id", "token", F.round("logp", 6).alias("logp"), "feasible")


def constraint_reweight_ended(spark, sf_dir):
    """Users whose last event is the stop token have ended and take the temperature
    alone; token 5, which the model doesn't know, is banned."""
    split = _split(spark, sf_dir)
    known = next_tokens(split, CONSTRAINT, "user_id").select("user_id", "token", "num", "den")
    other = split.select("user_id", F.lit(V).cast("int").alias("token"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("double").alias("den"))
    ended = split.select(F.col("user_id"), (F.element_at("tokens", -1) == models.STOP).alias("ended"))
    scores = known.union(other).join(ended, "user_id").withColumn("logit", (F.col("user_id") * 7 + F.col("token") * 3) % 5 / 2)
    out = reweight(scores, "user_id", alpha=0.7, temperature=1.5, ended=F.col("ended"))
    return out.select("user_id", "token", F.round("logp", 6).alias("logp"), "feasible")


def constrained_decode(spark, sf_dir):
    rows = streams.events(spark, sf_dir).select("user_id", F.col("tokens").alias("prefix"))
    return decode(rows, CONSTRAINT, "user_id", beam=4).withColumn("logp", F.round("logp", 6))


# ranking


def extract_generated(spark, sf_dir):
    rows = streams.label_sequences(spark, sf_dir)
    suffix = F.array(F.lit(3), F.lit(4), F.lit(9))
    return rows.select("seq_id", F.array_join(ranking.generated(F.col("tokens"), F.slice("tokens", 1, 2), suffix, STOP), ",").alias("generated"))


def _logp(spark, sf_dir) -> DataFrame:
    """A user's events as a sequence: two of prompt, two of suffix, the rest generated."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = streams.table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("pos"), F.count("*").over(Window.partitionBy("user_id")).alias("n"), (-F.col("value") / 100).alias("logp"))
    part = F.when(F.col("pos") < 2, "prompt").when(F.col("pos") >= F.col("n") - 2, "suffix").otherwise("generated")
    return rows.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "part").orderBy("pos")))


def rank_generated(spark, sf_dir):
    """Users by falling score; one row a user is ranked within groups of ten."""
    scores = ranking.score(_logp(spark, sf_dir), "user_id", penalty=0.9).withColumn("grp", F.col("user_id") % 10)
    return ranking.top(scores, "grp", "score", "user_id", 1 << 30).withColumn("score", F.round("score", 6))


def rank_topk(spark, sf_dir):
    scores = ranking.score(_logp(spark, sf_dir), "user_id").withColumn("grp", F.col("user_id") % 10)
    return ranking.top(scores, "grp", "score", "user_id", 3).withColumn("score", F.round("score", 6))


def rank_two_stage(spark, sf_dir):
    logp = _logp(spark, sf_dir)
    fit = ranking.score(logp, "user_id", suffix_only=True, cap=1).withColumnRenamed("score", "fit")
    scores = ranking.score(logp, "user_id").join(fit, "user_id").withColumn("grp", F.col("user_id") % 10)
    out = ranking.two_stage(scores, "grp", "fit", "score", "user_id", 5)
    return out.select("user_id", "grp", F.round("fit", 6).alias("fit"), F.round("score", 6).alias("score"), "rank")


def _stream(spark, sf_dir, token):
    """Events as a stream through automaton and model: the last state of each user."""
    schema = streams.table(spark, sf_dir, "events").schema
    # a pattern, as a stream's source is a folder or a pattern, not a file
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("token", token)
    rows = stateful.drained(spark, stateful.follow(stream, CALM, MODEL, "user_id", "token", ["ts", "event_id"]))
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("n", "state", "accepted", "ll"), "n").alias("x")).select("user_id", "x.*")
    return last.withColumn("ll", F.round("ll", 6))


def stream_dfa(spark, sf_dir):
    return _stream(spark, sf_dir, streams.event_token())


def stream_dfa_missing(spark, sf_dir):
    """Events of small value are missing."""
    return _stream(spark, sf_dir, F.when(F.col("value") >= 3, streams.event_token()))


def stream_dfa_recovery(spark, sf_dir):
    """The states that the stream has in the end, recomputed from all events."""
    rows = streams.table(spark, sf_dir, "events").withColumn("token", streams.event_token())
    return stateful.recomputed(rows, CALM, MODEL, "user_id", "token", ["ts", "event_id"]).withColumn("ll", F.round("ll", 6))


def queries():
    own = (
        lvd_positions, embedding_slice, kmeans_assign, kmeans_step, lvd_alpha, lvd_beta, lvd_gamma, lvd_params, dfa_class_weights, constraint_prob, constraint_prob_missing, constraint_prob_ranges, constraint_ranges,
        suffix_overlap, constraint_next_token, constraint_reweight, constraint_reweight_ended, constrained_decode, extract_generated, rank_generated, rank_topk, rank_two_stage, stream_dfa, stream_dfa_missing, stream_dfa_recovery,
    )
    return {f.__name__: f for f in own}


def _table(rows) -> str:
    cell = lambda x: f"{x!r}::double" if isinstance(x, float) else repr(x)
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def oracle_sql():
    places = f"""e as (select vec_id // 10 as seq_id, cast(vec_id % 10 as int) as pos, label as token, embedding from embeddings),
        s as (select *, min(case when token = {STOP} then pos end) over (partition by seq_id) as stop, max(pos) over (partition by seq_id) as last from e),
        p as (select seq_id, pos, token, pos = last as is_last, embedding from s where stop is null or pos < stop)"""
    d = "list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: (p.embedding[i]::double - c.embedding[i]::double) * (p.embedding[i]::double - c.embedding[i]::double)))"
    assigned = f"{places}, a as materialized (select seq_id, pos, token, is_last, p.embedding, cast(arg_min(c.vec_id, ({d}, c.vec_id)) as int) as cluster from p, embeddings c where c.vec_id < {STATES - 1} group by all)"
    moves = f"select i, k, cast(count(*) as double) as mass from (select cluster as i, coalesce(lead(cluster) over (partition by seq_id order by pos), {STATES - 1}) as k, is_last from a) where not is_last group by 1, 2 union all select {STATES - 1}, {STATES - 1}, 1.0"
    emits = f"select cluster as i, token as k, cast(count(*) as double) as mass from a group by 1, 2 union all select {STATES - 1}, {STOP}, 1.0"
    starts = "select 0 as i, cluster as k, cast(count(*) as double) as mass from a where pos = 0 group by 1, 2"
    full = lambda kind, src, rows, cols: f"select '{kind}' as kind, i, k, round((coalesce(mass, 0) + {0.5 / cols!r}) / sum(coalesce(mass, 0) + {0.5 / cols!r}) over (partition by i), 6) as p from (select cast(i as int) as i, cast(k as int) as k from range({rows}) x(i), range({cols}) y(k)) left join ({src}) using (i, k)"

    # completions by relations: f0..f3 given the state at the first token
    move = _table([(i, j, float(MODEL.move[i, j])) for i in range(H) for j in range(H)])
    emit = _table([(i, w, float(MODEL.emit[i, w])) for i in range(H) for w in range(V)])
    gate = _table([(q, w, 2 if q == 2 or (q == 1 and w == 1) else int(w == 1)) for q in range(3) for w in range(V)])
    parts = f"""m(i, j, p) as {move}, em(i, w, p) as {emit}, st(q, w, r) as {gate},
        b1 as (select i, p as x from em where w = 4), b0 as (select em.i, em.p * sum(m.p * b1.x) as x from em join m on m.i = em.i join b1 on b1.i = m.j where em.w = 0 group by em.i, em.p),
        f0 as (select q, i, case when q < 2 then x else 0 end as x from range(3) r(q), b0)"""
    for t in (1, 2, 3):
        parts += f", f{t} as (select st.q, em.i, sum(em.p * m.p * f.x) as x from st join em on em.w = st.w join m on m.i = em.i join f{t - 1} f on f.q = st.r and f.i = m.j group by 1, 2)"
    every = " union all ".join(f"select {t} as t, q, i, x from f{t}" for t in range(4))
    seq = f"with recursive {models.sequence_sql(False)}, {models.forward_sql()}, {parts}"
    part = f"with recursive {models.sequence_sql(True)}, {models.forward_sql()}, {parts}"
    state = "z as (select user_id, max(case when w = 1 and before = 1 then 1 else 0 end) as dead, max_by(coalesce(w, -1), pos) as last from (select *, lag(w) over (partition by user_id order by pos) as before from s) group by 1)"
    after = "a as (select f.user_id, m.j as i, sum(case m.i " + " ".join(f"when {i} then e{i}" for i in range(H)) + " end * m.p) as p from f join n on n.user_id = f.user_id and n.len = f.pos, m group by 1, 2)"
    # a user's last two events as automaton input
    two = "t as (select user_id, len, max(w) filter (where pos = len - 1) as t1, max(w) filter (where pos = len) as t2 from s join n using (user_id) where len >= 2 group by 1, 2)"
    c0 = "c0 as (select m.i, f.q, sum(m.p * f.x) as x from m join f0 f on f.i = m.j group by 1, 2)"
    nexts = f"""{after}, {two}, {c0}, nx as (select t.user_id, em.w as token, sum(a.p * em.p * c0.x) + case when em.w = 0 and not (t1 = 1 and t2 = 1) then (select sum(a2.p * b0.x) from a a2 join b0 using (i) where a2.user_id = t.user_id) else 0 end
          + case when em.w = 4 and t2 = 0 then (select sum(a2.p * b1.x) from a a2 join b1 using (i) where a2.user_id = t.user_id) else 0 end as num, sum(a.p * em.p) as den
        from t join a using (user_id) join em on em.i = a.i join st s2 on s2.w = em.w and s2.q = case when t1 = 1 and t2 = 1 then 2 when t2 = 1 then 1 else 0 end join c0 on c0.i = em.i and c0.q = s2.r group by t.user_id, em.w, t1, t2)"""
    followed = lambda missing: f"""with recursive {models.sequence_sql(missing)}, {models.forward_sql()}, {state} select n.user_id, n.len as n, case when dead = 1 then 2 when last = 1 then 1 else 0 end as state, dead = 0 as accepted, round(ll, 6) as ll
            from z join n using (user_id) join f on f.user_id = n.user_id and f.pos = n.len"""  # noqa: E731
    labels = "l as (select vec_id // 10 as seq_id, list(label order by vec_id % 10) as t from embeddings group by 1)"
    logp = """o as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n, -value / 100 as logp from events),
        r as (select *, case when pos < 2 then 'prompt' when pos >= n - 2 then 'suffix' else 'generated' end as part from o)"""
    scored = lambda pen: f"select user_id, user_id % 10 as grp, sum(logp) / pow(count(*), {pen}) as score from r where part <> 'prompt' group by 1"
    rank = "cast(row_number() over (partition by grp order by score desc, user_id) as int)"
    return {
        "lvd_positions": f"with {places} select seq_id, pos, token, is_last from p",
        "embedding_slice": "select a.vec_id // 10 as seq_id, cast(a.vec_id % 10 - 3 as int) as pos, a.label as token, round(b.embedding[1]::double, 6) as x0 from embeddings a left join embeddings b on b.vec_id = a.vec_id - 1 where a.vec_id % 10 between 3 and 7",
        "kmeans_assign": f"with {assigned} select seq_id, pos, cluster from a",
        "kmeans_step": f"with {assigned} select cluster, cast(dim as int) as dim, round(avg(x), 6) as mean from (select cluster, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from a where pos <> 0) group by 1, 2",
        "lvd_alpha": f"with {assigned} {moves}",
        "lvd_beta": f"with {assigned} {emits}",
        "lvd_gamma": f"with {assigned} {starts}",
        "lvd_params": f"with {assigned} {full('alpha', moves, STATES, STATES)} union all {full('beta', emits, STATES, LABELS)} union all {full('gamma', starts, 1, STATES)}",
        "dfa_class_weights": f"with em(i, w, p) as {emit} select case when w = 1 then 1 else 0 end as cls, i, round(sum(p), 9) as w from em group by 1, 2",
        "constraint_prob": f"{seq}, {state}, {after}, y as ({every}) select user_id, round(sum(p * x), 9) as p, sum(p * x) > 0 as feasible from z join a using (user_id) join y on y.i = a.i and y.q = case when dead = 1 then 2 when last = 1 then 1 else 0 end where t between 1 and 3 group by 1",
        "constraint_prob_missing": f"{part}, {state}, {after}, y as ({every}) select user_id, round(sum(p * x), 9) as p, sum(p * x) > 0 as feasible from z join a using (user_id) join y on y.i = a.i and y.q = case when dead = 1 then 2 when last = 1 then 1 else 0 end where t between 1 and 3 group by 1",
        "constraint_prob_ranges": f"{seq}, {state}, {after}, y as ({every}) select user_id, round(sum(p * x), 9) as p, sum(p * x) > 0 as feasible from z join a using (user_id) join y on y.i = a.i and y.q = case when dead = 1 then 2 when last = 1 then 1 else 0 end where t between user_id % 3 and case when user_id % 4 > 0 then user_id % 3 + 1 else 3 end group by 1",
        "constraint_ranges": f"with {parts}, y as ({every}), c as (select t, q, m.i, sum(m.p * x) as x from y join m on m.j = y.i group by 1, 2, 3) select lo, hi, cast(q as int) as state, i, round(sum(x), 9) as w from c join {_table([(0, 2), (0, 1), (0, 0)])} r(lo, hi) on t between lo and hi group by 1, 2, 3, 4",
        "suffix_overlap": f"""with {models.sequence_sql(False)}, l as (select user_id, list(w order by pos) as t, max(len) as len from s join n using (user_id) group by 1),
            q as (select *, list_transform(range(0, 3), lambda k: not contains(array_to_string(t[1:len - k], ''), '11')) as calm from l)
            select user_id, concat_ws(',', case when calm[1] and len >= 1 then '0' end, case when t[len] = 0 and calm[2] and len >= 2 then '1' end, case when t[len] = 4 and t[len - 1] = 0 and calm[3] and len >= 3 then '2' end) as lengths from q""",
        "constraint_next_token": f"{seq}, {nexts} select user_id, token, round(num, 9) as num, round(den, 9) as den from nx",
        "constraint_reweight": f"""{seq}, {nexts}, k as (select user_id, w as token, count(*) / 10 as logit from s group by 1, 2),
            x1 as (select nx.*, coalesce(logit, 0) - ln(sum(exp(coalesce(logit, 0))) over (partition by user_id)) as base from nx left join k using (user_id, token)),
            x2 as (select *, base + 0.7 * (case when num > 0 then ln(num) else -1e30 end - ln(den)) as x from x1),
            x3 as (select *, (x - m - ln(sum(exp(x - m)) over (partition by user_id))) / 1.5 as y from (select *, max(x) over (partition by user_id) as m from x2)),
            x4 as (select *, max(y) over (partition by user_id) as m2 from x3)
            select user_id, token, round(y - m2 - ln(sum(exp(y - m2)) over (partition by user_id)), 6) as logp, max(num) over (partition by user_id) > 0 as feasible from x4""",
        "constraint_reweight_ended": f"""{seq}, {nexts}, u as (select user_id, max(t2) = 4 as ended from t group by 1),
            x0 as (select user_id, token, num, den from nx union all select user_id, {V}, null, null from u),
            x1 as (select *, (user_id * 7 + token * 3) % 5 / 2 as logit from x0 join u using (user_id)),
            x2 as (select *, logit - ln(sum(exp(logit)) over (partition by user_id)) as base from x1),
            x3 as (select *, case when ended then base else base + 0.7 * case when num > 0 then ln(num) - ln(den) else -1e30 end end as x from x2),
            x4 as (select *, (x - m - ln(sum(exp(x - m)) over (partition by user_id))) / 1.5 as y from (select *, max(x) over (partition by user_id) as m from x3)),
            x5 as (select *, max(y) over (partition by user_id) as m2 from x4)
            select user_id, token, round(y - m2 - ln(sum(exp(y - m2)) over (partition by user_id)), 6) as logp, coalesce(max(num) over (partition by user_id) > 0, false) as feasible from x5""",
        "extract_generated": f"""with {labels}, w as (select seq_id, list_slice(t, 1, coalesce(list_max(list_filter(range(1, len(t) + 1), lambda k: t[k] <> {STOP})), 0)) as w from l), r as (select seq_id, w[3:] as r from w)
            select seq_id, array_to_string(r[1:len(r) - case when len(r) >= 2 and r[len(r) - 1] = 3 and r[len(r)] = 4 then 2 when len(r) >= 1 and r[len(r)] = 3 then 1 else 0 end], ',') as generated from r""",
        "rank_generated": f"with {logp}, x as ({scored('0.9')}) select user_id, grp, round(score, 6) as score, {rank} as rank from x",
        "rank_topk": f"with {logp}, x as ({scored('1.0')}), y as (select user_id, grp, round(score, 6) as score, {rank} as rank from x) select * from y where rank <= 3",
        "rank_two_stage": f"""with {logp}, x as ({scored('1.0')}), u as (select user_id, logp as fit from r where part = 'suffix' and pos = greatest(n - 2, 2)),
            y as (select *, row_number() over (partition by grp order by fit desc, user_id) as first from x join u using (user_id))
            select user_id, grp, round(fit, 6) as fit, round(score, 6) as score, {rank} as rank from y where first <= 5""",
        "stream_dfa": followed(False), "stream_dfa_missing": followed(True), "stream_dfa_recovery": followed(False),
    }
