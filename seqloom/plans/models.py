"""HMM queries over event sequences: likelihoods, posteriors, EM, log space."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import logspace
from seqloom.hmm import Hmm, inference, learning
from seqloom.sources import streams

MODEL = Hmm(
    np.array([0.5, 0.3, 0.2]),
    np.array([[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.25, 0.25, 0.5]]),
    np.array([[0.4, 0.1, 0.1, 0.1, 0.3], [0.1, 0.4, 0.2, 0.2, 0.1], [0.2, 0.2, 0.3, 0.2, 0.1]]),
)
H, V, STOP = MODEL.states, MODEL.tokens, 4
RATE, PSEUDO, SCHEDULE, CHUNKS = 0.1, 0.01, "2,1;1,3", 4


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.events(spark, sf_dir)


def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event sequences whose events of small value are missing."""
    token = F.when(F.col("value") >= 3, streams.event_token())
    return streams.ordered(streams.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], token)


def _loglik(rows: DataFrame) -> DataFrame:
    return inference.log_likelihood(rows, MODEL, "user_id").withColumn("ll", F.round("ll", 6))


def hmm_loglik(spark, sf_dir):
    return _loglik(_events(spark, sf_dir))


def hmm_loglik_missing(spark, sf_dir):
    return _loglik(_partial(spark, sf_dir))


def hmm_total_ll(spark, sf_dir):
    rows = inference.log_likelihood(_events(spark, sf_dir), MODEL, "user_id")
    return rows.agg(F.round(F.sum("ll"), 4).alias("total"), F.count("*").alias("n"))


def hmm_prefix_state(spark, sf_dir):
    """The next state's probabilities after all of a user's events."""
    state = inference.fold(F.col("tokens"), MODEL)["a"]
    return _events(spark, sf_dir).select("user_id", F.posexplode(state).alias("i", "p")).withColumn("p", F.round("p", 6))


def hmm_posterior(spark, sf_dir):
    return inference.posterior(_partial(spark, sf_dir), MODEL, "user_id").withColumn("p", F.round("p", 6))


def hmm_flows(spark, sf_dir):
    return inference.flows(_partial(spark, sf_dir), MODEL).withColumn("mass", F.round("mass", 4))


def hmm_bruteforce(spark, sf_dir):
    """Likelihood of the first four events by all paths of states: a fixed list of
    paths, exploded."""
    paths = [(a, b, c, d) for a in range(H) for b in range(H) for c in range(H) for d in range(H)]
    rows = []
    for p in paths:
        weight = MODEL.start[p[0]] * np.prod([MODEL.move[p[t], p[t + 1]] for t in range(3)])
        emit = ", ".join("array(" + ", ".join(f"{x!r}D" for x in MODEL.emit[s].tolist()) + ")" for s in p)
        rows.append(f"struct({float(weight)!r}D as w, array({emit}) as e)")
    df = _events(spark, sf_dir).where("size(tokens) >= 4").select("user_id", "tokens", F.explode(F.expr(f"array({', '.join(rows)})")).alias("x"))
    terms = df.select("user_id", F.expr("x.w * x.e[0][tokens[0]] * x.e[1][tokens[1]] * x.e[2][tokens[2]] * x.e[3][tokens[3]]").alias("p"))
    return terms.groupBy("user_id").agg(F.round(F.log(F.sum("p")), 6).alias("ll"))


def em_dropout(spark, sf_dir):
    rows = _events(spark, sf_dir)
    dropped = learning.dropout(F.col("tokens"), F.col("user_id"), STOP, RATE)
    return rows.select("user_id", F.array_join(F.transform(dropped, lambda t: F.coalesce(t, F.lit(-1))), ",").alias("tokens"))


def _flows(spark, sf_dir):
    return inference.flows(_partial(spark, sf_dir), MODEL)


def em_missing_redist(spark, sf_dir):
    beta = _flows(spark, sf_dir).where("kind = 'beta'")
    return learning.redistribute(beta, V, STOP).withColumn("mass", F.round("mass", 4))


def em_mstep(spark, sf_dir):
    alpha = _flows(spark, sf_dir).where("kind = 'alpha'")
    return learning.normalized(alpha, H, PSEUDO).withColumn("p", F.round("p", 6))


def em_step(spark, sf_dir):
    return learning.maximize(_flows(spark, sf_dir), H, V, STOP, PSEUDO).withColumn("p", F.round("p", 6))


def em_schedule(spark, sf_dir):
    rows = [(n, c) for n, chunks in enumerate(learning.schedule(SCHEDULE, CHUNKS), 1) for c in chunks]
    sizes = streams.table(spark, sf_dir, "events").groupBy((F.col("event_id") % CHUNKS).cast("int").alias("chunk")).agg(F.count("*").alias("n"))
    return F.broadcast(spark.createDataFrame(rows, "step int, chunk int")).join(sizes, "chunk")


def logsumexp_agg(spark, sf_dir):
    rows = streams.table(spark, sf_dir, "events").select("event_type", "value")
    return logspace.logsumexp_by(rows, ["event_type"], "value", "lse").withColumn("lse", F.round("lse", 6))


def _matrix(spark, sf_dir, logs: bool):
    """Users' shares of event types (i, k) and types' mean values (k, j)."""
    ev = streams.table(spark, sf_dir, "events").withColumn("k", streams.event_token())
    a = ev.groupBy(F.col("user_id").alias("i"), "k").agg(F.count("*").alias("x")).withColumn("x", F.col("x") / 100.0)
    b = ev.groupBy("k", (F.col("event_id") % 3).cast("int").alias("j")).agg((F.avg("value") / 50).alias("x"))
    return (a.withColumn("x", F.log("x")), b.withColumn("x", F.log("x"))) if logs else (a, b)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.round("x", 6))


def matmul_log(spark, sf_dir):
    return _rounded(logspace.matmul_log(*_matrix(spark, sf_dir, True)))


def matmul_loga_b(spark, sf_dir):
    return _rounded(logspace.matmul_loga_b(_matrix(spark, sf_dir, True)[0], _matrix(spark, sf_dir, False)[1]))


def matmul_a_logb(spark, sf_dir):
    return _rounded(logspace.matmul_a_logb(_matrix(spark, sf_dir, False)[0], _matrix(spark, sf_dir, True)[1]))


def edge_weights(spark, sf_dir):
    """Edges of a graph of event types take their targets' weights, states sum
    what leaves them: the two steps of going back through an automaton once.
    Classes are hours of the day, weights logarithms of users' counts."""
    ev = streams.table(spark, sf_dir, "events").withColumn("token", streams.event_token())
    edges = ev.select((F.col("event_id") % 5).cast("int").alias("src"), F.hour("ts").alias("cls"), F.col("token").alias("dst")).distinct()
    weights = ev.groupBy(F.col("token").alias("state"), (F.col("user_id") % 4).cast("int").alias("i")).agg((F.log(F.count("*").cast("double")) - 10).alias("x"))
    return _rounded(logspace.from_edges(logspace.to_edges(edges, weights)))


def queries():
    own = (
        hmm_loglik, hmm_loglik_missing, hmm_total_ll, hmm_prefix_state, hmm_posterior, hmm_flows, hmm_bruteforce, em_dropout,
        em_missing_redist, em_mstep, em_step, em_schedule, logsumexp_agg, matmul_log, matmul_loga_b, matmul_a_logb, edge_weights,
    )
    return {f.__name__: f for f in own}


def _list(values) -> str:
    return "[" + ", ".join(map(repr, np.asarray(values).tolist())) + "]"


def sequence_sql(missing: bool) -> str:
    """s(user_id, pos, w): events in order, w the token or null."""
    token = "list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1"
    return f"""s as materialized (select user_id, row_number() over (partition by user_id order by ts, event_id) as pos,
        {f'case when value >= 3 then {token} end' if missing else token} as w from events), n as (select user_id, max(pos) as len from s group by 1)"""


def forward_sql() -> str:
    """f(user_id, pos, e0.., ll): filtered probabilities and log likelihood."""
    emit = lambda i: f"coalesce({_list(MODEL.emit[i])}[w + 1], 1.0)"
    prior = lambda j: " + ".join(f"f.e{i} * {MODEL.move[i, j]!r}" for i in range(H)).replace("np.float64(", "").replace(")", "")
    first = ", ".join(f"{float(MODEL.start[i])!r} * {emit(i)} as e{i}" for i in range(H))
    later = ", ".join(f"({prior(j)}) * {emit(j)} as e{j}" for j in range(H))
    total = " + ".join(f"e{i}" for i in range(H))
    normed = ", ".join(f"e{i} / ({total}) as e{i}" for i in range(H))
    return f"""f as (select user_id, pos, {normed}, ln({total}) as ll from (select user_id, pos, {first} from s where pos = 1)
        union all select user_id, pos, {normed}, before + ln({total}) from (select s.user_id, s.pos, f.ll as before, {later} from f join s on s.user_id = f.user_id and s.pos = f.pos + 1))"""


def backward_sql() -> str:
    """b(user_id, pos, b0..) and g(user_id, pos, w, p0..): posteriors."""
    emit = lambda j: f"coalesce({_list(MODEL.emit[j])}[w + 1], 1.0)"
    sums = [" + ".join(f"{float(MODEL.move[i, j])!r} * {emit(j)} * b{j}" for j in range(H)) for i in range(H)]
    raw = ", ".join(f"{x} as c{i}" for i, x in enumerate(sums))
    total, joint = " + ".join(f"c{i}" for i in range(H)), " + ".join(f"e{i} * b{i}" for i in range(H))
    return f"""b as (select user_id, len as pos, {', '.join(f'1.0::double as b{i}' for i in range(H))} from n
        union all select user_id, pos - 1, {', '.join(f'c{i} / ({total})' for i in range(H))} from (select b.user_id, b.pos, {raw} from b join s on s.user_id = b.user_id and s.pos = b.pos where b.pos > 1)),
      g as (select f.user_id, f.pos, s.w, {', '.join(f'e{i} * b{i} / ({joint}) as p{i}' for i in range(H))} from f join b using (user_id, pos) join s using (user_id, pos))"""


def flow_sql() -> str:
    """fl(kind, i, k, mass) over sequences with missing tokens, after a "with recursive"."""
    emit = lambda j: f"coalesce({_list(MODEL.emit[j])}[s.w + 1], 1.0)"
    pair = lambda i, j: f"f.e{i} * {float(MODEL.move[i, j])!r} * {emit(j)} * b.b{j}"
    every = " + ".join(pair(i, j) for i in range(H) for j in range(H))
    moves = " union all ".join(f"select 'alpha' as kind, {i} as i, {j} as k, sum({pair(i, j)} / ({every})) as mass from f join s on s.user_id = f.user_id and s.pos = f.pos + 1 join b on b.user_id = s.user_id and b.pos = s.pos" for i in range(H) for j in range(H))
    emits = " union all ".join(f"select 'beta', {i}, v.k, coalesce((select sum(p{i}) from g where coalesce(g.w, {V}) = v.k), 0) from range({V + 1}) v(k)" for i in range(H))
    starts = " union all ".join(f"select 'gamma', {i}, null, sum(p{i}) from g where pos = 1" for i in range(H))
    return f"with recursive {sequence_sql(True)}, {forward_sql()}, {backward_sql()}, fl as materialized ({moves} union all {emits} union all {starts})"


def oracle_sql():
    last = "select f.* from f join n on n.user_id = f.user_id and n.len = f.pos"
    full = f"with recursive {sequence_sql(False)}, {forward_sql()}, z as ({last})"
    part = f"with recursive {sequence_sql(True)}, {forward_sql()}, z as ({last})"
    after = " union all ".join(f"select user_id, {j} as i, round({' + '.join(f'e{i} * {float(MODEL.move[i, j])!r}' for i in range(H))}, 6) as p from z" for j in range(H))
    post = " union all ".join(f"select user_id, cast(pos - 1 as int) as pos, {i} as i, round(p{i}, 6) as p from g" for i in range(H))
    drawn = lambda k: f"(user_id * 7919 + ({k}) * 104729 + 15485863) % 10000 < {int(RATE * 10000)}"
    beta = f"(select kind, i, k, case when k = {STOP} then greatest(mass, 1e-7) else mass + (select mass from fl m where m.kind = 'beta' and m.i = x.i and m.k = {V}) / {V - 1} end as mass from fl x where kind = 'beta' and k < {V})"
    step = lambda src, cols: f"select kind, i, k, round((mass + {PSEUDO / cols!r}) / sum(mass + {PSEUDO / cols!r}) over (partition by i), 6) as p from {src}"
    brute = " + ".join(
        f"{float(MODEL.start[a] * MODEL.move[a, b] * MODEL.move[b, c] * MODEL.move[c, d])!r} * {_list(MODEL.emit[a])}[t[1] + 1] * {_list(MODEL.emit[b])}[t[2] + 1] * {_list(MODEL.emit[c])}[t[3] + 1] * {_list(MODEL.emit[d])}[t[4] + 1]"
        for a in range(H) for b in range(H) for c in range(H) for d in range(H)
    )
    plan = ", ".join(str((n, c)) for n, cs in enumerate(([0], [1], [2, 3, 0]), 1) for c in cs)
    product = """with e as (select *, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as k from events),
        a as (select user_id as i, k, count(*) / 100.0 as x from e group by 1, 2), b as (select k, cast(event_id % 3 as int) as j, avg(value) / 50 as x from e group by 1, 2)
        select i, j, round(ln(sum(a.x * b.x)), 6) as x from a join b using (k) group by 1, 2"""
    return {
        "hmm_loglik": f"{full} select user_id, round(ll, 6) as ll from z",
        "hmm_loglik_missing": f"{part} select user_id, round(ll, 6) as ll from z",
        "hmm_total_ll": f"{full} select round(sum(ll), 4) as total, count(*) as n from z",
        "hmm_prefix_state": f"{full} {after}",
        "hmm_posterior": f"with recursive {sequence_sql(True)}, {forward_sql()}, {backward_sql()} {post}",
        "hmm_flows": f"{flow_sql()} select kind, i, cast(k as int) as k, round(mass, 4) as mass from fl",
        "hmm_bruteforce": f"with {sequence_sql(False)}, t as (select user_id, list(w order by pos) as t from s group by 1) select user_id, round(ln({brute}), 6) as ll from t where len(t) >= 4",
        "em_dropout": f"""with {sequence_sql(False)}, d as (select user_id, pos, case when pos = len and {drawn(-1)} then {STOP} else w end as w from s join n using (user_id))
            select user_id, string_agg(cast(case when w <> {STOP} and {drawn('pos - 1')} then -1 else w end as varchar), ',' order by pos) as tokens from d group by 1""",
        "em_missing_redist": f"{flow_sql()} select i, cast(k as int) as k, round(mass, 4) as mass from {beta}",
        "em_mstep": f"{flow_sql()} select i, cast(k as int) as k, p from ({step('''(select * from fl where kind = 'alpha')''', H)})",
        "em_step": f"""{flow_sql()} select kind, i, cast(k as int) as k, p from ({step('''(select * from fl where kind = 'alpha')''', H)}
            union all {step(beta, V)} union all {step('''(select kind, 0 as i, i as k, mass from fl where kind = 'gamma')''', H)})""",
        "em_schedule": f"select step, chunk, n from (values {plan}) p(step, chunk) join (select event_id % {CHUNKS} as chunk, count(*) as n from events group by 1) using (chunk)",
        "logsumexp_agg": "select event_type, round(max(value) + ln(sum(exp(value - m))), 6) as lse from (select *, max(value) over (partition by event_type) as m from events) group by 1, m",
        "edge_weights": """with e as (select *, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as token from events),
            g as (select distinct cast(event_id % 5 as int) as src, hour(ts) as cls, token as dst from e),
            w as (select token, cast(user_id % 4 as int) as i, ln(count(*)) - 10 as x from e group by 1, 2)
            select src as state, i, round(ln(sum(exp(x))), 6) as x from g join w on w.token = g.dst group by 1, 2""",
        "matmul_log": product, "matmul_loga_b": product, "matmul_a_logb": product,
    }
