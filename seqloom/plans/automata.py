"""Queries over automata: predicates on sequences, language algebra, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.dfa import Dfa, always, contains, contains_any, graph, stop_once, word_count
from seqloom.dfa.execute import last_state, matches
from seqloom.operators.tokens import classify, count_words, reduce_pattern_table
from seqloom.sources import streams

PHRASE, OTHERS = ["of", "the"], [["of", "the"], ["in", "of"], ["of", "the", "and"], ["der"]]
THE, AND = contains(["the"]), contains(["and"])
#: No two errors in a row.
CALM = ~contains([1, 1])


def _on_documents(dfa: Dfa):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return streams.documents(spark, sf_dir).select("doc_id", matches(F.col("tokens"), dfa).alias("hit"))

    return query


def dfa_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.orders(spark, sf_dir).select("l_orderkey", matches(F.col("tokens"), stop_once("R")).alias("hit"))


def token_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = streams.documents(spark, sf_dir).select(F.explode("tokens").alias("token"))
    counted = token.groupBy("token").agg(F.count("*").alias("n"))
    separated, wordy = classify(F.col("token"))
    return counted.select("token", "n", separated.alias("separated"), wordy.alias("wordy"))


def dfa_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.documents(spark, sf_dir).select("doc_id", count_words(F.col("tokens"), 100, 200).alias("hit"))


def dfa_pattern_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns: the first two, three and four words of each benchmark item, and its second."""
    items = streams.table(spark, sf_dir, "benchmark").select(streams.words(F.col("text")).alias("w"))
    cuts = F.array(F.slice("w", 1, 2), F.slice("w", 1, 3), F.slice("w", 1, 4), F.slice("w", 2, 1))
    patterns = items.select(F.explode(cuts).alias("pattern")).where(F.size("pattern") > 0)
    return reduce_pattern_table(patterns).select(F.array_join("pattern", " ").alias("pattern"))


# graphs: the product of two automata with all its pairs of states, as they are
# before states that can't be reached are dropped


def raw_product() -> tuple[list[tuple[int, int, int]], list[tuple[int, bool, bool]]]:
    a, b = contains_any([["x", "y"], ["y", "y", "x"]]), stop_once("y")
    tokens = {None: 0, "x": 1, "y": 2}
    number = lambda s, t: s * len(b.step) + t
    pairs = [(s, t) for s in range(len(a.step)) for t in range(len(b.step))]
    edges = [(number(s, t), c, number(a.next(s, w), b.next(t, w))) for s, t in pairs for w, c in tokens.items()]
    return edges, [(number(s, t), s == t == 0, s in a.accept and t not in b.accept) for s, t in pairs]


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    edges, states = raw_product()
    return spark.createDataFrame(edges, "src int, cls int, dst int"), spark.createDataFrame(states, "state int, is_initial boolean, is_accept boolean")


def dfa_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, states = _graph(spark)
    return graph.reach(edges, states.where("is_initial").select("state"))


def dfa_live_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, states = _graph(spark)
    return graph.live(edges, states.where("is_accept").select("state"))


def dfa_state_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.state_groups(*_graph(spark))


def dfa_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even states renamed, a state copied, and all numbered anew."""
    edges, states = _graph(spark)
    names = states.where("state % 2 = 0").select("state", (F.col("state") * 10 + 100).alias("name"))
    return graph.reindex(graph.copy_state(graph.relabel(edges, names), 1, 500))


def dfa_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _graph(spark)
    states = edges.select(F.col("src").alias("s")).union(edges.select("dst")).agg(F.count_distinct("s").alias("n_states"))
    return states.crossJoin(edges.agg(F.count_distinct("src", "dst").alias("n_edges")))


def dfa_legal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that may follow a user's events so that the constraint can
    still be met."""
    live = CALM.live()
    legal = [(s, t) for s in range(len(CALM.step)) for t in range(5) if CALM.next(s, t) in live]
    edges = spark.createDataFrame(legal, "state int, token int")
    at = streams.events(spark, sf_dir).select("user_id", last_state(F.col("tokens"), CALM).alias("state"))
    return at.join(F.broadcast(edges), "state").select("user_id", "token")


def queries():
    return {
        "dfa_contains": _on_documents(contains(PHRASE)),
        "dfa_contains_any": _on_documents(contains_any(OTHERS)),
        "dfa_trivial": _on_documents(always()),
        "dfa_eos": dfa_eos,
        "token_classify": token_classify,
        "dfa_word_count": dfa_word_count,
        "dfa_pattern_reduce": dfa_pattern_reduce,
        "dfa_and": _on_documents(THE & AND),
        "dfa_or": _on_documents(THE | contains(["der"])),
        "dfa_not": _on_documents(~THE),
        "dfa_then": _on_documents(THE.then(AND)),
        "dfa_reachable": dfa_reachable,
        "dfa_live_states": dfa_live_states,
        "dfa_state_groups": dfa_state_groups,
        "dfa_relabel": dfa_relabel,
        "dfa_size": dfa_size,
        "dfa_legal_tokens": dfa_legal_tokens,
    }


WORDS = "list_filter(string_split_regex(text, '[ \\n]'), lambda x: x <> '')"
_SPACED = f"(' ' || array_to_string({WORDS}, ' ') || ' ')"


def _has(phrase: str) -> str:
    return f"contains({_SPACED}, ' {phrase} ')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x).lower() for x in r) + ")" for r in rows)


def oracle_sql():
    edges, states = raw_product()
    graph_sql = f"with recursive e(src, cls, dst) as (values {_values(edges)}), s(state, is_initial, is_accept) as (values {_values(states)})"
    docs = lambda test: f"select doc_id, {test} as hit from documents"
    events = """ev as (select user_id, row_number() over (partition by user_id order by ts, event_id) as pos,
                 list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as token from events)"""
    return {
        "dfa_contains": docs(_has("of the")),
        "dfa_contains_any": docs(" or ".join(map(_has, ("of the", "in of", "of the and", "der")))),
        "dfa_trivial": docs("text is not null"),
        "dfa_eos": """select l_orderkey, coalesce(max(pos) filter (where l_returnflag <> 'R') < min(pos) filter (where l_returnflag = 'R'), true) as hit
            from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as pos from lineitem) group by 1""",
        "token_classify": f"""select token, count(*) as n, substr(token, 1, 1) in (' ', chr(10), ',', '.', ':', ';', '"', '/') as separated,
            regexp_matches(token, '[\\p{{L}}\\p{{Nd}}]') as wordy from (select unnest({WORDS}) as token from documents) group by token""",
        "dfa_word_count": f"""select doc_id, len(list_filter({WORDS}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nd}}]'))) between 100 and 200 as hit from documents""",
        "dfa_pattern_reduce": f"""with w as (select {WORDS} as w from benchmark),
            p as (select distinct p from (select unnest([w[1:2], w[1:3], w[1:4], w[2:2]]) as p from w) where len(p) > 0)
            select array_to_string(p, ' ') as pattern from p where not exists (select 1 from p q where q.p <> p.p
              and contains(' ' || array_to_string(p.p, ' ') || ' ', ' ' || array_to_string(q.p, ' ') || ' '))""",
        "dfa_and": docs(f"{_has('the')} and {_has('and')}"),
        "dfa_or": docs(f"{_has('the')} or {_has('der')}"),
        "dfa_not": docs(f"not {_has('the')}"),
        "dfa_then": docs(f"coalesce(list_contains(list_slice({WORDS}, nullif(list_position({WORDS}, 'the'), 0) + 1, len({WORDS})), 'and'), false)"),
        "dfa_reachable": f"{graph_sql}, r as (select state from s where is_initial union select e.dst from r join e on e.src = r.state) select state from r",
        "dfa_live_states": f"{graph_sql}, r as (select state from s where is_accept union select e.src from r join e on e.dst = r.state) select state from r",
        "dfa_state_groups": f"""{graph_sql}, apart as (select a.state as p, b.state as q from s a, s b where a.is_accept <> b.is_accept
            union select x.src, y.src from apart join e x on x.dst = apart.p join e y on y.dst = apart.q and y.cls = x.cls)
            select state, cast(dense_rank() over (order by least) - 1 as int) as grp from (
            select a.state, min(b.state) as least from s a, s b where not exists (select 1 from apart where p = a.state and q = b.state) group by 1)""",
        "dfa_relabel": f"""{graph_sql}, r as (select case when src % 2 = 0 then src * 10 + 100 else src end as src, cls, case when dst % 2 = 0 then dst * 10 + 100 else dst end as dst from e),
            c as (select * from r union all select 500, cls, dst from r where src = 1), k as (select s, cast(row_number() over (order by s) - 1 as int) as n from (select src as s from c union select dst from c))
            select a.n as src, cls, b.n as dst from c join k a on a.s = c.src join k b on b.s = c.dst""",
        "dfa_size": f"{graph_sql} select (select count(distinct x) from (select src as x from e union all select dst from e)) as n_states, (select count(distinct (src, dst)) from e) as n_edges",
        "dfa_legal_tokens": f"""with {events}, f as (select user_id, max(case when token = 1 and before = 1 then 1 else 0 end) as broken, max_by(token, pos) as last
              from (select *, lag(token) over (partition by user_id order by pos) as before from ev) group by 1)
            select user_id, cast(t as int) as token from f, range(5) r(t) where broken = 0 and not (last = 1 and t = 1)""",
    }
