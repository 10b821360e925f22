"""Secret scans by multipart credential linking (DataFrame functions only).

Three strong kinds are reported wherever they match:

* ``assign``  a credential word, a colon or equals sign and a value of 6 or
  more characters;
* ``access``  ``AKIA`` and capitals or digits, 20 or more in all;
* ``hex``     24 or more lower-case hexadecimal digits.

Three weak kinds are reported only where complementary parts stand within
``window`` code points, which is their scope:

* ``ident``     an account, user or client id with a value: with a secret;
* ``blob``      a mixed run of 32 or more base64 characters: with an identifier;
* ``endpoint``  a URL or an IPv4 address: with an identifier and a secret.

Identifiers are ``access`` and ``ident``; secrets are ``assign``, ``hex`` and
``blob``.  All parts of a document stand in its own row, so the interval join
runs inside the row and nothing is shuffled: two sweeps over the sorted spans, in
time linear in their number, however many a text has.

Nulls: a null text is an empty text and has no spans; a null id is kept.
Repeated rows and ties each give a row of their own.  An empty table gives an
empty result.  Only ``doc_id`` and ``text`` are read, so other columns never
clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import table, text_of

KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
BASE = 3

_ANY = "".join


def _either_case(word: str) -> str:
    return _ANY(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "(A)(KIA[A-Z0-9]+)"
HEX = "()([0-9a-f]{24,})"
IDENT = (
    "(" + "|".join([_either_case("user") + "(?:_?" + _either_case("name") + ")?", _either_case("login"), _either_case("account") + "(?:_?" + _either_case("id") + ")?", _either_case("client") + "_?" + _either_case("id")]) + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)"""
)
BLOB = "()([A-Za-z0-9+/]{32,}={0,2})"
ENDPOINT = r"""()(https?://[^\x00-\x20"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?)"""
PATTERNS = (ASSIGN, ACCESS, HEX, IDENT, BLOB, ENDPOINT)
#: Least length of the second group.
LEAST = (6, 19, 24, 3, 32, 7)

#: Start, kind, end in code points; start and end in bytes.
_SPAN = "struct<s:int,k:int,e:int,b:int,c:int>"
#: Beyond any place in a text.
_LOW, _HIGH = -1_000_000_000, 2_000_000_000


def _mixed(m: str) -> str:
    """A blob has a capital, a small letter and a digit."""
    return f"({m} rlike '[A-Z]' and {m} rlike '[a-z]' and {m} rlike '[0-9]')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(values: str, kind: str, zero: str, joined: Callable[[str, str], str], chunk: int = 256) -> str:
    """An array's running sums under ``joined``.  A list grows by copying, so sums
    run within chunks, then over the chunks' last ones: the work is that of a
    chunk for each element, not that of the array."""
    start = f"named_struct('p', {zero}, 'o', cast(array() as array<{kind}>))"
    step = _let("r", joined("a.p", "x"), "named_struct('p', r, 'o', array_append(a.o, r))")
    runs = f"""if(size(vs) = 0, cast(array() as array<array<{kind}>>), transform(sequence(0, cast((size(vs) - 1) div {chunk} as int)),
        n -> aggregate(slice(vs, n * {chunk} + 1, {chunk}), {start}, (a, x) -> {step}, a -> a.o)))"""
    before = f"aggregate(runs, {start}, (a, x) -> named_struct('p', {joined('a.p', 'element_at(x, -1)')}, 'o', array_append(a.o, a.p)), a -> a.o)"
    return _let("vs", values, _let("runs", runs, f"flatten(zip_with(runs, {before}, (run, z) -> transform(run, x -> {joined('z', 'x')})))"))


def _fields(names: str, value: Callable[[str], str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {value(n)}" for n in names) + ")"


def _spans_of(k: int) -> str:
    """Kind ``k``'s spans: running sums over the lengths of what lies between
    the matches and of the matches themselves."""
    q = _quoted(PATTERNS[k])
    keep = f"length(v[i]) >= {LEAST[k]}" + (f" and {_mixed('m[i]')}" if KINDS[k] == "blob" else "")
    ends = _scan("transform(m, (x, i) -> named_struct('e', length(g[i]) + length(x), 'c', octet_length(g[i]) + octet_length(x)))", "struct<e:int,c:int>", "named_struct('e', 0, 'c', 0)", lambda a, x: _fields("ec", lambda n: f"{a}.{n} + {x}.{n}"))
    span = f"named_struct('s', x.e - length(m[i]), 'k', {k}, 'e', x.e, 'b', x.c - octet_length(m[i]), 'c', x.c)"
    found = f"filter(transform({ends}, (x, i) -> if({keep}, {span}, cast(null as {_SPAN}))), x -> x is not null)"
    body = _let("m", f"regexp_extract_all(s5_text, {q}, 0)", _let("v", f"regexp_extract_all(s5_text, {q}, 2)", _let("g", f"split(s5_text, {q}, -1)", found)))
    return f"if(s5_text rlike {q}, {body}, cast(array() as array<{_SPAN}>))"


def _linked(window: int) -> str:
    """The spans of ``every`` (sorted by start) that stand: weak ones need their
    complements within the window.  A part before x is near if the furthest end so
    far is, one after it if the next start is, so two sweeps find all links."""
    ident, secret = "x.k in (1, 3)", "x.k in (0, 2, 4)"
    furthest = _scan(f"transform(every, x -> if(x.k < {BASE}, x.e, {_LOW}))", "int", str(_LOW), lambda a, x: f"greatest({a}, {x})")
    # a weak part that a strong one covers says nothing new
    kept = _let("far", furthest, f"filter(every, (x, i) -> x.k < {BASE} or far[i] < x.e)")
    sides = "struct<i:int,c:int>"
    sweep = lambda order, far, place, pick: _scan(f"transform({order}, x -> named_struct('i', if({ident}, {place}, {far}), 'c', if({secret}, {place}, {far})))", sides, f"named_struct('i', {far}, 'c', {far})", lambda a, x: _fields("ic", lambda n: f"{pick}({a}.{n}, {x}.{n})"))
    near = lambda n: f"(past[i].{n} >= x.s - {window} or next[i].{n} <= x.e + {window})"
    test = f"case x.k when 3 then {near('c')} when 4 then {near('i')} when 5 then {near('i')} and {near('c')} else true end"
    return _let("kept", kept, _let("past", sweep("kept", _LOW, "x.e", "greatest"), _let("next", f"reverse({sweep('reverse(kept)', _HIGH, 'x.s', 'least')})", f"filter(kept, (x, i) -> {test})")))


def find_spans(docs: DataFrame, window: int = 300, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns, ``s5_text`` and ``s5_spans``: array of
    (s, k, e, b, c), start and end in code points and in bytes, k an index of
    KINDS."""
    df = docs.select(*keep, text_of().alias("s5_text"))
    every = f"array_sort(concat({', '.join(map(_spans_of, range(len(KINDS))))}))"
    none = f"cast(array() as array<{_SPAN}>)"
    return df.select(*keep, "s5_text", F.expr(_let("every", every, f"if(size(every) = 0, {none}, {_linked(window)})")).alias("s5_spans"))


def _joined(spans: str) -> Column:
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)))")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.expr(f"cast(size(filter(s5_spans, x -> x.k = {k})) as bigint)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(f"filter(s5_spans, x -> x.k < {BASE})"), 256).alias("base_sha256"),
        _joined("s5_spans").alias("spans"),
    )


def redact(docs: DataFrame, window: int = 300, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text masked and, where there is an
    ``n_chars`` column, the length brought up to date.  Overlapping spans are
    masked as one.  A null text stays null."""
    names = docs.columns
    df = find_spans(docs.select("*", F.struct(*[F.col(f"`{c}`") for c in names]).alias("s5_row")), window, ("s5_row",))
    # what a span adds: the text since the furthest end before it and a mask, or
    # nothing if it begins before that end; bytes are cut, as they can be reached directly
    furthest = _scan("transform(spans, x -> x.c)", "int", "0", lambda a, x: f"greatest({a}, {x})")
    piece = f"if(i > 0 and x.b < far[i - 1], '', concat(cast(substring(raw, if(i > 0, far[i - 1], 0) + 1, x.b - if(i > 0, far[i - 1], 0)) as string), {mask!r}))"
    whole = f"concat(array_join(transform(spans, (x, i) -> {piece}), ''), cast(substring(raw, element_at(far, -1) + 1) as string))"
    cut = _let("spans", "s5_spans", _let("raw", "cast(s5_text as binary)", _let("far", furthest, whole)))
    df = df.select("s5_row", F.when(F.size("s5_spans") == 0, F.col("s5_row.text")).otherwise(F.expr(cut)).alias("s5_new"))
    new = {"text": F.col("s5_new")} | ({"n_chars": F.length("s5_new").cast("bigint")} if "n_chars" in names else {})
    return df.select(*[new.get(c, F.col(f"s5_row.`{c}`")).alias(c) for c in names])


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_spans(table(spark, sf_dir, "documents")))


def _sql() -> str:
    """The same by relations: one row a match, positions by running sums, the
    links by a join of intervals."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    each = " union all ".join(
        f"""select rid, {k} as k, unnest(regexp_extract_all(text, {quoted(p)}, 0)) as m,
            unnest(regexp_extract_all(text, {quoted(p)}, 2)) as v,
            unnest(list_slice(string_split_regex(text, {quoted(p)}), 1, len(regexp_extract_all(text, {quoted(p)}, 0)))) as g,
            unnest(range(1, len(regexp_extract_all(text, {quoted(p)}, 0)) + 1)) as i from d"""
        for k, p in enumerate(PATTERNS)
    )
    least = " ".join(f"when {k} then length(v) >= {n}" for k, n in enumerate(LEAST))
    names = " ".join(f"when {k} then '{n}'" for k, n in enumerate(KINDS))
    near = "y.s <= x.e + 300 and y.e >= x.s - 300 and not (y.s = x.s and y.k = x.k)"
    has = lambda kinds: f"exists (select 1 from parts y where y.rid = x.rid and y.k in {kinds} and {near})"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
raw as ({each}),
placed as (select rid, k, m, v, sum(length(g) + length(m)) over (partition by rid, k order by i) - length(m) as s,
                  sum(length(g) + length(m)) over (partition by rid, k order by i) as e from raw),
good as (select * from placed where (case k {least} end)
         and (k <> 4 or (regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[0-9]')))),
parts as (select * from good x where k < 3 or not exists (select 1 from good y where y.rid = x.rid and y.k < 3 and y.s <= x.s and y.e >= x.e)),
spans as (select *, (case k {names} end) || ':' || cast(s as bigint) || ':' || cast(e as bigint) as t from parts x
          where k < 3 or (k = 3 and {has('(0, 2, 4)')}) or (k = 4 and {has('(1, 3)')})
             or (k = 5 and {has('(1, 3)')} and {has('(0, 2, 4)')}))
select d.doc_id,
       count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
       sha256(coalesce(string_agg(t, ',' order by s, k) filter (where k < 3), '')) as base_sha256,
       coalesce(string_agg(t, ',' order by s, k), '') as spans
from d left join spans using (rid) group by d.rid, d.doc_id"""


SQL = _sql()
