"""HTML extraction: page structure first, host suffix arrays where it is silent.

A page that marks its article (``article``, ``main`` or the role ``main``) gives
the blocks inside it, without what structure tells apart: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments, by
element, role or class.  No text is removed there because other pages repeat it:
articles share sentences and licence lines, which have to stay.

Pages without such a mark give the other blocks of their body.  Of these, runs
repeated on more than ``share`` of the host's distinct pages are boilerplate.  They are found
as in a suffix array of the host's token streams: suffixes, cut at ``run``
tokens, are sorted by (host, fingerprint of the run) over all tasks, and equal
neighbours from enough pages of different text mark their tokens as covered.  A host
is never collected: a host with a third of all pages spreads over all tasks by
its fingerprints, and repeats are counted before the shuffle.  Covered
tokens go, a block's other tokens stay.  Pages of the same text count as one, so
a mirrored page keeps its text.  A page of which ``copied`` or more is covered is
a near copy of others, not their frame: it keeps all its text, its menus too.

Character references are decoded; white space inside a block becomes one space
(a line break is white space, and so are non-breaking and other Unicode blanks); blocks are trimmed, empty ones left out, and
joined by a newline.  Nulls: a null page is an empty one; a null address is a
host of its own.  Unclosed and stray tags are closed as browsers do, roughly.
Repeated rows each give a row.  An empty table gives an empty result.  Only
page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import table, written

#: Quotes hold a ">" only where a value begins; elsewhere they are like any sign.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>|<[!?/][^>]*>""", re.S)
#: A comment or tag that the page's end cuts off, or that end.
_CUT = re.compile(r"<!--|<[a-zA-Z/!?][^<>]*\Z|\Z")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label)(?=[\s=>/]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_SKIP = set("nav footer aside form button select option optgroup datalist fieldset dialog menu svg canvas video audio object applet map head figcaption-x".split())
_SKIP_ROLE = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status note tablist".split())
#: Anywhere in a class or id these tell what a part is.
_SKIP_WORD = set(
    """nav navbar navigation menubar breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement advertising adsense sponsored cookie cookies gdpr
    newsletter signup signin login comments commentlist disqus pagination pager toolbar masthead outbrain taboola""".split()
)
#: These do if nothing but places and kinds of parts stands beside them: "related
#: posts" is a part of the frame, "related work" one of the article.
_SKIP_NAME = set(
    """menu aside widget widgets adv banner promo promotion sponsor consent notice notices notification alert popup modal overlay subscribe subscription form search
    share sharing social related recommended recommendations comment respond reply replies feedback copyright disclaimer skip hidden teaser teasers crumbs""".split()
)
_PART = set(
    """area articles bar block blocks box boxes button buttons col column container content follow icons inner item items js left link links list main media message
    module outer page panel posts row section site slot stories text top bottom header right wrap wrapper the""".split()
)
_HEADER_NAME = {"header", "head", "topbar"}
_ABOUT = {"has", "no", "with", "without", "not", "free"}
_P_ENDS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"ul", "ol", "dl", "table", "article", "main", "div", "section", "body", "select", "blockquote", "td"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an element makes of its text: nothing, skip it, main text, header.
NEUTRAL, SKIPPED, MAIN, HEADER = range(4)


def _kind(name: str, attributes: str) -> int:
    if name in _SKIP:
        return SKIPPED
    own = MAIN if name in ("article", "main") else HEADER if name == "header" else NEUTRAL
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return own
    for key, value in _ATTR.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return SKIPPED
        if key == "role":
            if value in _SKIP_ROLE:
                return SKIPPED
            if value in ("main", "article"):
                own = MAIN
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for part in value.split():
                words = [w for w in re.split(r"[^a-z0-9]+", part) if w]
                # "has-sidebar", "ad-free" and the like say what a part has or lacks
                if _ABOUT & set(words) or name == "article" and part not in _SKIP_WORD | _SKIP_NAME:
                    continue
                rest = {w for w in words if not w.isdigit()} - _PART
                if _SKIP_WORD & set(words) or rest and rest <= _SKIP_NAME | _PART:
                    return SKIPPED
                if _HEADER_NAME & set(words) and not rest - _HEADER_NAME and own == NEUTRAL:
                    own = HEADER
    return own


def blocks_of(html: str) -> tuple[list[str], bool]:
    """The main text's blocks and whether the page marks its article."""
    main: list[str] = []
    rest: list[str] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []
    # of open elements: skipped ones, main ones, headers
    open_ = [0, 0, 0, 0]
    marked = False
    heading = 0
    # how many of each name are open, so that a stray end looks at no stack
    names: dict[str, int] = {}

    def flush():
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                (main if open_[MAIN] else rest).append(text)

    def pop():
        nonlocal heading
        name, kind = stack.pop()
        names[name] -= 1
        if name not in _INLINE:
            flush()
        open_[kind] -= 1
        heading -= name in _HEADINGS

    # no tag ends past the last ">", so none is looked for there
    at, end, last = 0, len(html), html.rfind(">") + 1
    while at < end:
        tag = _TAG.search(html, at, last)
        upto = tag.start() if tag else _CUT.search(html, at).start()
        if upto > at and not open_[SKIPPED] and (not open_[HEADER] or heading and open_[MAIN]):
            buffer.append(html[at:upto])
        if not tag:
            break
        at = tag.end()
        if at == last and tag[0].startswith("<!--") and not tag[0].endswith(("-->", "--!>")):
            break  # a comment without an end
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1], tag[3]
        if closing:
            if not names.get(name):
                if name == "p":
                    flush()
                continue
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
            if name in _INLINE:
                open_[stack[k][1]] -= 1
                names[name] -= 1
                del stack[k]
                continue
            while len(stack) > k:
                pop()
            continue
        if name in _RAW:
            stop = _RAW_END[name].search(html, at)
            at = stop.end() if stop else end
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            elif name == "br":
                buffer.append(" ")
            continue
        if name in _P_ENDS or name == "table":
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in _STOP), -1)
            if k >= 0 and stack[k][0] == "p":
                while len(stack) > k:
                    pop()
        if name in _CLOSES:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in _CLOSES[name] or stack[k][0] in _STOP - _CLOSES[name]), -1)
            if k >= 0 and stack[k][0] in _CLOSES[name]:
                while len(stack) > k:
                    pop()
        if name not in _INLINE:
            flush()
        kind = _kind(name, attributes)
        if attributes.endswith("/") and name in ("svg", "path"):
            continue
        stack.append((name, kind))
        names[name] = names.get(name, 0) + 1
        open_[kind] += 1
        heading += name in _HEADINGS
        marked |= kind == MAIN and not open_[SKIPPED]
    flush()
    return (main, True) if marked else (rest, False)


def _fingerprints(tokens: list[str], run: int) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest("\x1f".join(tokens[k : k + run])) - (1 << 63) for k in range(len(tokens) - run + 1)]


def extract(pages: DataFrame, run: int = 10, share: float = 0.5, copied: float = 0.8) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    kind = pages.schema["page_id"].dataType.simpleString()
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).select("page_id", "url", F.lower(host).alias("host"), "html")

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, marked = zip(*[blocks_of(b.column(3)[k].as_py()) for k in range(b.num_rows)], strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(blocks, pa.list_(pa.string())), pa.array(marked, pa.bool_())], ["page_id", "url", "host", "blocks", "marked"])

    read = written(rows.mapInArrow(streams, f"page_id {kind}, url string, host string, blocks array<string>, marked boolean"), "pages")
    told = read.where("marked").select("page_id", "url", F.array_join("blocks", "\n").alias("text"))

    # pages that don't mark their article
    open_pages = read.where("not marked").withColumn("content", F.xxhash64("blocks"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c, blocks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                marks = _fingerprints([t for x in blocks for t in x.split()], run)
                n = len(marks)
                # a page counts once for each of its runs
                met: set[int] = set()
                first = [int(m not in met and not met.add(m)) for m in marks]
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.string()), pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(marks, pa.int64()), pa.array(first, pa.int64())], ["host", "content", "at", "mark", "first"])

    once = open_pages.select("host", "content", "blocks").dropDuplicates(["host", "content"])
    suffix = once.mapInArrow(suffixes, "host string, content long, at long, mark long, first long")
    per_host = once.groupBy("host").agg(F.count("*").alias("pages"))
    ends = suffix.groupBy("host", "mark").agg(F.sum("first").alias("n")).where("n > 1")
    ends = ends.join(per_host, "host").where(F.col("n") > F.lit(share) * F.col("pages")).select("host", "mark")
    covered = suffix.join(ends, ["host", "mark"]).groupBy("host", "content").agg(F.collect_set("at").alias("starts"))

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for blocks, starts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                hit = {t for s in starts or () for t in range(s, s + run)}
                if hit and len(hit) >= copied * sum(len(x.split()) for x in blocks):
                    hit = set()
                at, kept = 0, []
                for x in blocks:
                    tokens = x.split()
                    left = [t for k, t in enumerate(tokens, at) if k not in hit]
                    at += len(tokens)
                    if left:
                        kept.append(" ".join(left))
                out.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    judged = open_pages.join(covered, ["host", "content"], "left").select("page_id", "url", "blocks", "starts")
    untold = judged.mapInArrow(unique, f"page_id {kind}, url string, text string")
    return told.union(untold).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
