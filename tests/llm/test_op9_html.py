from seqloom.llm import op9_html as op
from seqloom.llm.common import table


def main(html):
    return op.blocks_of(html)[0]


def test_article_only():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div><div id="sidebar">Links</div>
    <article class="post ad-free"><header><h1>Title &amp; more</h1><span>by A</span></header><p>One  two\n three<br>four<p><b>Open &lt;b&gt;
    <div class="ad">Buy</div><form>Name <input></form><script>var a = "</p><p>no</p>";</script><ul><li>a<li>b</ul>
    <section class="comments"><article class="comment"><p>First!</p></article></section><!-- <p>gone</p> -->a < b</article>
    <footer>&copy; x</footer></body>"""
    assert main(html) == ["Title & more", "One two three four", "Open <b>", "a", "b", "a < b"]


def test_malformed_pages_do_not_crash():
    for html in ("", "<", "<p", "<a href='x>y<b>z", "</div></p>text", "<script>", "<!-- open", "<article><p>x<div class=\"y", "&#xZZ; &bogus; &#0;", "<" * 3000, "<p a=\"" * 500):
        op.blocks_of(html)
    assert main("<article>" + "<div>" * 3000 + "deep") == ["deep"]
    assert main("<article>a<!-->b<!-- c --!>d<a href=x\">e</a><p title=\"1>0\">f<!-- open <p>g") == ["abde", "f"]
    assert main("<article>one<p class='x>two<p>three <!-- a < b") == ["one", "two", "three"]


def test_malformed_pages_take_linear_work():
    import time

    n = 100_000
    for html in ("<p a=\"" * n, "<" * n, "<div>" * n + "</x>" * n, "<!--" * n, "<b>" * n + "</p>" * n, "<a b='" * n + ">", "<script>" * n, "a<b " * n, "&" * n):
        began = time.perf_counter()
        op.blocks_of(html)
        assert time.perf_counter() - began < 20


def test_given_pages_give_their_article(spark, sf_dir):
    import re
    from html import unescape

    pages = table(spark, sf_dir, "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in op.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in parts if x)
        assert r.text == want and r.n_chars == len(want)


def repeated(streams, run):
    """Covered token places by comparing all pages of a host pairwise."""
    out = []
    for a in streams:
        hit = set()
        for b in streams:
            if a != b:
                grams = {tuple(b[k : k + run]) for k in range(len(b) - run + 1)}
                for k in range(len(a) - run + 1):
                    if tuple(a[k : k + run]) in grams:
                        hit |= set(range(k, k + run))
        out.append(hit)
    return out


def test_host_repeats_go_where_structure_is_silent(spark):
    import random

    rng = random.Random(2)
    words = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], k=n))
    menu, foot = "start one two three four five six seven eight nine ten", "all rights kept by the people who made this site in full"
    rows = []
    for k in range(30):
        blocks = [menu, *(words(rng.randint(3, 30)) for _ in range(4)), foot]
        rows.append((k, f"http://h{k % 3}.example.com/{k}", "<body>" + "".join(f"<div>{b}</div>" for b in blocks), blocks))
    rows.append((99, rows[0][1], rows[0][2], rows[0][3]))  # a mirror takes nothing from its original
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    for host in range(3):
        mine = [r for r in rows if r[1].startswith(f"http://h{host}.")]
        covered = repeated([" ".join(r[3]).split() for r in mine], 10)
        for (i, _, _, blocks), hit in zip(mine, covered):
            at, kept = 0, []
            for b in blocks:
                n = len(b.split())
                if 2 * len(hit & set(range(at, at + n))) < n:
                    kept.append(b)
                at += n
            assert got[i] == "\n".join(kept) and menu not in got[i] and foot not in got[i]


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "http://a", "<p>x", 2), (2, "", "<article>y", 3), (3, "u", "", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in op.extract(df).collect())
    assert got == [(0, "x", 1), (1, "", 0), (1, "", 0), (2, "y", 1), (3, "", 0)]
    assert op.extract(df.limit(0)).count() == 0


def test_near_copies_keep_their_text_and_blocks_their_own_tokens(spark):
    menu, shared = "start one two three four five six seven eight nine ten", " ".join(f"passage{k}" for k in range(20))
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(30))
    article = " ".join(f"story{k}" for k in range(60))
    pages = {k: ("http://a.org", [f"{menu} here{k}", own(k)]) for k in range(6)}
    pages |= {k: ("http://a.org", [f"{menu} here{k}", f"{shared} said{k}", own(k)]) for k in (6, 7)}
    pages |= {k: ("http://b.org", [f"{article} date{k}"]) for k in (10, 11)}
    rows = [(k, f"{host}/{k}", "".join(f"<div>{b}</div>" for b in blocks)) for k, (host, blocks) in pages.items()]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (host, blocks) in pages.items():
        # a menu is cut out of its block; what two of eight pages quote stays
        assert got[k] == "\n".join([f"here{k}", *blocks[1:]] if host == "http://a.org" else blocks)


def test_class_names_count_as_a_whole():
    kept = ("social-science", "related-work", "discussion", "share-of-voters", "form-and-content-of-verse", "copyright-law", "comment-on-the-text")
    gone = ("social-links", "related_posts", "shareButtons share", "comment", "cookie-bar", "site-footer", "ad", "ad-slot-3", "post-comments", "promo box", "widget-2")
    html = "".join(f'<div class="{c}">{c}</div>' for c in (*kept, *gone))
    assert main(f"<article>{html}</article>") == list(kept)


def test_a_mark_in_a_script_or_comment_is_none(spark):
    menu = "start one two three four five six seven eight nine ten"
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(30))
    signs = ('<script>var t = "<main class=x>"</script>', "<!-- <article> -->", "<aside><article>teaser</article></aside>", "")
    rows = [(k, f"http://a.org/{k}", f"<body>{signs[k % 4]}<div>{menu}</div><div>{own(k)}</div>") for k in range(8)]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: own(k) for k in range(8)}
