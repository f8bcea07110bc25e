import html as entities
import random
import re
import time

import numpy as np

from palimpsest.llm import html, queries


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body class="has-sidebar">
    <header><p>Top</p></header><nav><ul><li>Menu</ul></nav><!-- <p>x</p> --><div class="ad">Buy</div>
    <article class="post"><header><h1>Title &amp; more</h1></header><p>One&nbsp;two\n three<br>four <b>bold</b>ly
    <p>Next &lt;tag&gt; <script>no()</script>&eacute;&#233;<div class="newsletter notice">Sign up</div><form><p>f</p></form>
    <ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table><aside>no</aside><footer>by</footer><section id="comments"><article class="comment"><p>I say</p></article></section>
    <p hidden>no</p><p style="display: none">no</p>last</article><div>outside</div><footer>&copy;</footer></body></html>"""
    assert html.blocks_of(page) == ["article", "Title & more", "One two three four boldly", "Next <tag> éé", "a", "b", "c", "d", "last"]
    assert html.blocks_of(None) == ["page"] and html.blocks_of("") == ["page"]
    assert html.blocks_of("just <i>text</i> 1 < 2 &") == ["page", "just text 1 < 2 &"]
    assert html.blocks_of("<main><p>m</main><p>x") == ["article", "m"]


def test_runs_match_brute_force():
    rng = random.Random(3)
    pages = [[" ".join(str(rng.randrange(2)) for _ in range(rng.randrange(1, 15))) for _ in range(3)] for _ in range(12)]
    streams = html.Streams(pages, 5)
    flat = [" ".join(p).split(" ") for p in pages]
    where = {}
    for k, p in enumerate(flat):
        for i in range(len(p) - 4):
            where.setdefault(tuple(p[i : i + 5]), set()).add(k)
    runs, counts = streams.runs(3)
    assert sorted(counts.tolist()) == sorted(len(v) for v in where.values() if len(v) >= 3)
    assert (streams.counts(runs) == counts).all() and streams.counts(np.array([12345])).tolist() == [0]
    want = []
    for p in flat:
        gone = [False] * len(p)
        for i in range(len(p) - 4):
            if len(where[tuple(p[i : i + 5])]) >= 3:
                gone[i : i + 5] = [True] * 5
        want += [*gone, False]
    assert streams.covered(runs).tolist() == want and any(want)


def brute_host(pages):
    """Cleaned texts of one host's pages (blocks each), by plain counting."""
    distinct = {tuple(p) for p in pages}
    where = {}
    for p in distinct:
        words = " ".join(p).split(" ")
        for i in range(len(words) - html.RUN + 1):
            where.setdefault(tuple(words[i : i + html.RUN]), set()).add(p)
    least = max(html.RUN_PAGES, -(-len(distinct) * html.RUN_SHARE // 1))
    out = []
    for p in pages:
        words = " ".join(p).split(" ")
        gone = [False] * len(words)
        for i in range(len(words) - html.RUN + 1):
            if len(where[tuple(words[i : i + html.RUN])]) >= least:
                gone[i : i + html.RUN] = [True] * html.RUN
        at, left = 0, []
        for b in p:
            n = b.count(" ") + 1
            if sum(gone[at : at + n]) < html.BLOCK_SHARE * n:
                left.append(b)
            at += n
        lost = len(words) - sum(b.count(" ") + 1 for b in left)
        out.append("\n".join(p if lost >= html.PAGE_SHARE * len(words) else left))
    return out


def test_hosts_without_articles_match_brute_force(spark):
    """The whole query on pages without article markup: menus in plain divs, quotations, copies; buckets of any size."""
    rng = random.Random(8)
    words = lambda s, n: " ".join(f"{s}{rng.randrange(10**6)}" for _ in range(n))
    rows, quote = [], words("q", 20)
    for h in range(4):
        menu, licence = [words(f"m{h}", 2) for _ in range(8)], words(f"l{h}", 15)
        for k in range(40):
            body = [words("t", 30) for _ in range(3)]
            if k % 3 == 0:
                body[1] = f"{words('t', 40)} {quote} {words('t', 40)}"
            rows.append((f"http://h{h}/x{k}", [*menu, *body, *[licence] * (k % 2)]))
        rows += [rows[-1]] * 50
    html_of = lambda blocks: "<body>" + "".join(f"<div>{b}</div>" for b in blocks)
    df = spark.createDataFrame([(i, u, html_of(b), "x") for i, (u, b) in enumerate(rows)], "page_id long, url string, html string, host string")
    want = {}
    for h in range(4):
        mine = [i for i, (u, _) in enumerate(rows) if u.startswith(f"http://h{h}/")]
        want |= dict(zip(mine, brute_host([rows[i][1] for i in mine]), strict=True))
    assert all("m0" not in t and quote in want[0] for t in want.values())
    for bucket in (200, 7):
        got = {r.page_id: r.text for r in html.extract(df, bucket_pages=bucket).collect()}
        assert got == want, bucket


def test_near_copies_and_articles_stay():
    words = lambda s: " ".join(f"{s}{i}" for i in range(30))
    pages = [[words("same"), words("more"), f"date{k}"] for k in range(5)]
    streams = html.Streams(pages)
    assert streams.kept(pages, streams.runs(3)[0]) == ["\n".join(p) for p in pages]


def test_reading_is_linear():
    for text in ('<a "', "<div>", "<p></b>", "<div class=ad><article></article>", "<script>", '<a b="', "<!--", "<a ", "&#", "< ", "</b", "<a class = '"):
        took = []
        for n in (1 << 14, 1 << 17):
            started = time.process_time()
            html.blocks_of("<div>" * (n // 8) + text * (n // len(text)) + "</i>" * (n // 8))
            took.append(time.process_time() - started)
        assert took[1] < 40 * max(took[0], 0.01), (text, took)


def article_of(page):
    """The generated pages' article, read by another way."""
    body = re.search(r"(?s)<article>(.*)</article>", page)[1]
    parts = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"(?i)</?(?:p|h1)>", body)]
    return "\n".join(t for t in (" ".join(entities.unescape(x).split()) for x in parts) if t)


def test_query_on_generated_pages(spark, middle):
    got = {r.page_id: r for r in queries.op5_html(spark, middle).collect()}
    pages = spark.read.parquet(f"{middle}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article_of(p.html), p.page_id
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_edges(spark):
    rows = [(1, None, None), (2, "http://a/x", ""), (2, "http://a/x", ""), (None, "nohost", "<p>x"), (4, None, "<article>" + "<p>w x y" * 20000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract(df, bucket_chars=100).collect()
    assert sorted((r.text[:5], len(r.text)) for r in got) == [("", 0), ("", 0), ("", 0), ("w x y", 20000 * 6 - 1), ("x", 1)]
    assert html.extract(df.limit(0)).count() == 0


def test_no_article_vanishes_by_what_encloses_it():
    article = "<article><p>Whole text</p></article>"
    for before, after in (
        ('<div class="page has-sidebar">', "</div>"),
        ('<div class="social-science">', "</div>"),
        ('<div class="page sidebar">', "</div>"),
        ('<main><p>Top</p><div class="page sidebar">', "</div></main>"),
        ('<form id="aspnetForm"><div>Menu</div>', "</form>"),
        ("<aside>", "</aside>"),
        ('<svg width="1"/><iframe src="x" /><object data="y"/>', "<svg><path/></svg>"),
    ):
        assert html.blocks_of(f"<body>{before}{article}{after}</body>") == ["article", "Whole text"], before
    assert html.blocks_of("<form><main><p>m</main></form>") == ["article", "m"]
    assert html.blocks_of(f"{article}<aside><article>Teaser</article></aside>") == ["article", "Whole text"]
    assert html.blocks_of("<main><p>m</p><aside><article>Teaser</article></aside></main>") == ["article", "m"]
    assert html.blocks_of('<div class="no-sidebar"><p>x</p></div><div class="sidebar">y</div>') == ["page", "x"]


def test_frame_inside_articles_goes_and_repeated_text_stays(spark):
    """Pages with an article go through the suffix arrays: what a host's frames repeat is cut where its articles hold it too."""
    rng = random.Random(11)
    words = lambda s, n: " ".join(f"{s}{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], []
    for h in range(3):
        notice, licence = words(f"n{h}", 20), words(f"l{h}", 20)
        titles = [words("title", 9) for _ in range(40)]
        for k in range(40):
            body = [titles[k], words("t", 40), f"{words('t', 60)} {notice}", licence]
            inside = [*body[:2], notice, *body[2:]] if k % 2 else body
            html_ = f"<nav>{titles[0]}</nav><article>" + "".join(f"<p>{b}</p>" for b in inside) + f"</article><footer>{notice if k % 3 else licence[:30]}</footer>"
            rows.append((f"http://h{h}/x{k}", html_))
            want.append("\n".join(body))
        for k in range(2):  # a frame inside too few articles is text
            rows.append((f"http://few{h}/x{k}", f"<article><p>{notice}</p><p>{words('t', 40)}</p></article><footer>{notice}</footer>"))
            want.append(html.blocks_of(rows[-1][1])[1] + "\n" + html.blocks_of(rows[-1][1])[2])
    rows += [rows[1]] * 30
    want += [want[1]] * 30
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    for bucket in (200, 7):
        got = {r.page_id: r.text for r in html.extract(df, bucket_pages=bucket).collect()}
        assert got == dict(enumerate(want)), bucket
