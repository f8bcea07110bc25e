import re

from palimpsest.llm import queries, urls

URLS = [
    None, "", "no scheme/x", "http://", "HTTP://WWW.Example.COM/de/x?y#z", "https://example.com/de/", "https://example.com/de",
    "http://a.b.net", "http://a.b.net/", "http://notnet/", "http://net/x", "http://example.net/en/1", "http://sub.example.net/en/", "http://x.org/fr/?casino",
    "http://x.org/en/casino", "http://essex.org/sextant", "http://x.com/?a://b/c", "http://x.com/cheap-win", "http://x.com/cheap/cheap", "http://casino.com", "http://ÉÜ.Com/Casino",
    "http://h#frag/x", "http://h?q/x", "a://b://c/d", "http://xcasino.com/pillsé",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in m[1])
        path = m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    words = re.split(r"[\W_]", (url or "").lower())
    bad = any(w in urls.STRICT for w in words) or len(set(words) & set(urls.SOFT)) >= urls.SOFT_LIMIT
    return host, path, None, "block" if bad else "allow"


def test_edges(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    rows = urls.judge(pages).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url
    assert urls.judge(pages.limit(0)).count() == 0


def test_query_matches_brute_force(spark, middle):
    got = {r.page_id: tuple(r[1:]) for r in queries.op9_urls(spark, middle).collect()}
    pages = spark.read.parquet(f"{middle}/pages.parquet").select("page_id", "url").collect()
    assert got == {i: brute(u) for i, u in pages}


def test_working_names_a_vocabulary_table_and_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://x.com/" + "free-" * 50000, 5, 6, 7), (2, "http://x.com/darn", 5, 6, 7), (3, "http://x.com/free/bonus", 5, 6, 7)], "page_id long, url string, _r int, _h int, _uf_host int")
    terms = spark.createDataFrame([("Darn", 2.0), ("free", 0.5), ("bonus", 0.5), ("old", 0.0), (None, 1.0)], "term string, weight double")
    strict, soft = urls.vocabulary(terms)
    assert (strict, soft) == (("darn",), ("bonus", "free"))
    got = urls.judge(pages, strict=strict, soft=soft)
    assert got.columns == ["page_id", "url", "_r", "_h", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r._r, r._h, r.verdict) for r in got.collect()} == {1: (5, 6, "allow"), 2: (5, 6, "block"), 3: (5, 6, "block")}


def test_query_by_a_table_of_terms(spark, middle, tmp_path):
    terms = spark.createDataFrame([("example", 1.5), ("org", 0.4), ("index", 0.4)], "term string, weight double")
    for name, rows in (("some", terms), ("none", terms.limit(0))):
        rows.write.parquet(str(tmp_path / name))
        spark.conf.set(queries.URL_TERMS, str(tmp_path / name))
        try:
            got = {r.page_id: r for r in queries.op9_urls(spark, middle).collect()}
        finally:
            spark.conf.unset(queries.URL_TERMS)
        for page in spark.read.parquet(f"{middle}/pages.parquet").select("page_id", "url").collect():
            words = set(re.split(r"[\W_]", (page.url or "").lower()))
            bad = name == "some" and ("example" in words or {"org", "index"} <= words)
            rule = brute(page.url)[2:]
            assert (got[page.page_id].rule, got[page.page_id].verdict) == (rule if rule[0] else (None, "block" if bad else "allow"))
