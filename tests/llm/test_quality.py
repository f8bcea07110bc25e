import re
from collections import Counter

from palimpsest.llm import quality, queries

NASTY = [None, "", " \n ", "a b c d", "one two three four five " * 5, "x\nx\n\ny\nx \n x", "# * $% &|<> é🙂", "a a a a a a a", "w " * 3000 + "end",
         "\n".join(f"line {i % 3} same words here now" for i in range(20)), "a\x0bb\x0cc\rd\te f\x1cg \xa0h"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(5)}
    symbols = sum(ch in quality.SYMBOLS for ch in text)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def test_query_matches_brute_force(spark, small):
    got = {r[0]: tuple(r[1:]) for r in queries.op8_quality(spark, small).collect()}
    for i, t in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        assert got[i][:6] == brute(t), i
        assert not (got[i][5] and got[i][6])


def test_edges(spark):
    docs = spark.createDataFrame([(i % 7, t, None if i % 2 else "s", 5) for i, t in enumerate(NASTY * 2)], "doc_id long, text string, source string, kept int")
    rows = quality.judge(docs).collect()
    assert len(rows) == 2 * len(NASTY)
    for r in rows:
        assert tuple(r[c] for c in (*quality.COUNTS, "base_failed")) == brute(r.text), r.text
    assert quality.judge(docs.limit(0)).count() == 0


def test_junk_domain_goes_clean_stay(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(i, clean + str(i), f"s{i % 10}") for i in range(400)] + [(1000 + i, "# | # | # |" + clean + " | #" * 40, "junk") for i in range(60)]
    rows += [(2000, clean, "junk"), (2001, "short", "tiny")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(400))
    assert not got[2000] and not got[2001] and not got[1000]


def test_working_names_and_long_texts(spark):
    rows = [(i, t, "s", 1, 2, 3) for i, t in enumerate(NASTY)] + [(50, "long words " * 60000 + "end", "s", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _w int, _domain int, _qr_w int")
    got = quality.judge(docs)
    assert "_w" in got.columns and "_domain" in got.columns and "_qr_w" not in got.columns
    for r in got.collect():
        assert r._w == 1 and r._domain == 2 and tuple(r[c] for c in (*quality.COUNTS, "base_failed")) == brute(r.text)
