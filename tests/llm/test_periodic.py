"""Runs of words against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from palimpsest.llm import periodic, queries


def brute(w, shortest=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            smallest = not any(stretch[p:] == stretch[:-p] for p in range(1, q))
            if j > i and len(stretch) >= max(shortest, times * q) and smallest:
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out)


def some_words(rng, most=60):
    n, letters = rng.randrange(most), rng.randrange(1, 5)
    w = [b"%d" % rng.randrange(letters) for _ in range(n)]
    if n > 8 and rng.random() < 0.6:
        p, s = rng.randrange(1, 9), rng.randrange(n)
        for i in range(s, min(n, s + p * rng.randrange(2, 9))):
            w[i] = w[s + (i - s) % p]
    return w


@pytest.mark.parametrize("shortest, times", [(6, 4), (5, 2), (6, 3), (9, 5)])
def test_runs_are_those_of_brute_force(shortest, times):
    rng = random.Random(shortest * 10 + times)
    for _ in range(700):
        w = some_words(rng)
        got = [tuple(r) for r in periodic.find_runs(w, shortest, times).tolist()]
        assert got == brute(w, shortest, times), w


def test_trees_need_no_stretches():
    """The trees over whole texts find what they find in the stretches alone."""
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        w = some_words(rng)
        if w:
            whole = periodic.runs_in(np.unique(w, return_inverse=True)[1] + 1)
            assert whole.tolist() == periodic.find_runs(w).tolist()


def test_extensions_are_common_prefixes():
    import numpy as np

    rng = random.Random(5)
    for n in (1, 2, 3, 50, 200):
        w = [rng.randrange(1, 4) for _ in range(n)]
        tree = periodic.SuffixTree(w).prepare()
        pairs = np.array([(i, j) for i in range(n + 1) for j in range(n + 1) if i != j])
        same = lambda i, j: next((k for k in range(n - max(i, j)) if w[i + k] != w[j + k]), n - max(i, j))
        assert tree.extension(pairs[:, 0], pairs[:, 1]).tolist() == [same(i, j) for i, j in pairs.tolist()]
        assert [w[i:] for i in np.argsort(tree.ranks)] == sorted(w[i:] for i in range(n + 1))


def test_long_texts_take_time_in_proportion():
    rng = random.Random(1)
    round_ = [b"%d" % rng.randrange(5000) for _ in range(15_000)]
    assert periodic.find_runs(round_ * 5).tolist() == [[0, 75_000, 15_000]]
    assert periodic.find_runs([b"a"] * 60_000).tolist() == [[0, 60_000, 1]]


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    last = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *last, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "one", "ja ja ja ja ja ja", "a b " * 4, "æ ø " * 9, "x\x1cy " * 7, "  " * 8]
    texts += [rng.choice([" ", "\n", "  ", "\x0b"]).join(x.decode() for x in some_words(rng, 120)) for _ in range(400)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(5, texts[5], "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    assert got == sorted(expected(i, t) for i, t, _ in rows)
    assert sum(r[1] > 0 for r in got) > 50 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 20


def test_edges(spark):
    rows = [(None, "la " * 8, 1), (None, None, None), (1, "", 2), (1, "", 2), (2, "w " * 50_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int").withColumnRenamed("runs", "c0").withColumn("words", docs_col())
    found = periodic.detect(docs, carry=["doc_id", "c0"])
    got = {(r.doc_id, r.c0): ([tuple(x) for x in r.runs], r.collapsed) for r in found.collect()}
    assert got == {(None, 1): ([(0, 8, 1)], "la"), (None, None): ([], ""), (1, 2): ([], ""), (2, 3): ([(0, 50_000, 1)], "w")}
    assert found.count() == 5
    assert periodic.detect(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        periodic.detect(docs.withColumn("runs", docs_col()), carry=["doc_id", "runs"])
    with pytest.raises(ValueError):
        periodic.detect(docs, shortest=4)


def docs_col():
    from pyspark.sql import functions as F

    return F.lit("clash")
