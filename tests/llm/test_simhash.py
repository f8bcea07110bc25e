from collections import Counter

import numpy as np
import xxhash

from palimpsest.llm import queries, simhash


def brute_fp(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance):
    fps = {}
    for i, f in rows:
        fps.setdefault(f, []).append(i)
    values = list(fps)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(values, dtype=np.uint64)
    for x in range(len(a)):
        for y in np.nonzero(np.bitwise_count(a[x] ^ a[x + 1 :]) <= distance)[0]:
            p, q = find(x), find(x + 1 + int(y))
            root[p] = q
    least = {}
    for k, f in enumerate(values):
        ids = [i for i in fps[f] if i is not None]
        if ids:
            least[find(k)] = min([*ids, *([least[find(k)]] if find(k) in least else [])])
    return {f: least.get(find(k)) for k, f in enumerate(values)}


def test_query_matches_brute_force(spark, middle):
    got = queries.op2_simhash(spark, middle).collect()
    texts = dict(spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text").collect())
    fps = {i: brute_fp(t, 3) for i, t in list(texts.items())}
    want = brute_components(fps.items(), 2)
    assert len(got) == len(texts)
    for i, fp, component in got:
        assert fp == f"{fps[i]:016x}" and component == want[fps[i]]
    assert max(Counter(want.values()).values()) >= 1


def test_links_for_any_allocation(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [1 << int(b) for b in rng.integers(0, 64, 900)]
    values = {0, (1 << 64) - 1} | {int(base[i % 40]) ^ flips[i] ^ flips[(7 * i) % 900] * (i % 2) for i in range(900)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = set()
    arr = np.array(signed, dtype=np.int64).view(np.uint64)
    for i in range(len(arr)):
        for j in np.nonzero(np.bitwise_count(arr[i] ^ arr) <= 2)[0]:
            if signed[i] < signed[j]:
                want.add((signed[i], signed[j]))
    halves = [list(range(32)), list(range(32, 64))]
    thirds = [list(range(0, 64, 3)), list(range(1, 64, 3)), list(range(2, 64, 3))]
    for search in (None, [(halves[0], 1), (halves[1], 0)], [(g, 0) for g in thirds], [(thirds[0], 1), (thirds[1], 0)]):
        got = simhash.links(frame, 2, search=search).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_allocation_is_cheapest():
    assert simhash.allocate([[5.0, 90.0, 99.0], [1.0, 2.0, 3.0]], 1) == (3.0, [-1, 2])
    assert simhash.allocate([[100.0], [1.0], [1.0], [1.0]], -1) == (3.0, [-1, 0, 0, 0])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1300)] + [(1299, 4), (7, 7)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 4 for i in [4, 5, *range(1000, 1300)])
    assert 7 not in got
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    rows = [(None, None), (3, ""), (2, " \n"), (9, "Two Words"), (8, "two  words"), (None, "A b c d e"), (1, "a B c d E " * 2000), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.groups(docs, shingle=3).collect()
    assert len(got) == len(rows)
    by_text = {}
    want = brute_components([(i, brute_fp(t, 3)) for i, t in rows], 2)
    for r in got:
        assert r.component_id == want[r.fp % (1 << 64)], by_text
    assert simhash.groups(docs.limit(0)).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, 8)], "doc_id int, text string, _text int, fp int")
    got = simhash.with_fingerprints(docs)
    assert got.columns == ["doc_id", "text", "_text", "fp"] and got.first()._text == 7
    assert got.first().fp == simhash.with_fingerprints(docs.select("doc_id", "text")).first().fp
