"""Rounds with bounds against rounds over all distances in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from palimpsest.llm import codes, queries


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (id, label, vector). As the contract says, by plain loops."""
    kept = []
    for key, label, vector in rows:
        if vector and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, label, [max(-codes.LIMIT, min(codes.LIMIT, math.floor(1024 * x))) for x in vector]))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [[]] * parts, []
    wide = len(kept[0][2]) // parts
    kept = [r for r in kept if len(r[2]) == wide * parts]
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    for left in range(rounds, -1, -1):
        found = [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, _, v in kept]
        if left:
            new = [[list(e) for e in book] for book in books]
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [cut(v, p) for (_, _, v), f in zip(kept, found, strict=True) if f[p] == e]
                    if mine:
                        new[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
            books = new
    out = []
    for (key, label, v), f in zip(kept, found, strict=True):
        out.append((key, label, "".join(f"{e:02x}" for e in f), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(f))))
    return books, out


def same(spark, rows, **how):
    books, want = brute(rows, **{k: v for k, v in how.items() if k != "bounds"})
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(3)
    got_books, coded = codes.fit(table, **how)
    assert got_books.tolist() == books
    order = lambda r: (r[0] is None, r[0] or 0, str(r))
    got = [(r.id, r.label, bytes(r.code).hex(), r.error) for r in coded.collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    got = codes.compress(table, **how).collect()
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert sorted(r.label_error for r in got) == sorted(sums[label] for _, label, _, _ in want)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} <= {digest}


def vectors(rng, n, wide=8, spread=1.0):
    centres = [[rng.gauss(0, 1) for _ in range(wide)] for _ in range(7)]
    return [(i, rng.choice([None, 1, 2]), [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


def test_clusters_and_ties(spark):
    rng = random.Random(1)
    rows = vectors(rng, 400, spread=0.1)
    rows += [(1000 + i, 3, [rng.choice([0.0, 1 / 1024, -1 / 1024]) for _ in range(8)]) for i in range(200)]  # many equal distances
    same(spark, rows, entries=32, bounds=6)


def test_any_number_of_bounds(spark):
    rows = vectors(random.Random(2), 150, spread=0.5)
    for bounds in (2, 3, 64):
        same(spark, rows, entries=20, bounds=bounds, rounds=3)


def test_defined_results(spark):
    rng = random.Random(3)
    rows = vectors(rng, 40)
    rows += [(None, 1, rows[0][2]), (3, None, rows[3][2]), (3, None, rows[3][2]), (None, None, rows[5][2]), (-7, 9, [1e300] * 8), (50, 9, [-1e9] * 8)]
    rows += [(60, 1, None), (61, 1, []), (62, 1, [None] * 8), (63, 1, [math.nan] * 8), (64, 1, [math.inf] + [0.0] * 7), (65, 1, [1.0] * 4), (66, 1, [1.0] * 12)]
    same(spark, rows, entries=16, bounds=4)
    same(spark, rows[:5])  # fewer vectors than entries
    same(spark, [])
    same(spark, [(1, 1, None)])
    extra = spark.createDataFrame([(1, 2, [0.5] * 4, "x", 3)], "vec_id int, label int, embedding array<float>, code string, near int")
    assert [tuple(r)[:4] for r in codes.compress(extra).collect()] == [(1, "00000000", 0, 0)]


def test_bounds_are_bounds():
    rng = np.random.default_rng(5)
    before = rng.integers(-50, 50, (24, 3))
    x = rng.integers(-60, 60, (300, 3))
    near, low = codes._Part(before, None).afresh(x, 6)
    book = before + rng.integers(-4, 5, before.shape)
    near, low, need = codes._Part(book, before).step(x, near, low)
    far = np.sqrt(codes.squared(x, book))
    assert (near[:, 0] == far.argmin(axis=1)).all() and need.min() == 0 < need.max()
    for r in range(len(x)):
        assert all(far[r, near[r, z + 1]] >= low[r, z] for z in range(5))
        assert all(far[r, e] >= low[r, 5] for e in set(range(24)) - set(near[r].tolist()))


def test_query_over_more_vectors_than_entries(spark, middle):
    assert queries.op12_codes(spark, middle).count() == spark.read.parquet(f"{middle}/embeddings.parquet").count()


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        codes.fit(spark.createDataFrame([], "vec_id int, label int, embedding array<float>"), entries=300)
