import re
from collections import Counter

import pytest

from palimpsest.llm import mixing, queries


def brute_targets(sizes, weights=(1, 2, 3), repeat=3):
    """Share out by weight, stop at the cap, share the excess anew, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > repeat * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: repeat * sizes[s] for s in over}
        open_ -= over
    return target


def check(rows, sources):
    sizes = Counter()
    for r in rows:
        sizes[sources[r.doc_id]] += r["size"]
    want = brute_targets(sizes)
    taken, most = Counter(), Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12, abs=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        assert not r["size"] or r.taken % r["size"] == 0
        taken[s] += r.taken
        most[s] = max(most[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s], s


def test_query(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = queries.op6_mix(spark, middle).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    assert {r.doc_id: r["size"] for r in rows} == size
    check(rows, {r.doc_id: r.source for r in docs})
    assert sorted(rows) == sorted(queries.op6_mix(spark, middle).collect())


def test_caps_nulls_and_code_points(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "Z", "é", None, "", "b"][i % 6] if i < 300 else "big") for i in range(2000)]
    rows += [(5000, None, "empty"), (5001, "x " * 4000, "one")]
    docs = spark.createDataFrame([(*r, 9, 1, 2) for r in rows], "doc_id long, text string, source string, taken int, draw int, whole int")
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "draw", "whole", "size", "source_size", "target", "copies", "taken"]
    check(mixing.mix(docs).collect(), {i: s for i, _, s in rows})
    out = mixing.emit(mixing.mix(docs), ["doc_id", "source"])
    named = docs.withColumnRenamed("draw", "_copy").withColumnRenamed("whole", "_mx_copy")
    assert mixing.emit(mixing.mix(named), named.columns).columns == ["doc_id", "text", "source", "taken", "_copy"]
    assert out.count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_repeated_rows_go_together(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "d", "t")], "doc_id long, text string, source string")
    assert len({r.copies for r in mixing.mix(docs).where("doc_id = 1").collect()}) == 1
