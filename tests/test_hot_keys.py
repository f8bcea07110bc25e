"""Running values of keys that hold most of a table: brute force, and no task with a key's rows."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ordering, stores
from palimpsest.plans import inventory


@pytest.fixture(scope="module", autouse=True)
def small_ranges(spark):
    """Small tables in eight ranges; adaptive execution would make one of them."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="module")
def events(spark):
    """(k, o, id, v): key "hot" holds most rows, keys and values may be null, orders differ."""
    rng = random.Random(11)
    orders = rng.sample(range(100_000), 4000)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), o, i, rng.choice([None, None, None, i])) for i, o in enumerate(orders)]
    return rows, spark.createDataFrame(rows, "k string, o int, id int, v int").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_a_hot_key_lies_in_many_ranges(spark, events):
    _, df = events
    parts = ordering.dealt(df, ["k"], "o")
    assert parts.where("k = 'hot'").select("_range").distinct().count() >= 5
    assert parts.groupBy("_range").count().agg(F.max("count")).first()[0] < 1500
    earlier = ordering.with_earlier(parts, ["k"], F.count("*"), F.sum, "n")
    assert earlier.where("n is not null").select("_range", "k").distinct().groupBy("_range").count().agg(F.max("count")).first()[0] == 1


def test_values_carried_through_ranges(spark, events):
    rows, df = events
    want = {}
    for held in by_key(rows).values():
        last = None
        for _, _, i, v in held:
            last = v if v is not None else last
            want[i] = last
    assert {r.id: r.v for r in ordering.forward_fill(df, "v", ["k"], "o").collect()} == want
    assert ordering.forward_fill(df.limit(0), "v", ["k"], "o").count() == 0
    nulls = spark.createDataFrame([(1, None, 7), (1, 2, None), (1, 1, None)], "k int, o int, v int")
    assert [r.v for r in ordering.forward_fill(nulls, "v", ["k"], "o").collect()] == [7, 7, 7]


def test_places_and_remaining_steps(spark, events):
    rows, df = events
    up = {r[2]: place for held in by_key(rows).values() for place, r in enumerate(held, 1)}
    left = {r[2]: len(held) - place for held in by_key(rows).values() for place, r in enumerate(held)}
    assert {r.id: r.p for r in ordering.numbered(df, "o", "p", ["k"]).collect()} == up
    assert {r.id: r.p for r in ordering.numbered(df, [F.desc("o")], "p", ["k"]).collect()} == left
    assert {r.id: r.remaining for r in ordering.remaining_steps(df, "o", ["k"]).collect()} == left
    whole = {r[2]: place for place, r in enumerate(sorted(rows, key=lambda r: r[1]), 1)}
    assert {r.id: r.p for r in ordering.numbered(df, "o", "p").collect()} == whole


def test_ranks_of_versions(spark, events):
    rows, df = events
    said = df.select("k", "id", F.lpad(F.col("o").cast("string"), 6, "0").alias("version"), F.when(F.col("v").isNotNull(), "active").alias("status"))
    want = {}
    for held in by_key(rows).values():
        best = sorted(held, key=lambda r: (r[3] is None, -r[1]))
        want |= {r[2]: place for place, r in enumerate(best, 1)}
    assert {r.id: r["rank"] for r in inventory.ranked(said, "k", "version", "status").collect()} == want


@pytest.mark.parametrize("group", [["k"], []])
def test_budgets(spark, events, group):
    rows, df = events
    texts = df.withColumn("t", F.when(F.col("id") % 9 > 0, F.repeat(F.lit("x"), F.col("id") % 7)))
    text = lambda r: "x" * (r[2] % 7) if r[2] % 9 else ""
    for budget, least in ((5000, None), (3000, 2)):
        want = {}
        for held in by_key(rows).values() if group else [sorted(rows, key=lambda r: r[1])]:
            used = 0
            share = 10 if least is None else max(least, budget // len(held))
            for r in held:
                n = min(len(text(r)), share)
                if n and used < budget:
                    want[r[2]] = min(n, budget - used)
                used += n
        kept = ordering.char_budget(texts, "t", budget, ["o"], group) if least is None else ordering.shared_budget(texts, "t", budget, ["o"], group, least)
        assert {r.id: len(r.kept_text) for r in kept.collect()} == want
        assert set(kept.columns) == {*texts.columns, "kept_text"}


def test_rows_valid_as_of(spark, events):
    rows, df = events
    known, asked = df.where("id % 2 = 0").select("k", "o", "id"), df.where("id % 2 = 1").select("k", F.col("o").alias("at"))
    want = {}
    for k, held in by_key(rows).items():
        last = None
        for _, o, i, _ in held:
            if i % 2:
                want[k, o] = last
            else:
                last = i
    assert {(r.k, r["at"]): r.id for r in stores.valid_as_of(known, asked, "k", "at", "o").collect()} == want
