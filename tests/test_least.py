"""Least rows of groups, names by needles, and long texts in shared runs."""

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from palimpsest.operators import matching, ordering


def test_least_rows_of_each_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, o int, id int").repartition(7)
    want, groups = set(), defaultdict(list)
    for g, h, o, i in rows:
        groups[g, h].append((o is None, o or 0, i))
    for key, held in groups.items():
        want |= {(*key, None if none else o, i, place, len(held)) for place, (none, o, i) in enumerate(sorted(held)[:5], 1)}
    assert {tuple(r) for r in ordering.least_rows(df, ["g", "h"], ["o", "id"], 5).collect()} == want
    assert ordering.least_rows(df.limit(0), ["g"], ["o"], 2).count() == 0
    assert [(r.id, r.place, r.rows) for r in ordering.least_rows(df, [], ["id"], 2).orderBy("place").collect()] == [(0, 1, 3000), (1, 2, 3000)]


def test_least_rows_of_a_hot_key_and_of_many(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MOST_HELD", 500)  # in the driver: what a task is sent holds the name's value
    df = spark.range(200_000).select(F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("g"), (-F.col("id")).alias("o"))
    got = ordering.least_rows(df, ["g"], ["o"], 3)
    hot = got.where("g = 'hot'").orderBy("place").collect()
    assert [r.o for r in hot] == [-199998, -199997, -199996] and hot[0].rows == 180_000
    assert got.count() == 3 + 20_000


def test_least_rows_of_tasks_that_get_many_batches(spark):
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "100")
    try:
        df = spark.range(5000).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("o"))  # no column holds nulls
        got = sorted(tuple(r) for r in ordering.least_rows(df, ["g"], ["o"], 2).collect())
    finally:
        spark.conf.set(key, before)
    want = [(g, -i, place, len(range(g, 5000, 3))) for g in range(3) for place, i in enumerate(sorted(range(g, 5000, 3))[: -3 : -1], 1)]
    assert got == sorted(want)


def test_names_that_hold_needles(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab cøA") for _ in range(rng.randrange(n)))
    names = [(some(12),) for _ in range(60)] + [(None,), ("x" * 10_000 + "Needle",)]
    needles = [(i, some(6), None if i % 3 else "x" * 9_000 + "needle"[: i % 8]) for i in range(100)] + [(None, "a", None), (7, "zzz", "y" * 10_000)]
    rows = spark.createDataFrame(needles, "id int, a string, b string")
    got = matching.contains_join(rows, spark.createDataFrame(names, "name string"), "id", ["a", "b"], "name")
    want: dict = {}
    for i, a, b in needles:
        for (n,) in names:
            if n is not None and any(x and x.lower() in n.lower() for x in (a, b)):
                want[i] = min(want.get(i, n), n)
    assert dict(got.collect()) == want and len(want) > 50
    assert matching.contains_join(rows.where("false"), spark.createDataFrame(names, "name string"), "id", ["a"], "name").count() == 0


def test_shared_runs_of_a_long_text(spark):
    words = [f"w{i}" for i in range(50_000)]
    left = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20] * 3))], "l int, text string")
    right = spark.createDataFrame([(9, " ".join(words[5:20]))], "r int, text string")
    started = time.time()
    got = {(r.l, r.r): r.shared for r in matching.shared_runs(left, right, "l", "r").collect()}
    assert got == {(1, 9): 8, (2, 9): 8} and time.time() - started < 20


def test_best_match_is_brute_force(spark):
    import difflib

    rng = random.Random(11)

    def changed(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = rng.choice(["", "a", "øb", "ab"])
        return "".join(t)

    base = ["".join(rng.choice("abcdø") for _ in range(rng.randrange(1, 60))) for _ in range(12)] + ["", "ababab" * 8, "a" * 30]
    wanted = [(i, i % 2, changed(b, rng.randrange(6))) for i, b in enumerate(base * 3)]
    proposed = [(i, i % 2, changed(b, rng.randrange(6))) for i, b in enumerate(base * 3)]
    w, p = spark.createDataFrame(wanted, "w int, block int, text string"), spark.createDataFrame(proposed, "p int, block int, text string")
    for least in (0.5, 0.75, 0.9):
        want = {}
        for i, x, a in wanted:
            scored = [(-difflib.SequenceMatcher(None, b, a, autojunk=False).ratio(), j) for j, y, b in proposed if x == y]
            ratio, j = min(scored)
            if -ratio >= least:
                want[i] = (j, -ratio)
        got = {r.w: (r.p, r.ratio) for r in matching.best_match(w, p, ["block"], wanted_id="w", proposed_id="p", least=least).collect()}
        assert got == want and len(got) > 5
