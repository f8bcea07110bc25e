"""Lookups that expire, replay in state across restarts, and chunks put together again."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import chunks, lookups, stores


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    lookups.on_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def test_a_known_fact_expires(rocks, tmp_path):
    spark, schema, n = rocks, "key string, ord long, fact string", [0]

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={n[0]}"))
        n[0] += 1
        out = []
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/n=*"))
        query = lookups.answered(stream, seconds=12).writeStream.foreachBatch(lambda b, _: out.extend(b.collect()))
        # With processing time, more batches are always due, so "available now" never ends.
        query.option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).outputMode("append").start().awaitTermination(120)
        return sorted((r.key, r.ord, r.fact, r.hit, r.times) for r in out)

    assert batch([("a", 2, None), ("a", 1, "LBK 1"), ("b", 1, None)]) == [("a", 2, "LBK 1", True, 1), ("b", 1, None, False, 1)]
    started = time.time()
    got = batch([("a", 3, None)])  # after a restart
    assert got == [("a", 3, "LBK 1", True, 2)] or time.time() - started > 10
    time.sleep(13)
    assert batch([("a", 4, None)]) == [("a", 4, None, False, 1)]
    assert batch([("a", 5, "LBK 2"), ("a", 6, None)])[0][2:4] == ("LBK 2", True)


def test_replay_in_state_equals_the_batch(rocks, tmp_path):
    spark = rocks
    schema = "paragraph_id string, stk_number int, nr_number int, seq int, ord int, op_type string, old_text string, new_part string, count_ int, numbers array<int>, sentences array<string>"
    op = lambda p, seq, kind, old, new: (p, 1, None, seq, 0, kind, old, new, None, [], ["Alfa er her."])
    parts = [[op("1", 2, "replace_text", "Beta", "Gamma"), op("1", 1, "replace_text", "Alfa", "Beta"), op("2", 1, "replace_text", "Nej", "Ja")], [op("1", 3, "insert_sentence", "", "Mere.")]]
    out = []
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/n=*"))
        query = lookups.replayed(stream).writeStream.foreachBatch(lambda b, _: out.extend(b.collect()))
        query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start().awaitTermination(120)
    got = {(json.loads(r.unit)["paragraph_id"], r.seq): (r.status, r.text) for r in out}
    import pandas as pd

    for p in ("1", "2"):
        mine = [r for part in parts for r in part if r[0] == p]
        pdf = pd.DataFrame(mine, columns=[f.split()[0] for f in schema.split(", ")]).sort_values(["seq", "ord"])
        after, results = stores.fold_group(["Alfa er her."], pdf)
        assert [got[p, int(s)][0] for s in pdf["seq"]] == [status for status, _ in results]
        assert got[p, int(pdf["seq"].max())][1] == " ".join(after)


@pytest.mark.parametrize("width", [1, 2, 7, 60, 10_000])
def test_chunks_cut_anywhere(spark, width, monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK", 16)
    rng = random.Random(width)
    said = {None: "data: {\"a\": 0}", "empty": "", "x": "\n\n\n"}
    for k in range(6):
        said[f"s{k}"] = "".join(rng.choice(['data: {"a": %d}' % i, "data: {bad", ": note", "", "data: [DONE]", "data: ", 'data: {"a": %d}\r' % i]) + "\n" for i in range(30)) + ('data: {"a": 99}' if k % 2 else "")
    rows = [(s, i + 5, t[i * width : (i + 1) * width]) for s, t in said.items() for i in range(-(-len(t) // width))] + [("s0", -3, None), ("s1", 5, said["s1"][:width])]
    table = spark.createDataFrame(rows, "stream string, seq int, piece string").repartition(5)
    got = chunks.lines(table, "stream", "seq", "piece")
    want = sorted(((s, i, line.removesuffix("\r")) for s, t in said.items() for i, line in enumerate(t.split("\n")) if line.removesuffix("\r")), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    seen = sorted(((r.stream, r.line, r.event and r.event.a, r.corrupt) for r in chunks.events(got, "a int").collect()), key=str)
    expect = []
    for s, i, line in want:
        if line.startswith("data: ") and line[6:] not in ("", "[DONE]"):
            try:
                expect.append((s, i, json.loads(line[6:])["a"], None))
            except ValueError:
                expect.append((s, i, None, line[6:]))
    assert seen == sorted(expect, key=str)


def test_no_chunks(spark):
    empty = spark.createDataFrame([], "stream string, seq int, piece string")
    assert chunks.events(chunks.lines(empty, "stream", "seq", "piece"), "a int").select(F.count("*")).first()[0] == 0
