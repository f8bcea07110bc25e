"""Recorded entity scans: conditions, pushdown, broken pages, streams."""

import json

import pytest

from palimpsest.sources import odata

FIELDS = "id long, navn string, tal double, aktiv boolean, sag struct<id:long,titel:string>, filer array<struct<n:int>>"


@pytest.fixture()
def record(tmp_path):
    def page(name, entities):
        (tmp_path / name).write_text(json.dumps({"odata.metadata": "x", "value": entities}), encoding="utf-8")

    rows = [{"id": i, "navn": f"L {i}'s æ" if i % 2 else None, "tal": i / 4, "aktiv": i % 3 == 0, "sag": {"id": i, "titel": "t"}, "filer": [{"n": 1}, {"n": 2}], "andet": 1} for i in range(1, 31)]
    page("id=1..10.json", rows[:10])
    page("id=11..20.json", rows[10:20])
    page("id=21..30.json", rows[20:])
    (tmp_path / "id=31..40.json").write_text("<html>fejl</html>")
    page("plain.json", [{"id": 99, "tal": "not a number", "sag": [1]}, "odd"])
    (tmp_path / "_hidden").write_text("no page")
    return str(tmp_path)


def ids(df):
    return [r.id for r in df.collect()]


def test_asked_as_the_service_is(spark, record):
    ask = lambda **how: odata.query(spark, record, FIELDS, **how)
    assert ids(ask(filter="id ge 9 and id lt 12", orderby="id desc")) == [11, 10, 9]
    assert ids(ask(filter="navn eq 'L 7''s æ'")) == [7]
    assert sorted(ids(ask(filter="startswith(navn, 'L 2') and aktiv eq true"))) == [21, 27]
    assert sorted(ids(ask(filter="substringof('3''s', navn) and id ne 3"))) == [13, 23]
    assert ids(ask(filter="navn eq null and id gt 27", orderby="id")) == [28, 30, 99]
    assert ids(ask(orderby="aktiv desc, id", top=2)) == [3, 6]
    one = ask(filter="id eq 5", expand="sag").first()
    assert (one.tal, one.sag.titel, one.filer) == (1.25, "t", None)
    assert len(ask(filter="id eq 5", expand="sag, filer").first().filer) == 2
    odd = ask(filter="id eq 99", expand="sag").first()
    assert (odd.tal, odd.sag, odd.navn) == (None, None, None)
    with pytest.raises(ValueError):
        ask(filter="id eq 1 or id eq 2")


def test_pushed_filters_and_skipped_pages(spark, record):
    got = odata.query(spark, record, FIELDS, filter="id ge 12 and id le 14")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "id" in plan and "Filter" not in plan.split("BatchScan")[0].replace("Filter isnull(problem", "")
    reader = odata._Batch({"path": record}, got.schema)
    reader.filters = [odata.GreaterThanOrEqual(("id",), 12), odata.LessThanOrEqual(("id",), 14)]
    assert [p.path.rsplit("/", 1)[1] for p in reader.partitions()] == ["id=11..20.json", "plain.json"]
    reader.filters = [odata.In(("id",), (5, 25))]
    assert [p.path.rsplit("/", 1)[1] for p in reader.partitions()] == ["id=1..10.json", "id=21..30.json", "plain.json"]


def test_broken_pages_are_rows(spark, record):
    assert [r.problem for r in odata.problems(spark, record).collect()] == ["id=31..40.json: JSONDecodeError"]


def test_stream_reads_each_page_once(spark, record, tmp_path_factory):
    spark.dataSource.register(odata.ODataRecord)
    out, marks = (str(tmp_path_factory.mktemp(x)) for x in ("out", "marks"))
    stream = lambda: spark.readStream.format("odata").options(path=record, fields=FIELDS).load().select("id", "problem")
    run = lambda: stream().writeStream.format("parquet").option("checkpointLocation", marks).option("path", out).trigger(availableNow=True).start().awaitTermination(120)
    assert run()
    assert spark.read.parquet(out).where("problem is null").count() == 32
    with open(f"{record}/zz.json", "w") as f:
        f.write(json.dumps({"value": [{"id": 100}]}))
    assert run()
    got = spark.read.parquet(out)
    assert got.where("problem is null").count() == 33 and got.where("id = 100").count() == 1
