import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.ordering import latest_wins
from palimpsest.sources import files, web
from palimpsest.streaming import stores as streams


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("En")}{p("")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def xlsx(rows):
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    cells = "".join(f'<row><c t="s"><v>0</v></c><c><v>{i}</v></c><c t="inlineStr"><is><t> </t></is></c></row>' for i in range(rows))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="Ark"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>navn</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_uploads(spark, tmp_path):
    for name, data in {"a.txt": "linje\r\n\r\n\r\n\r\nto".encode(), "b.docx": docx(), "c.xlsx": xlsx(401), "d.png": b"x", "e.exe": b"x", "f.md": b"\xff\xfe", "g.docx": b"no zip"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "linje\n\nto" and got["b.docx"].text == "En\na | b"
    assert got["c.xlsx"].text.startswith("# Ark\nnavn | 0\nnavn | 1") and got["c.xlsx"].text.endswith("navn | 399\n[...]")
    assert {n: got[n].problem for n in ("d.png", "e.exe", "f.md", "g.docx", "a.txt")} == {"d.png": "needs text recognition", "e.exe": "kind not supported", "f.md": "no readable text", "g.docx": "no readable text", "a.txt": None}
    assert {r.name for r in files.listing(spark, str(tmp_path), "*.docx", without="^g").collect()} == {"b.docx"}


def test_documents_and_json(spark, tmp_path):
    (tmp_path / "x/eli/lta/2025").mkdir(parents=True)
    (tmp_path / "x/eli/lta/2025/1500.xml").write_text("<Dokument></Dokument>")
    assert [r.eli for r in files.documents(spark, str(tmp_path / "x")).collect()] == ["eli/lta/2025/1500"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps([{"id": "1", "n": 2}, {"id": "2", "n": 3}]))
    (tmp_path / "j/b.json").write_text("{broken")
    store = files.json_store(spark, str(tmp_path / "j"), "id string, n int")
    assert sorted(map(tuple, store.collect())) == [("1", 2), ("2", 3)]
    files.write_csv(store.withColumn("xs", F.array(F.lit(1))), str(tmp_path / "c"))
    assert sorted(r.xs for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["[1]", "[1]"]
    files.write_json(store, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_retries():
    seen = []

    def get(url):
        seen.append(url)
        raise files.FetchError(url, [503, None, 404][len(seen) - 1], "x")

    waits = []
    with pytest.raises(files.FetchError):
        files.with_retries(get, "u", attempts=5, sleep=waits.append)
    assert len(seen) == 3 and waits == [1.5, 3.0]


def test_web(spark):
    one = spark.range(1)
    assert one.select(web.sitemap_urls(F.lit("<urlset><url><loc> https://a/?x=1&amp;y </loc></url><loc>b</loc></urlset>"))).first()[0] == ["https://a/?x=1&y", "b"]
    assert one.select(web.strip_html(F.lit("<p>A&nbsp;&amp; B</p><script>x<y</script>\n\n<b>C</b>"))).first()[0] == "A & B\nC"
    scripts = spark.createDataFrame([("fetch('/api/a'); get(\"/api/b\"); x('/api/a')",)], "t string")
    assert dict(web.script_paths(scripts, "t").collect()) == {"/api/a": 2, "/api/b": 1}


def test_upserts_by_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "k string, title string, v int, at int"
    for n, rows in enumerate(([("a", "t1", 1, 1), ("a", "t1b", 2, 2), ("b", "t2", 3, 1)], [("a", "t9", 9, 5), ("c", "t3", 4, 4)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"n={n}"))
        stream = spark.readStream.schema(schema).parquet(str(source / "n=*"))
        streams.start_upserts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "k", "at", ("title",)).awaitTermination(120)
    like = spark.createDataFrame([], schema)
    got = {r.k: (r.title, r.v) for r in streams.read_version(spark, str(tmp_path / "out"), 1, like).collect()}
    assert got == {"a": ("t1b", 9), "b": ("t2", 3), "c": ("t3", 4)}


def test_replay_by_stream_equals_the_batch(spark, tmp_path):
    schema = "paragraph_id string, stk_number int, nr_number int, seq int, ord int, op_type string, old_text string, new_part string, count_ int, numbers array<int>, sentences array<string>"
    op = lambda p, seq, kind, old, new: (p, 1, None, seq, 0, kind, old, new, None, [], ["Alfa er her."])
    first, second = [op("1", 2, "replace_text", "Beta", "Gamma"), op("1", 1, "replace_text", "Alfa", "Beta"), op("2", 1, "replace_text", "Nej", "Ja")], [op("1", 3, "insert_sentence", "", "Mere.")]
    out = []

    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/n=*"))
        query = streams.replay_stream(stream).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination(120)
    got = {(json.loads(r.unit)["paragraph_id"], r.seq): (r.status, r.text) for r in out}
    assert got[("1", 1)][0] == got[("1", 2)][0] == "applied" and got[("1", 3)] == ("applied", "Gamma er her. Mere.") and got[("2", 1)][0] == "failed"


def test_windows_by_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    batch = {tuple(r)[:3] for r in streams.windowed_counts(events, "ts", "event_type", "value").collect()}
    events.repartitionByRange(1, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = streams.windowed_counts(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r)[:3] for r in spark.table("w").collect()} == batch
    assert latest_wins(events, ["user_id"], "ts").count() == events.select("user_id").distinct().count()
