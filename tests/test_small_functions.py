"""Functions that no query names: cleaning, numbers, surveys, logs, files, recorded answers over HTTP."""

import http.server
import io
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import numbers, refs, text
from palimpsest.plans import history, inventory, logs, rules, survey
from palimpsest.sources import files
from palimpsest.streaming import stores


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_lines(spark):
    assert one(spark, text.unwrap_lines("t"), t="ord-\ndeling og\nmere.\nNy,\nfortsat\n1) nej") == "orddeling og mere.\nNy, fortsat\n1) nej"
    assert one(spark, text.drop_lines("t", "^Licens"), t="a\nLicens: x\nb\n") == "a\nb\n"
    assert one(spark, text.from_marker("t", "--"), t="a--b--c") == "b--c" and one(spark, text.from_marker("t", "--"), t="abc") == "abc"
    assert one(spark, text.windows_around("t", ".x", 2, 2), t="ab.xcd..xef.x") == ["ab.xcd", "..xef"]
    assert one(spark, text.truncate("t", 3, "…"), t="abcd") == "abc…" and one(spark, text.truncate("t", 4), t="abcd") == "abcd"
    assert one(spark, text.safe_filename("t"), t="Æ b/c.pdf") == "__b_c.pdf"


def test_numbers(spark):
    assert [one(spark, numbers.leading_int("t"), t=t) for t in (" 12 x", "-3", "x1", "")] == [12, -3, None, None]
    assert [one(spark, numbers.input_quality(F.col("n")), n=n) for n in (0, 2, 3)] == ["høj", "middel", "lav"]
    assert one(spark, rules.missing_facts({"a": "A", "b": "B", "c": "C"}), a="x", b=" ", c=0) == ["B"]


def test_law_citations(spark):
    got = one(spark, refs.law_citations(F.col("t")), t=["se Ligningslovens § 9, og ligningsloven §9C", "PBL § 2, LIGNINGSLOVENS § 9, SKM 2019 123 HR"])
    assert got == ["Ligningslovens § 9", "ligningsloven §9C", "PBL § 2", "SKM 2019 123 HR"]


def test_candidate_articles(spark):
    got = one(spark, rules.candidate_articles("t"), t="Artikel 15, stk. 2 og art. 4; 7 stk 1, ARTIKEL  15, stk. 2")
    assert got == ["artikel 15, stk. 2", "art. 4", "15, stk. 2", "7 stk 1"]
    assert one(spark, rules.candidate_articles(F.col("t").cast("string")), t=1) == []


def test_surveys(spark):
    units = spark.createDataFrame([("Et. To.", ["Et. To."], ["Et.", "To."]), ("3. pkt. gælder.", ["3. pkt. gælder."], ["3. pkt. gælder."]), ("", [], [])], "text string, lineas array<string>, sentences array<string>")
    assert history.segmentation(units).first().asDict() == {"blocks": 2, "sentences": 3, "several": 1, "checkable": 1, "conflicts": 1}
    metadata = spark.createDataFrame([(["a", "b"], None)], "changes array<string>, cites array<string>")
    assert survey.relation_counts(metadata, ("changes", "cites")).first()[2:] == (2, 0)
    rows = spark.createDataFrame([("k", "2020"), ("k", "2021"), ("k", None)], "k string, v string")
    assert {r.v: r.place for r in inventory.by_valid_from(rows, ["k"], "v").collect()} == {"2021": 1, "2020": 2, None: 3}
    listed = spark.createDataFrame([("i", "protocol", "", "p"), ("i", "article", "x", "a"), ("i", "article", "7", "b"), ("i", "other", "", "o")], "i string, kind string, number string, label string")
    assert inventory.shelved(listed, ["i"], "kind", "number", "label").first().label == "b"


def test_logs(spark):
    assert [one(spark, logs.log_kind("t"), t=t) for t in (" TEST ", "chat", "../x")] == ["test_chat", "chat", "chat"]
    entry = spark.createDataFrame([("q", None, [("f1", None), (None, None)], None, None)], "question string, answer string, citations array<struct<file_id:string,filename:string>>, results array<struct<filename:string,text:string>>, none string")
    said = entry.select(logs.log_text("none", "none", "stores", "question", "answer", "citations", "results").alias("x")) if "stores" in entry.columns else entry.withColumn("stores", F.lit(None).cast("array<string>")).select(logs.log_text("none", "none", "stores", "question", "answer", "citations", "results").alias("x"))
    assert said.first().x.split("\n") == [logs.LOG_TITLE, "Tidspunkt: ", "Model brugt: ", "Vector stores: ", "", logs.ASKED, "q", "", logs.SAID, logs.EMPTY_ANSWER, "", logs.CITED, "  1. f1", "  2. ?", "", logs.FOUND]


def test_sheets_by_the_workbooks_relations():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda v: f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Først" r:id="b"/><sheet name="Så" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/odd.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("to"))
        z.writestr("xl/worksheets/odd.xml", sheet("et"))
    assert files.xlsx_text(out.getvalue()) == "# Først\net\n# Så\nto"


def test_pdf_problems_are_told():
    pages, problem = files.pdf_read(b"no pdf")
    assert pages == [] and problem and files.pdf_pages(b"no pdf") == []


def test_http_documents(spark):
    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if self.path == "/a" else 404)
            self.end_headers()
            self.wfile.write(b"body" if self.path == "/a" else b"")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        spark.dataSource.register(files.HttpDocuments)
        got = {r.url: (r.body and bytes(r.body), r.problem) for r in spark.read.format("http_documents").option("urls", f"{base}/a\n{base}/b").option("attempts", 1).load().collect()}
    finally:
        server.shutdown()
    assert got[f"{base}/a"] == (b"body", None) and got[f"{base}/b"][0] is None and "404" in got[f"{base}/b"][1]


def test_buckets_are_kept_with_their_table(spark, tmp_path):
    stores._same_buckets(spark, str(tmp_path / "t"), 64)
    stores._same_buckets(spark, str(tmp_path / "t"), 64)
    with pytest.raises(ValueError, match="64 buckets"):
        stores._same_buckets(spark, str(tmp_path / "t"), 8)
