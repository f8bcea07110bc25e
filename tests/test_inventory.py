"""Catalogs of files: what names say, and the forms of identifiers."""

from pyspark.sql import functions as F

from palimpsest.operators import graph, matching, ordering
from palimpsest.plans import inventory, retrieval, rules


def test_names_and_folders(spark):
    rows = [
        ("Danmark/Tyskland", "Artikel 7 (Erhverv) .pdf", "", "dk-de", "artikel 7", "Erhverv", "dk-de_dbo_art07_v2"),
        ("x", "dbo 19961231 protokol.pdf", "Færøerne Feroeerne", "fo", "protokol", "", "fo_dbo_protokol_v1996"),
        ("Nordiske lande", "Noter 2005.pdf", "artikel 3", "norden", "artikel 3", "", "norden_dbo_noter_2005_v2005"),
        ("Sverige Norge Danmark", "Noter.pdf", None, "dk-no-se", "", "", "dk-no-se_dbo_noter_v2"),
        ("x", "Noter.pdf", None, "dk", "", "", "dk_dbo_noter_v2"),
    ]
    files = spark.createDataFrame([r[:3] for r in rows], "folder string, name string, head string")
    got = {(r.folder, r.name): r for r in inventory.file_rows(files, title="Overenskomst", default_version="v2").collect()}
    for folder, name, _, code, label, suffix, source in rows:
        r = got[folder, name]
        assert (r.jurisdiction, r.section.label, r.section_title, r.source_id) == (code, label, suffix, source)
    assert got["Danmark/Tyskland", rows[0][1]].aliases == ["dbo", "dobbeltbeskatningsoverenskomst", "overenskomst", "dk-de", "danmark de", "dbo de", "artikel 7", "art 7"]


def test_identifiers_and_registry(spark):
    df = spark.createDataFrame([(" abcd_123 ",), ("short",), (None,), ("dk-de_x",), ("DK_DBO_art01_v1",)], "v string")
    got = df.select(inventory.valid_id("v").alias("s"), inventory.namespace_of("v").alias("n")).collect()
    assert [(r.s, r.n) for r in got] == [("abcd_123", None), (None, None), (None, None), (None, None), ("DK_DBO_art01_v1", "dk")]
    assert inventory.labels_with(spark.createDataFrame([("Ligningsloven",), ("Andet",)], "label string"), "label", "LIGNING").count() == 1
    pages = spark.createDataFrame([(1, 2, "c"), (1, 1, "b"), (1, 0, "a")], "d int, p int, t string")
    assert inventory.first_pages(pages, "d", "p", "t").collect()[0].head == "a\nb"


def test_walk_beyond_the_limit_of_recursive_queries(spark):
    n = 700_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst"))
    got = graph.walk(edges, spark.range(n).select("id"))
    assert got.count() == 2 * n and got.where("depth = 1 and node = start + 700000").count() == n


def test_contains_join_finds_any_stretch(spark):
    rows = spark.createDataFrame([(1, "artikel 1", None), (2, "kap", "II"), (3, "", None), (4, "nowhere", None)], "id int, a string, b string")
    files = spark.createDataFrame([("Artikel 12.pdf",), ("Artikel 1.pdf",), ("Del ii.pdf",), ("nowher",)], "name string")
    assert dict(matching.contains_join(rows, files, "id", ["a", "b"], "name").collect()) == {1: "Artikel 1.pdf", 2: "Del ii.pdf"}
    assert matching.contains_join(rows.limit(0), files, "id", ["a"], "name").count() == 0


def test_stores_that_fail_when_read_are_left_out(spark):
    def load(store):
        df = spark.createDataFrame([(store, 1)], "s string, n int")
        return df if store == "A" else df.withColumn("n", F.raise_error(F.lit("away")).cast("int"))

    assert [r.s for r in ordering.merged_stores(["A", "B"], load).collect()] == ["A"]


def test_numbering_without_one_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"))
    got = ordering.numbered(rows, "o", "place").collect()
    assert sorted((r.o, r.place) for r in got) == [(k, k + 1) for k in range(1000)]
    keyed = ordering.remaining_steps(rows.withColumn("k", F.col("o") % 2), "o", ["k"]).where("o < 2").collect()
    assert [r.remaining for r in keyed] == [500, 500]


def test_answers_and_profiles(spark):
    df = spark.createDataFrame([("a\n Anvendte kilder/love: \n- x", "Løn og pension"), ("b", "kapital"), (None, None)], "t string, i string")
    got = df.select(retrieval.without_sources_section("t").alias("t"), rules.income_type("i").alias("i")).collect()
    assert [(r.t, r.i) for r in got] == [("a", "løn"), ("b", "kapital"), (None, "")]
    cases = spark.createDataFrame([(1, 18, None, 3, "x"), (2, 19, None, 0, None), (3, None, None, 0, "x"), (4, 15, 2, 1, "x"), (5, 3, 1, 0, "x")], "case_id int, article int, section int, workdays int, employer_type string")
    by = {r.case_id: r for r in rules.profiles(cases).collect()}
    assert set(by) == {1, 2, 3, 5} and by[1].warnings == [rules.DAYS_UNUSED] and by[2].open_questions == [rules.EMPLOYER_OPEN]
    assert by[3].sources[2].label == "DBO (ikke præciseret)" and by[5].sources[2].label == "DBO artikel 3, stk. 1" and by[5].profile == "employment_generic"
