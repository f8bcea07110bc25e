import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, matching, ordering, stores
from palimpsest.plans import retrieval, rules


def hits(spark, rows):
    return spark.createDataFrame(rows, "file_id string, text string, score double, ord int")


def test_search_merges_stores(spark):
    data = {"A": [("1", "a", 0.8, 0), ("2", "b", 0.6, 1)], "B": [("3", "c", 0.9, 0), ("1", "a", 0.8, 1), ("4", "", 0.99, 2)]}
    merged = ordering.merged_stores(["A", "B"], lambda s: hits(spark, data[s]))
    assert [r.file_id for r in ordering.search_topk(merged, 2).collect()] == ["3", "1"]

    def failing(s):
        if s == "A":
            raise OSError
        return hits(spark, data[s])

    assert ordering.merged_stores(["A", "B"], failing).count() == 3
    with pytest.raises(RuntimeError):
        ordering.merged_stores(["A"], failing)


@pytest.mark.parametrize("query, k, named", [("  ", 3, ["s"]), ("x" * 4001, 3, ["s"]), ("q", 0, ["s"]), ("q", 21, ["s"]), ("q", 3, [" "])])
def test_search_arguments(query, k, named):
    with pytest.raises(ValueError):
        ordering.checked(query, k, named)


def answers(spark, text, citations, sources, chunks=()):
    return spark.createDataFrame(
        [(text, [dict(zip(("file_id", "filename"), c)) for c in citations], [dict(zip(("file_id", "filename"), s)) for s in sources], [dict(zip(("file_id", "filename", "score", "text"), c)) for c in chunks])],
        f"output_text string, citations array<{retrieval.CITATION}>, sources array<{retrieval.CITATION}>, chunks array<{retrieval.CHUNK}>",
    )


def test_named_statutes_are_attached(spark):
    law, circular, other = ("f1", "Ligningsloven (2025).pdf"), ("f2", "Cirkulære om ligningsloven.pdf"), ("f3", "DJV.pdf")
    (r,) = retrieval.attach_named_laws(answers(spark, "Efter ligningslovens § 9", [other], [law, circular, other])).collect()
    assert [c.file_id for c in r.citations] == ["f1", "f3"]
    (r,) = retrieval.attach_named_laws(answers(spark, "Efter ligningsloven", [law], [law])).collect()
    assert [c.file_id for c in r.citations] == ["f1"]
    (r,) = retrieval.attach_named_laws(answers(spark, "Intet nævnt", [other], [law])).collect()
    assert [c.file_id for c in r.citations] == ["f3"]


def test_audit(spark):
    chunks = [("f1", "a.pdf", "0.9", "om § 9 C, se (422) og (12345)"), ("f2", "b.pdf", "x", "andet"), ("f1", "a.pdf", "0.5", "(77)")]
    (r,) = retrieval.audit(answers(spark, "Se § 9 C", [("f1", "a.pdf"), ("f1", "a.pdf"), ("f9", "z.pdf")], [("f1", "a.pdf"), ("f2", "b.pdf")], chunks)).collect()
    assert [c.file_id for c in r.citations] == ["f1"] and [c.file_id for c in r.rejected] == ["f9"] and r.allowed == ["f1", "f2"] and r.problem is None
    assert r.mapping[0].hit_indices == [1, 3] and r.mapping[0].note_refs == ["(422)", "(77)"]
    (r,) = retrieval.used_results(retrieval.audit(answers(spark, "", [("f9", "z")], [("f1", "a.pdf"), ("f2", "b.pdf")], chunks))).collect()
    assert [c.file_id for c in r.citations] == ["f1", "f2"] and len(r.used) == 3
    (r,) = retrieval.audit(answers(spark, "", [("f9", "z")], [])).collect()
    assert r.problem == "no allowed source"
    (r,) = retrieval.with_sources_section(answers(spark, "Svar ", [("f1", "a.pdf")], [])).collect()
    assert r.output_text == "Svar\n\nAnvendte kilder/love\n- Kilde: a.pdf"


def test_diagnosis(spark):
    chunks = [("f1", "Ligningsloven.pdf", "0.9", "§ 9 C"), ("f2", "b", "bad", "x")]
    rows = answers(spark, "", [], [], chunks).withColumn("q", F.lit("ligningsloven § 9 C og § 33 A, artikel 15"))
    (r,) = retrieval.diagnose(rows, "q").collect()
    assert r.missing.paragraffer == ["§33a"] and r.missing.love == [] and r.missing.artikler == ["artikel15"]
    assert (r.num_results, r.score_min, r.score_max, r.has_missing) == (2, 0.9, 0.9, True)


def test_responses(spark):
    body = """{"output":[{"type":"file_search_call","queries":["a","a"],"results":[{"file_id":"f1","filename":"x.pdf","score":"0.5","text":"t"}]},
      {"type":"message","content":[{"type":"output_text","text":"Hej","annotations":[{"type":"file_citation","file_id":"f1","filename":"x.pdf"},{"type":"file_citation","file_id":"f1","filename":"x.pdf"}]}]}]}"""
    (r,) = retrieval.parse_responses(spark.createDataFrame([(body,)], "body string"), "body").collect()
    assert r.output_text == "Hej" and len(r.citations) == 1 and r.searches == ["a"] and r.sources[0].file_id == "f1" and r.chunks[0].text == "t"
    (r,) = retrieval.parse_responses(spark.createDataFrame([("{}",)], "body string"), "body").collect()
    assert not r.citations


def test_catalog_queries():
    hints = {"nordisk": "ND", "nordisk overenskomst": "NDBO"}
    assert matching.parse_catalog_query("Nordisk overenskomst artikel 15 pension", hints) == {"id_prefix": "NDBO", "article": 15, "tokens": ["pension"]}
    assert matching.parse_catalog_query("18", hints)["article"] == 18
    assert matching.parse_catalog_query("nordisk15", hints)["article"] == 15
    assert matching.parse_catalog_query("", hints) == {"id_prefix": None, "article": None, "tokens": []}


def test_similarity_prefers_the_best_then_the_first(spark):
    wanted = spark.createDataFrame([("b", 1, "1. I § 9 ændres ordet her"), ("b", 2, "noget helt andet")], "block string, w int, text string")
    proposed = spark.createDataFrame([("b", 7, "2. I § 9 ændres ordet hér"), ("b", 5, "3. I § 9 ændres ordet her"), ("b", 6, "9. I § 9 ændres ordet her"), ("c", 1, "noget helt andet")], "block string, p int, text string")
    assert [tuple(r) for r in matching.best_match(wanted, proposed, ["block"], wanted_id="w", proposed_id="p").collect()] == [(1, 5, 1.0)]


def test_confirmation(spark):
    run = "et to tre fire fem seks syv otte"
    rows = [("x", "om § 9 C her", "9C"), (run, f"altså {run} ni", "1"), ("»nye ordlyd altså«", "andet", "1"), ("ophæves", "andet", "1"), ("x", "", "1"), ("x", "om § 9 C", "9")]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "c string, n string, s string").coalesce(1).select(matching.confirmation(F.col("c"), F.col("n"), F.col("s"))).collect()]
    assert [g[0] for g in got] == ["section named", "words repeated", None, None, None, "section named"]
    assert [g[2] for g in got] == [True, True, True, False, False, True] and got[5][3] is False and got[1][1] == 8


def test_budgets_pages_and_titles(spark):
    rows = spark.createDataFrame([(i, "x" * 40) for i in range(5)], "i int, t string")
    kept = ordering.char_budget(rows, "t", 100, [F.desc("i")], mark="!").orderBy(F.desc("i")).collect()
    assert [len(r.kept_text) for r in kept] == [40, 40, 21] and [r.i for r in kept] == [4, 3, 2]
    said = spark.createDataFrame([(1, 0, "assistant", "hej"), (1, 1, "user", "y" * 60), (2, 0, "assistant", "z")], "c int, turn int, role string, t string")
    assert dict(ordering.default_title(said, "c", "turn", "role", "t").collect()) == {1: "y" * 50 + "...", 2: ""}
    assert [r.remaining for r in ordering.remaining_steps(spark.range(3), "id").orderBy("id").collect()] == [3, 2, 1]
    pool = ordering.numbered_pool(spark.range(3).withColumnRenamed("id", "s"), spark.createDataFrame([(0, "(1)"), (1, "(2)")], "o int, ref string"), "s", "o")
    assert sorted((r.s, r.ref) for r in pool.collect()) == [(0, "(1)"), (1, "(2)"), (2, None)]


def test_stores(spark):
    old = spark.createDataFrame([("a", "t1", "x"), ("b", "t2", "y"), (None, "t0", "n")], "k string, title string, v string")
    new = spark.createDataFrame([("a", "t9", "z"), ("c", "t3", None), (None, "t9", "m")], "k string, title string, v string")
    assert sorted(map(tuple, stores.upsert(old, new, ["k"], ["title"]).collect()), key=str) == sorted([("a", "t1", "z"), ("b", "t2", "y"), ("c", "t3", None), (None, "t0", "m")], key=str)
    left, gone = stores.delete(old, spark.createDataFrame([("a",), ("q",)], "k string"), ["k"])
    assert left.count() == 2 and [r.k for r in gone.collect()] == ["a"]
    pair = spark.createDataFrame([('{"id": 1, "a": {"x": 1, "y": [1]}, "m": {"q": 1}}', '{"id": 2, "a": {"y": [2], "z": {}}, "m": {"r": 2}}')], "a string, b string")
    assert pair.select(stores.deep_merge(F.col("a"), F.col("b"), ["id"], ["m"])).first()[0] == '{"id": 1, "a": {"x": 1, "y": [2], "z": {}}, "m": {"r": 2}}'
    maps = pair.select(stores.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")), ["a"])).first()[0]
    assert maps == {"b": "3"}
    assert spark.createDataFrame([(" ø/b ",), ("",)], "u string").select(stores.safe_user("u")).collect()[0][0] == "__b"


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = sorted(map(tuple, graph.walk(edges, spark.createDataFrame([("a",), ("x",), ("q",)], "s string")).collect()))
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("q", "q", 0), ("x", "x", 0), ("x", "y", 1)]
    rel = spark.createDataFrame([("v1", "v2", 0), ("v1", "w", 1), ("v2", "v3", 0)], "src string, dst string, ord int")
    names = spark.createDataFrame([("v1", "lov"), ("v2", "lov"), ("v3", "lov"), ("w", "anden")], "document string, law_name string")
    assert [tuple(r) for r in graph.newest(rel, names, spark.createDataFrame([("v1",)], "s string")).collect()] == [("v1", "v3", 2)]
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "document_path string")
    fixed = graph.years_corrected(path("eli/lta/2204/5", "eli/lta/2010/6", "eli/lta/2011/7", "eli/lta/2012/8"), path("eli/lta/2004/5", "eli/lta/2011/7"), path("eli/lta/2010/6"), 2026)
    assert {r.document_path: (r.resolved, r.note) for r in fixed.collect()} == {
        "eli/lta/2204/5": ("eli/lta/2004/5", "year corrected"), "eli/lta/2010/6": ("eli/lta/2010/6", None), "eli/lta/2011/7": ("eli/lta/2011/7", None), "eli/lta/2012/8": (None, "act not found"),
    }


def test_rules(spark):
    cases = spark.createDataFrame(
        [(1, "2022, 2024", ["foreign_real_estate"], "", "", "bor her"), (2, "2023", ["self_employed_business"], "not_covered_by_section_2", "", "x"), (3, "", ["foreign_income"], "", "løn", "x"),
         (4, "2023", ["foreign_income"], "", "", "x"), (5, "2023", ["foreign_income"], "", "løn", ""), (6, "2023", ["self_employed_business"], "?", "", "x"), (7, "2023", ["nope"], "", "", "x")],
        "case_id int, income_years string, triggers array<string>, mode string, detail string, residence string",
    )
    got = {r.case_id: r for r in rules.deadlines(cases).collect()}
    assert got[1].orders == ["1305 af 14. november 2018", "49 af 24. januar 2025"] and got[1].last_deadline == 2028 and got[1].problem is None
    assert got[2].provision == "§ 1, stk. 2, nr. 1" and got[2].lines == "For indkomståret 2023 kan vi derfor varsle ændring senest den 1. maj 2027 og foretage ansættelsen senest den 1. august 2027."
    assert [got[i].problem for i in range(3, 8)] == ["no income year", "detail missing", "residence missing", "unknown mode", "unknown trigger"]
    days = spark.createDataFrame([(1, "Danmark", 100), (1, "Sverige", 50), (1, "Norge", 50), (1, "Tom", 0)], "case_id int, country string, days int")
    rows = rules.allocate(days, spark.createDataFrame([(1, 1000.0, "SVERIGE")], "case_id int, amount double, employer_country string")).collect()
    assert {r.country: (r.share_ratio, r.amount, r.taxed_in) for r in rows} == {"Danmark": (0.5, 500.0, "Danmark"), "Sverige": (0.25, 250.0, "Sverige"), "Norge": (0.25, 250.0, "danmark")}
    (a,) = spark.createDataFrame([("Artikel 15, stk. 2",)], "t string").select(rules.article_of("t")).collect()
    assert tuple(a[0]) == (15, 2)
