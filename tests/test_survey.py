from pyspark.sql import functions as F

from palimpsest.functions.refs import distinct_folded
from palimpsest.plans import survey


def test_contexts(spark):
    rows = [("s", "a.txt", "txt", "retskilde", None, "2024-01-02 00:00:00", "ny tekst"), ("s", "b.txt", None, "?", True, "2024-01-01 00:00:00", "gammel " * 30), ("s", "c", "x", "fakta", False, "2024-01-03 00:00:00", "slået fra"), ("s", "d", "x", "fakta", True, "2024-01-04 00:00:00", " ")]
    files = spark.createDataFrame(rows, "session_id string, filename string, file_type string, kind string, enabled boolean, created string, text string").withColumn("created", F.to_timestamp("created"))
    (r,) = survey.context_text(survey.context_blocks(files, 120)).collect()
    assert r.kinds == ["retskilde", "fakta"]
    assert r.context.startswith("[Kontekstfil: a.txt | type: txt]\nny tekst\n\n[Kontekstfil: b.txt | type: ukendt]\ngammel") and r.context.endswith("[NOTE: Kontekst afkortet pga. længde]")


def test_committee_and_relations(spark):
    bills = spark.createDataFrame([(1,), (2,)], "id int")
    docs = spark.createDataFrame([(1, 10, "Betænkning over L 1", 2), (1, 11, "Tillægsbetænkning", 5), (1, 12, "Ændringsforslag nr. 1", 3), (1, 13, "Andet", 1)], "bill_id int, document_id int, title string, ord int")
    files = spark.createDataFrame([(10, "u2"), (10, "u1")], "document_id int, url string")
    got = {r.id: r for r in survey.committee_stage(bills, docs, files).collect()}
    assert got[1].report_title == "Betænkning over L 1" and got[1].report_url == "u1" and got[1].amendment_titles == ["Ændringsforslag nr. 1"] and got[1].explains
    assert got[2].report_title is None and not got[2].explains
    rel = spark.createDataFrame([("a", "x/ft/1"), ("a", "y"), ("b", "z")], "d string, t string")
    assert tuple(survey.relation_share(rel, "d", "t").first()) == (2, 1)
    acts = spark.createDataFrame([("Ligningsloven", "2020"), ("Om ligningsloven", "2021"), ("x", "2022")], "title string, date string")
    assert [r.title for r in survey.by_title(acts, "LIGNING", 2).collect()] == ["Om ligningsloven", "Ligningsloven"]


def test_targets(spark):
    units = spark.createDataFrame([("9C", 1, None, ["a.", "b."]), ("9C", 2, 1, ["x."])], "paragraph_id string, stk_number int, nr_number int, sentences array<string>")
    texts = [[], ["x"], ["§ 1"], ["§ 9 C, stk. 5"], ["§ 9 C, stk. 2, nr. 4"], ["§ 9 C, 3. pkt."], ["§ 9 C, 2. pkt."]]
    items = spark.createDataFrame([("e", i, t) for i, t in enumerate(texts)], "eli string, ord int, probable_targets array<string>")
    assert {r.bucket: r.n for r in survey.target_checks(items, units).collect()} == {b: 1 for b in ("no target", "unreadable", "no section", "no subsection", "no item", "sentence out of range", "found")}


def test_facts(spark):
    row = spark.range(1).select(F.create_map(F.lit("Sverige"), F.lit(1), F.lit("sverige"), F.lit(2), F.lit(" "), F.lit(3), F.lit("Norge"), F.lit(4)).alias("d"))
    assert row.select(survey.work_countries(F.col("d"))).first()[0] == ["Norge", "Sverige"]
    assert row.select(survey.pruned_days(F.col("d"), F.array(F.lit("norge")))).first()[0] == {"Norge": 4}
    assert row.select(survey.decision_fact("k", F.lit(" "))).first()[0].status == "uafklaret"
    assert row.select(distinct_folded(F.array(F.lit("a  b"), F.lit("A b"), F.lit("c")))).first()[0] == ["a b", "c"]
