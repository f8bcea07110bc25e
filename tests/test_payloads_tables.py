"""Facts in VARIANT, and law documents read in SQL."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import tables
from palimpsest.plans import payloads
from palimpsest.sources import lawxml


def test_payload(spark):
    cases = {
        1: '{"incomeYears": "2021, 2019", "selectedFactors": ["foreign_assets_liabilities_significant"], "foreignAssetsLiabilitiesType": "gæld", "selfEmployedMode": " x "}',
        2: '{"selectedFactors": ["foreign_income"], "foreignIncomeTypes": ["salary"], "residenceMode": "since_year"}',
        3: '{"selectedFactors": "no list", "factorDetails": [1], "residenceMode": {"a": 1}, "residenceFact": 12}',
        4: "[1]",
        5: "no json",
        6: None,
        7: "{}",
        8: '{"a": 1, "a": 2}',
    }
    rows = spark.createDataFrame(list(cases.items()), "id int, t string").select("id", payloads.facts("t").alias("v"))
    got = {r.id: r for r in rows.select("id", F.col("v").isNotNull().alias("is_case"), *[c.alias(n) for n, c in payloads.payload(F.col("v")).items()]).collect()}
    assert {i for i, r in got.items() if r.is_case} == {1, 2, 3, 7}
    assert (got[1].income_years, got[1].foreign_income, got[1].self_employed_business_mode) == ("2019,2021", "Aktiver eller passiver i udlandet af betydning for skatteansættelsen: gæld", "x")
    assert got[2].selected_trigger_detail == "lønindkomst" and got[2].residence_fact == "" and got[2].one_trigger
    assert (got[3].selected_trigger, got[3].residence_mode, got[3].residence_fact, got[3].one_trigger) == ("", "", "12", False)
    assert got[5].foreign_income == got[6].residence_fact == "" and not got[7].one_trigger


def test_merged_schema(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": {"x": "t"}}'), (2, '{"a": 2.5, "c": [1], "n": null}'), (3, '{"b": {"y": true}}'), (4, "x")], "id int, t string")
    held = rows.select("id", payloads.facts("t").alias("v"))
    flat = payloads.flattened(held, "v", "f_")
    got = {r.id: r for r in flat.collect()}
    assert flat.columns == ["id", "f_a", "f_b", "f_c", "f_n"]
    assert (float(got[2].f_a), list(got[2].f_c), got[1].f_b.x, got[3].f_b.y, got[1].f_b.y) == (2.5, [1], "t", True, None)
    assert got[4].f_a is None and got[3].f_c is None
    assert payloads.flattened(held.where("id = 4"), "v").columns == ["id"]


LAW = (
    '<Dokument><Paragraf localId="1"><Explicatus>§ 1.</Explicatus><Stk><Exitus><Linea>Et.</Linea><Linea>To.</Linea></Exitus></Stk></Paragraf>'
    '<AendringCentreretParagraf localId="2"><Exitus>I loven</Exitus><AendringsNummer><Explicatus>1.</Explicatus>I <Char signiChar="AendringURN">§ 3</Char> udgår »x«.</AendringsNummer></AendringCentreretParagraf></Dokument>'
)


def test_table_functions_give_the_sources_rows(spark):
    tables.register(spark)
    docs = spark.createDataFrame([("a", LAW.encode()), ("b", b"<broken"), ("c", None), (None, b"<r/>")], "eli string, body binary")
    ask = lambda name, d=docs: spark.sql(f"select p.* from {{d}} d, lateral {name}(d.eli, d.body) p", d=d)
    assert ask("parse_provisions").drop("ord").collect() == lawxml.provisions(docs).drop("ord").collect()
    want = lawxml.instructions(docs).select("eli", "ord", "intro", "act_number", "item_number", "text", "targets").collect()
    assert ask("parse_instructions").select(F.col("key").alias("eli"), "ord", "intro", "act_number", "item_number", "text", "targets").collect() == want
    assert [r.line for r in ask("parse_note_lines").orderBy("ord").collect()] == ["Et.", "To."]
    other = docs.where("eli = 'a'").select(F.struct(F.lit(1).alias("n")).alias("eli"), F.decode("body", "UTF-8").alias("body"))
    got = ask("parse_provisions", other)
    assert got.schema["key"].dataType == other.schema["eli"].dataType and got.count() == 1
    with pytest.raises(Exception, match="binary or text"):
        ask("parse_provisions", docs.select("eli", F.lit(1).alias("body")))
