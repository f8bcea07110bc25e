"""Steps that are found once for each row, and batches in place of single documents."""

import difflib
import random
import re

from pyspark.sql import functions as F

from palimpsest.functions import refs, tables, text
from palimpsest.operators import matching
from palimpsest.plans import catalog, history, retrieval
from palimpsest.sources import lawxml

LAW = (
    '<Dokument><AendringCentreretParagraf localId="2"><Exitus>I loven</Exitus><AendringsNummer><Explicatus>1.</Explicatus>I <Char signiChar="AendringURN">§ 3</Char> og <Char formaChar="Italic">§ 4</Char> udgår »x«.</AendringsNummer>'
    '<AendringsNummer><Explicatus>2.</Explicatus>Ny: <AendringNyTekst><Paragraf localId="9 c"><Linea>Ny.</Linea></Paragraf><Paragraf localId="9 C"/><Paragraf/></AendringNyTekst></AendringsNummer></AendringCentreretParagraf></Dokument>'
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_answer_is_cleaned_and_its_chunks_read_once(spark):
    rows = spark.createDataFrame([(1, "q", '{"output":[]}')], "k int, question string, body string")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    try:
        audited = retrieval.audit(retrieval.attach_named_laws(retrieval.parse_responses(rows, "body")))
        told = plan(retrieval.diagnose(retrieval.used_results(audited), "question"))
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
    assert told.count("filecite") == 1  # an answer's marks
    assert told.count("concat_ws") == 1  # what was retrieved, joined to be searched


def test_references_by_their_patterns(spark):
    rng = random.Random(7)
    some = ["§", "§§", " ", " ", "12", "9", "C", "c", "æ", "o", "Å", "I", "lov", "ligningsloven", "SKM2019.123.HR", "ſkm 2020.7", "artikel 4", "tfs", "x", "."]
    said = [("".join(rng.choice(some) for _ in range(rng.randrange(14))),) for _ in range(400)] + [(None,), ("",)]
    got = spark.createDataFrame(said, "t string").select("t", refs.reference_keys("t").alias("r")).collect()
    letters = "A-Za-zÆØÅæøå"
    for r in got:
        want = set()
        for n, letter in re.findall(rf"§+\s*(\d+)\s*(?:([{letters}])(?![{letters}]))?", r.t or ""):
            want.add("§" + n + ("" if letter.lower() in refs.NOT_SECTION_LETTERS else letter.lower()))
        assert r.r[refs.KINDS[0]] == sorted(want), r
        assert r.r[refs.KINDS[1]] == sorted({x.lower() for x in re.findall(r"(?i)([a-zæøå]{4,}lov)(?:en|ens|e|s)?\b", r.t or "")}), r
        assert r.r[refs.KINDS[3]] == sorted({"artikel" + n for n in re.findall(r"(?i)\bartikel\s*(\d+)", r.t or "")}), r
    assert sum(bool(r.r[refs.KINDS[2]]) for r in got) > 20


def test_documents_in_batches_give_the_sources_rows(spark):
    tables.register(spark)
    docs = spark.createDataFrame([("a", LAW.encode()), ("b", b"<broken"), ("c", None), (None, b"<r/>"), ("d", LAW.encode())], "eli string, body binary").coalesce(1)
    got = spark.sql("select d.eli, i.* from {d} d lateral view inline(instructions_in(d.body)) i", d=docs)
    want = lawxml.instructions(docs).select("eli", "ord", "intro", "act_number", "item_number", "text", "targets", "italic_spans", "new_text", "inserted_ids").collect()
    assert got.collect() == want and len(want) == 4 and want[1].inserted_ids == ["9C"]
    as_text = docs.select("eli", F.decode("body", "UTF-8").alias("body")).where("eli = 'a'")
    assert spark.sql("select i.line from {d} d lateral view inline(note_lines_in(d.body)) i", d=as_text).collect()[0].line == "Ny."
    empty = spark.sql("select i.* from {d} d lateral view inline(provisions_in(d.body)) i", d=docs)
    assert empty.count() == 0
    assert "BatchEvalPythonUDTF" not in plan(catalog.lateral_items(spark, "/root/testdata/sf0.001"))


def test_words_are_those_of_the_folding_pattern(spark):
    every = spark.range(1, 0x10000).where(f"id not between {0xD800} and {0xDFFF}")
    one = every.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    differ = one.where(F.rlike("c", F.lit("(?iu)^[0-9a-zæøå]\\z")) != F.rlike("c", F.lit(f"^{text.WORD}\\z")))
    assert differ.count() == 0
    rows = spark.createDataFrame([("Ærø 12b, İx: Å-Å",), ("",), (None,)], "t string").select(text.words("t").alias("w"), text.spaced_words("t").alias("s")).collect()
    assert [None if r.w is None else " ".join(r.w) for r in rows] == [r.s for r in rows]


def test_longest_runs_and_mentions(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choice("abc") for _ in range(rng.randrange(30))), " ".join(rng.choice("abcd") for _ in range(rng.randrange(30)))) for _ in range(200)] + [(None, "a"), ("a", None)]
    got = spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(matching.longest_run("a", "b")).collect()
    for (a, b), (n,) in zip(pairs, got, strict=True):
        x, y = (a or "").split(), (b or "").split()
        assert n == difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y)).size
    some = ["§", "A", "5", "\x01", ",", "§A§", "$", "\\"]
    held = [("".join(rng.choice(some) for _ in range(rng.randrange(9))), "".join(rng.choice(some) for _ in range(rng.randrange(1, 4)))) for _ in range(500)]
    df = spark.createDataFrame(held, "h string, s string").coalesce(1).select(matching._mentioned(F.col("h"), F.col("s")))
    assert [r[0] for r in df.collect()] == [re.search(re.escape("§" + s) + r"(?![^\W_])", h) is not None for h, s in held]


def test_a_note_is_flattened_once(spark):
    rows = spark.createDataFrame([("I § 1 A", "Om § 1 A, mere", "1A")], "c string, n string, s string").withColumn("f", matching.flat("n"))
    told = plan(rows.select(matching.confirmation(F.col("c"), F.col("n"), F.col("s"), held=F.col("f")).alias("x")))
    assert told.count("(?U)\\s+") == 1
    notes = catalog.confirmed_notes(spark, "/root/testdata/sf0.001")
    assert plan(notes).count("(?U)\\s+") == 1


def test_a_survey_reads_the_index_once(spark, tmp_path):
    index = history.section_index(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([("a", LAW.encode()), ("d", LAW.encode())], "eli string, body binary")
    history.index_acts(index, docs, "loven", buckets=2)
    wanted = spark.createDataFrame([("3",), ("9c",), ("5B",), ("6",)], "section string")
    acts = spark.createDataFrame([("a",)], "document_path string")
    rows, totals = history.survey(index, wanted, acts, acts.limit(0), 2000)
    assert plan(rows).count("FileScan") == 1
    got = {r.section: (r.verdict, r["items"], r.first_item) for r in rows.collect()}
    assert got == {"3": ("found", 2, "a § 2, nr. 1"), "9c": ("only_inserted", 2, "a § 2, nr. 2"), "5B": ("missing_lettered", 0, ""), "6": ("missing", 0, "")}
    assert totals.first()["items"] == 4
