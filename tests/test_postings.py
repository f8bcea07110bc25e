"""The section index: deltas against a rebuild, overtaken writers, lost jobs; surveys read from it."""

import random

import pytest

from palimpsest.operators.postings import Index
from palimpsest.plans import history
from palimpsest.session import new_folder, paths_like


def rows_of(df):
    return sorted(map(tuple, df.select("term", "doc", "n").collect()), key=repr)


def delta(spark, held):
    posted = [(t, d, n) for d, ps in held.items() for t, n in ps]
    return spark.createDataFrame(posted, "term string, doc string, n int"), spark.createDataFrame([(d,) for d in held], "doc string")


def test_deltas_equal_a_rebuild(spark):
    rng = random.Random(1)
    index = Index(spark, new_folder(spark, "index"))
    known: dict = {}
    for turn in range(11):
        docs = [f"d{rng.randrange(12)}" for _ in range(3)] + ([None] if turn == 4 else [])
        new = {d: [(rng.choice(["hot", "a", "b", "ø"]), turn) for _ in range(rng.randrange(4))] for d in docs}
        if turn == 0:
            new["d0"] = [("hot", 0), ("hot", 0)]  # repeated postings stay
        known |= new
        index.update(*delta(spark, new), buckets=4)
        if turn in (1, 5, 10):
            want = sorted([(t, d, n) for d, ps in known.items() for t, n in ps], key=repr)
            assert rows_of(index.postings()) == want
            assert rows_of(index.postings(["hot", "ø"])) == [r for r in want if r[0] in ("hot", "ø")]
    assert len(index._log()[1]) < 11  # merged on the way
    index.merge()
    assert rows_of(index.postings()) == sorted([(t, d, n) for d, ps in known.items() for t, n in ps], key=repr)
    index.vacuum()
    assert len(paths_like(spark, f"{index.folder}/segments/*")) == 1 == len(paths_like(spark, f"{index.folder}/log/*"))
    assert {r.doc for r in index.documents().collect()} >= {d for d, ps in known.items() if ps}


def test_an_overtaken_writer_changes_nothing(spark):
    index = Index(spark, new_folder(spark, "index"))
    index.update(*delta(spark, {"x": [("t", 1)]}))
    version, segments, buckets = index._log()
    lost = index._write(*delta(spark, {"x": [("t", 9)]}), buckets)
    index.update(*delta(spark, {"y": [("t", 2)]}))
    with pytest.raises(Exception, match="(?i)exists"):
        index._commit(version + 1, [*segments, lost], buckets)
    assert rows_of(index.postings()) == [("t", "x", 1), ("t", "y", 2)]


def test_a_lookup_reads_its_buckets_only(spark):
    index = Index(spark, new_folder(spark, "index"))
    index.update(*delta(spark, {f"d{i}": [(f"t{i}", i)] for i in range(50)}), buckets=16)
    plan = index.postings(["t7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80] and "PushedFilters: [IsNotNull(term), EqualTo(term,t7)" in plan
    assert rows_of(index.postings(["t7"])) == [("t7", "d7", 7)]


def test_no_index(spark):
    with pytest.raises(LookupError):
        Index(spark, new_folder(spark, "none")).postings()
    index = Index(spark, new_folder(spark, "index"))
    index.update(*delta(spark, {"x": [(None, 1)]}))  # a null term is none
    with pytest.raises(LookupError):
        index.postings()


ACT = (
    '<Dokument><AendringCentreretParagraf localId="1"><Exitus>I prøveloven foretages:</Exitus>'
    '<AendringsNummer><Explicatus>1.</Explicatus>I <Char signiChar="AendringURN">§ 9 A, stk. 2</Char> og <Char signiChar="AendringURN">§ 9 A, stk. 3</Char> udgår »x«.</AendringsNummer>'
    '<AendringsNummer><Explicatus>2.</Explicatus>Efter <Char signiChar="AendringURN">§ 10</Char> indsættes: <AendringNyTekst><Paragraf localId="10 a"><Linea>Ny.</Linea></Paragraf><Paragraf localId="10"><Linea>Ny.</Linea></Paragraf></AendringNyTekst></AendringsNummer>'
    "</AendringCentreretParagraf></Dokument>"
)


def test_survey(spark):
    docs = spark.createDataFrame([("eli/lta/2020/1", ACT.encode()), ("eli/lta/2021/2", b"<broken")], "eli string, body binary")
    index = history.section_index(spark, new_folder(spark, "index"))
    history.index_acts(index, docs, "prøvelov")
    assert sorted((r.section, r.as_target) for r in index.postings().collect()) == [("10", True), ("10A", False), ("9A", True)]
    wanted = spark.createDataFrame([("9A",), ("10a",), ("10",), ("11",), ("11B",)], "section string")
    said = spark.createDataFrame([("eli/lta/2020/1",), ("eli/lta/2025/7",), ("eli/lta/2019/3",), ("eli/lta/2019/4",), ("odd",)], "document_path string")
    rows, totals = history.survey(index, wanted, said, said.where("document_path like '%2019/4'"), 2022)
    assert {r.section: (r.verdict, r.items) for r in rows.collect()} == {"9A": ("found", 1), "10a": ("only_inserted", 1), "10": ("found", 1), "11": ("missing", 0), "11B": ("missing_lettered", 0)}
    assert {r.section: r.first_item for r in rows.collect()}["10a"] == "eli/lta/2020/1 § 1, nr. 2"
    assert totals.first().asDict() == {"sections": 5, "found": 3, "only_inserted": 1, "missing": 2, "missing_lettered": 1, "items": 3, "acts": 1, "outside": 4, "unexplained": 2}
    history.index_acts(index, docs.limit(0), "prøvelov", docs.select("eli").limit(1))
    index.update(history.section_postings(history.lawxml.instructions(docs.limit(0))), docs.select("eli").limit(1))
    assert index.postings().count() == 0
