"""The committed catalog: both files together or not at all."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.session import new_folder
from palimpsest.sources import catalogsink

SECTIONS = "instrument string, title string, source_id string, label string, section_title string, pages array<string>, ord int"


def sections(spark, rows):
    return spark.createDataFrame(rows, SECTIONS)


def test_written_and_read(spark):
    path = new_folder(spark, "catalog")
    rows = [("b", "B", f"B_{i}", f"Artikel {i}", "Om æ" if i % 2 else None, [f"side {i}"] * (i % 3), i) for i in range(40, 0, -1)]
    rows += [("a", "A \"x\"", "A_1", None, " ", None, 1), (None, None, None, None, None, None, 1)]
    catalogsink.write(sections(spark, rows).repartition(5), path, "ord")
    catalog, previews = catalogsink.read(spark, path)
    got = {r.id: r for r in catalog.collect()}
    assert set(got) == {"a", "b", None} and got["a"].title == 'A "x"'
    assert [s.id for s in got["b"].sections] == [f"B_{i}" for i in range(1, 41)]
    assert got["b"].sections[0].title == "Artikel 1 - Om æ" and got["b"].sections[1].title == "Artikel 2" and got["a"].sections[0].title == "A_1"
    shown = {r.id: r for r in previews.collect()}
    assert len(shown) == 42 and list(shown["b_5"].pages) == ["side 5"] * 2 and list(shown["a_1"].pages) == []
    root = Path(path.removeprefix("file://").removeprefix("file:"))
    for line in next(iter(root.glob("versions/*/catalog"))).glob("*.json"):
        for text in line.read_text().splitlines():
            json.loads(text)


def test_a_failed_write_leaves_the_version_before(spark):
    path = new_folder(spark, "catalog")
    root = Path(path.removeprefix("file://").removeprefix("file:"))
    rows = [(f"i{k}", "T", f"s{k}", "L", "t", ["p"], k) for k in range(30)]
    catalogsink.write(sections(spark, rows), path, "ord")
    bad = sections(spark, rows * 2).withColumn("title", F.when(F.col("ord") == 17, F.raise_error(F.lit("lost"))).otherwise(F.lit("N")))
    with pytest.raises(Exception, match="lost"):
        catalogsink.write(bad, path, "ord")
    catalog, previews = catalogsink.read(spark, path)
    assert catalog.count() == 30 == previews.count() and {r.title for r in catalog.collect()} == {"T"}
    assert len(list(root.glob("versions/*"))) == 1 and not list(root.glob("_staging/*/*/*.json"))


def test_versions_are_kept_and_removed(spark):
    path = new_folder(spark, "catalog")
    root = Path(path.removeprefix("file://").removeprefix("file:"))
    for k in range(4):
        catalogsink.write(sections(spark, [("i", f"T{k}", "s", "L", "t", [], 0)]), path, keep=2)
        before = catalogsink.read(spark, path)[0]
    assert before.first().title == "T3" and len(list(root.glob("versions/*"))) == 2
    catalogsink.write(sections(spark, []), path)
    assert catalogsink.read(spark, path)[0].count() == 0


def test_columns_are_asked_for(spark):
    spark.dataSource.register(catalogsink.LawCatalog)
    with pytest.raises(Exception, match="section_title"):
        spark.range(1).write.format("law_catalog").mode("append").option("path", new_folder(spark, "c")).save()
