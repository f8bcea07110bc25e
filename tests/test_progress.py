"""A walk told by steps is the walk."""

import pytest

from palimpsest.operators import graph
from palimpsest.session import new_folder
from palimpsest.streaming import progress

EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y"), ("x", "z"), (None, "a"), ("q", None), ("y", "b")]
STARTS = [("a",), ("x",), ("a",), (None,), ("q",)]


def test_increments_are_the_walk(spark):
    edges, starts = spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame(STARTS, "node string")
    for most in (1, 3, 8):
        folder = new_folder(spark, "told")
        got = progress.told(edges, starts, folder, most, files=1)
        want = sorted(map(tuple, graph.walk(edges, starts, most).collect()))
        assert sorted((r.start, r.node, r.depth) for r in got.collect()) == want
        if most == 8:
            assert got.select("step").distinct().count() >= 4


def test_a_stopped_walk_goes_on(spark):
    edges, starts = spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame(STARTS, "node string")
    folder = new_folder(spark, "told")
    known = progress.prepare(edges, starts, folder)
    with pytest.raises(LookupError):
        progress.increments(spark, folder)
    for most in (2, 8):  # the second run is allowed further steps, from the checkpoint
        query = progress.start(spark, known, folder, most, files=100)
        query.processAllAvailable()
        said = progress.messages(query)
        query.stop()
        assert said or most == 8
    got = sorted((r.start, r.node, r.depth) for r in progress.increments(spark, folder).collect())
    assert got == sorted(map(tuple, graph.walk(edges, starts, 2).collect()))
