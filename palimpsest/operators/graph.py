"""Walks along version chains, in written rounds of doubling length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import discard, spool, spooled


def walk(edges: DataFrame, starts: DataFrame, max_steps: int | None = 40, src: str = "src", dst: str = "dst") -> DataFrame:
    """start, node, depth (from 0) along one edge a node; a walk ends at a node without an edge, at one it
    has been at, or after ``max_steps`` nodes (None: never).

    Rounds double: what is known to depth n is joined with jumps of n edges, and the jumps with themselves, so a chain of n
    nodes takes log2(n) rounds, and no round holds a path. A node that is met again is further on the second time, so the
    least depth of each (start, node) is the walk. Of several edges of a node the least target counts; a null start or
    target is none; starts that repeat are one.
    """
    jumps = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    jumps = spool(jumps.groupBy("src").agg(F.min("dst").alias("dst")), "walk-jumps")
    at = starts.select(F.col(starts.columns[0]).alias("start")).where("start is not null").distinct()
    at, path = spooled(at.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), "walk-0")
    known, length = at.count(), 1
    while known and (max_steps is None or length < max_steps):
        on = at.join(jumps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("depth") + length).alias("depth"))
        if max_steps is not None:
            on = on.where(F.col("depth") < max_steps)
        past = path
        at, path = spooled(at.unionByName(on).groupBy("start", "node").agg(F.min("depth").alias("depth")), f"walk-{length}")
        discard(edges.sparkSession, past)
        before, known = known, at.count()
        if known == before:
            break
        length *= 2
        if max_steps is None or length < max_steps:
            onward = jumps.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
            jumps = spool(jumps.join(onward, "dst").select("src", F.col("end").alias("dst")), f"walk-jumps-{length}")
    return at


def walk_whole(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """As ``walk``, to the end of every chain."""
    return walk(edges, starts, None, src, dst)


def next_version(relations: DataFrame, names: DataFrame) -> DataFrame:
    """src, dst: of the newer versions listed for a document, the last that bears its law's name.

    ``relations``: src, dst, ord; ``names``: document, law_name. A document's acts also point to versions of
    other laws, which don't count.
    """
    a = names.select(F.col("document").alias("src"), F.col("law_name").alias("_a"))
    b = names.select(F.col("document").alias("dst"), F.col("law_name").alias("_b"))
    same = relations.join(a, "src").join(b, "dst").where((F.col("_a") == F.col("_b")) & (F.col("src") != F.col("dst")))
    return same.groupBy("src").agg(F.max_by("dst", "ord").alias("dst"))


def newest(relations: DataFrame, names: DataFrame, starts: DataFrame, max_steps: int = 12) -> DataFrame:
    """start, newest, steps: each start's newest version and how many steps led there."""
    path = walk(next_version(relations, names), starts, max_steps + 1)
    return path.groupBy("start").agg(F.max_by("node", "depth").alias("newest"), F.max("depth").alias("steps"))


def amendments_along(chain: DataFrame, amendments: DataFrame, per_section: bool = False) -> DataFrame:
    """Each act once, at the first version of the chain that lists it: chain (start, node, depth) with
    amendments (eli, seq, document_path, paragraph). ``per_section``: once for each of its sections."""
    from palimpsest.operators.ordering import first_wins

    listed = chain.join(amendments, chain["node"] == amendments["eli"]).select("start", "node", "depth", "seq", "document_path", "paragraph")
    return first_wins(listed, ["start", "document_path", *(["paragraph"] if per_section else [])], "depth", "seq")


def years_corrected(cited: DataFrame, known: DataFrame, present: DataFrame, latest_year: int) -> DataFrame:
    """Cited act paths with a mistyped year put right: path, resolved, note.

    A path is right if it is known. Otherwise the one known act of the same number takes its place, if
    there is just one and the stated year can't be right or the stated act doesn't exist.
    ``known``: document_path of acts that changed the law; ``present``: document_path of acts that exist.
    """
    from palimpsest.functions.refs import plausible_year

    number = lambda c: F.element_at(F.split(c, "/"), -1)
    by_number = known.select("document_path").distinct().groupBy(number(F.col("document_path")).alias("_n"))
    by_number = by_number.agg(F.count("*").alias("_c"), F.min("document_path").alias("_one"))
    rows = cited.select("document_path").distinct().withColumn("_n", number(F.col("document_path")))
    rows = rows.join(known.select("document_path", F.lit(True).alias("_known")).distinct(), "document_path", "left")
    rows = rows.join(present.select("document_path", F.lit(True).alias("_here")).distinct(), "document_path", "left")
    rows = rows.join(by_number, "_n", "left")
    doubtful = ~plausible_year("document_path", latest_year) | F.col("_here").isNull()
    fixed = F.col("_known").isNull() & doubtful & (F.col("_c") == 1)
    return rows.select(
        "document_path",
        F.when(F.col("_known").isNotNull() | ~doubtful, F.col("document_path")).when(fixed, F.col("_one")).alias("resolved"),
        F.when(fixed, "year corrected").when(F.col("_known").isNull() & doubtful, "act not found").alias("note"),
    )
