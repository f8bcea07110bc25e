"""Retrieval results: parsed answers, attached and audited citations, diagnosis.

An answer is a row of (output_text, citations array<struct<file_id,filename>>, sources of the same type,
chunks array<struct<file_id,filename,score,text>>, searches array<string>). Arrays are small and stay in
their row, so all of this is projections: no shuffle. What is named more than once, or inside a function over an array's
items, is a column of its own first: Spark would find it anew each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import refs
from palimpsest.functions.text import mojibake_repaired, strip, without_marks

CITATION = "struct<file_id:string,filename:string>"
NOTE = "struct<type:string,file_id:string,filename:string>"
PART = f"struct<type:string,text:string,annotations:array<{NOTE}>>"
CHUNK = "struct<file_id:string,filename:string,score:string,text:string>"
RESPONSE = f"struct<output:array<struct<type:string,queries:array<string>,results:array<{CHUNK}>,content:array<{PART}>>>>"


def distinct_citations(xs: Column) -> Column:
    clean = F.transform(
        F.coalesce(xs, F.array().cast(f"array<{CITATION}>")),
        lambda c: F.struct(F.trim(F.coalesce(c["file_id"], F.lit(""))).alias("file_id"), F.trim(F.coalesce(c["filename"], F.lit(""))).alias("filename")),
    )
    return F.array_distinct(clean)


def parse_responses(responses: DataFrame, body: str, keep_markup: bool = False) -> DataFrame:
    """output_text, citations, chunks, sources, searches from JSON responses of typed items."""
    r = responses.withColumn("_r", F.from_json(F.col(body), RESPONSE)["output"])
    none = F.array().cast("array<string>")
    messages = F.filter("_r", lambda x: x["type"] == "message")
    content = F.flatten(F.transform(messages, lambda x: F.coalesce(x["content"], F.array().cast(f"array<{PART}>"))))
    searches = F.filter("_r", lambda x: x["type"] == "file_search_call")
    r = r.withColumns({"_content": F.filter(content, lambda c: c["text"].isNotNull()), "_searches": searches})
    notes = F.flatten(F.transform("_content", lambda c: F.coalesce(c["annotations"], F.array().cast(f"array<{NOTE}>"))))
    cited = F.transform(F.filter(notes, lambda a: a["file_id"].isNotNull()), lambda a: F.struct(a["file_id"].alias("file_id"), a["filename"].alias("filename")))
    said = without_marks(F.array_join(F.transform("_content", lambda c: c["text"]), "\n"), keep_markup)
    r = r.withColumns({"_said": said, "_chunks": F.flatten(F.transform("_searches", lambda s: F.coalesce(s["results"], F.array().cast(f"array<{CHUNK}>"))))})
    return r.select(
        *responses.columns,
        strip(mojibake_repaired("_said")).alias("output_text"),
        distinct_citations(cited).alias("citations"),
        F.col("_chunks").alias("chunks"),
        distinct_citations(F.transform("_chunks", lambda c: F.struct(c["file_id"].alias("file_id"), c["filename"].alias("filename")))).alias("sources"),
        F.array_distinct(F.coalesce(F.flatten(F.transform("_searches", lambda s: F.coalesce(s["queries"], none))), none)).alias("searches"),
    )


def is_named_statute(filename: Column, stems: Column) -> Column:
    """The file's base name starts with a named law's stem of four letters or more."""
    base = F.trim(F.lower(F.element_at(F.split(F.replace(filename, F.lit("\\"), F.lit("/")), "/"), -1)))
    return F.exists(stems, lambda s: (F.length(s) >= 4) & base.startswith(s))


def attach_named_laws(answers: DataFrame) -> DataFrame:
    """Retrieved statutes that the answer names but doesn't cite, put first among its citations."""
    rows = answers.withColumns({"_stems": refs.laws("output_text"), "_was": distinct_citations(F.col("citations"))})
    named = lambda s: (s["file_id"] != "") & (s["filename"] != "") & is_named_statute(s["filename"], F.col("_stems"))
    extra = F.filter(distinct_citations(F.col("sources")), lambda s: named(s) & ~F.array_contains("_was", s))
    rows = rows.withColumn("_extra", F.when(F.size("_stems") > 0, extra).otherwise(F.array().cast(f"array<{CITATION}>")))
    rows = rows.withColumn("citations", F.when(F.size("_extra") > 0, F.concat("_extra", "citations")).otherwise(F.col("citations")))
    return rows.drop("_stems", "_was", "_extra")


def audit(answers: DataFrame, hits: int = 3, notes: int = 4) -> DataFrame:
    """Citations held against what was retrieved: allowed, rejected, citations, mapping, problem.

    Citations of files that weren't retrieved are rejected. If none is left, all retrieved sources are
    cited. ``mapping`` has, for each citation, its first ``hits`` chunk positions (from 1) and the note
    references near the answer's sections in those. Without any source there is a problem.
    """
    sources = F.filter(distinct_citations(F.col("sources")), lambda s: s["file_id"] != "")
    chunks = F.coalesce("chunks", F.array().cast(f"array<{CHUNK}>"))
    numbered = F.transform(chunks, lambda x, i: F.struct((i + 1).alias("i"), F.trim(x["file_id"]).alias("f"), x["text"].alias("t")))
    rows = answers.withColumns({"_sources": sources, "_cited": distinct_citations(F.col("citations")), "_sections": refs.section_refs("output_text"), "_numbered": numbered})
    rows = rows.withColumn("allowed", F.sort_array(F.array_distinct(F.transform("_sources", lambda s: s["file_id"]))))
    rows = rows.withColumns(
        {
            "_ok": F.filter("_cited", lambda c: F.array_contains("allowed", c["file_id"])),
            "rejected": F.filter("_cited", lambda c: ~F.array_contains("allowed", c["file_id"])),
        }
    )
    rows = rows.withColumn("citations", F.when(F.size("_ok") > 0, F.col("_ok")).otherwise(F.col("_sources")))

    def held(c: Column) -> Column:
        own = F.slice(F.filter("_numbered", lambda x: x["f"] == c["file_id"]), 1, hits)
        return F.struct(c["file_id"].alias("file_id"), c["filename"].alias("filename"), own.alias("own"))

    def mapped(c: Column) -> Column:
        near = F.flatten(F.transform(c["own"], lambda x: refs.note_refs_near(x["t"], F.col("_sections"))))
        # Notes stand in brackets, so hits without any have none.
        noted = F.when(F.exists(c["own"], lambda x: F.contains(x["t"], F.lit("("))), F.slice(F.array_distinct(near), 1, notes)).otherwise(F.array().cast("array<string>"))
        return F.struct(c["file_id"].alias("file_id"), c["filename"].alias("filename"), F.transform(c["own"], lambda x: x["i"]).alias("hit_indices"), noted.alias("note_refs"))

    rows = rows.withColumn("_held", F.transform("citations", held)).withColumn("mapping", F.transform("_held", mapped))
    return rows.withColumn("problem", F.when(F.size("citations") == 0, "no allowed source")).drop("_sources", "_cited", "_sections", "_numbered", "_ok", "_held")


def used_results(audited: DataFrame) -> DataFrame:
    """``used``: the chunks that the audit's positions point to, each once in order; without any, all."""
    rows = audited.withColumn("_at", F.array_distinct(F.flatten(F.transform("mapping", lambda m: m["hit_indices"]))))
    chosen = F.transform("_at", lambda i: F.element_at("chunks", i))
    return rows.withColumn("used", F.when(F.size("_at") > 0, chosen).otherwise(F.col("chunks"))).drop("_at")


def with_sources_section(answers: DataFrame, heading: str = "Anvendte kilder/love") -> DataFrame:
    """Answers that name no sources get a list of their citations."""
    listed = F.filter(F.transform("citations", lambda c: c["filename"]), lambda f: f != "")
    lines = F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda f: F.concat(F.lit("- Kilde: "), f)), "\n")).otherwise("- Ingen eksplicitte kilder kunne udledes automatisk.")
    has = F.rlike("output_text", F.lit(r"(?iu)anvendte\s+kilder(?:/love)?\s*:?"))
    return answers.withColumn("output_text", F.when(has, F.col("output_text")).otherwise(F.concat(strip("output_text"), F.lit(f"\n\n{heading}\n"), lines)))


def without_sources_section(text: str | Column) -> Column:
    """An answer up to the line that heads its sources, stripped."""
    t = F.col(text) if isinstance(text, str) else text
    return strip(F.get(F.split(t, r"(?iuU)\n\s*anvendte\s+kilder(?:/love)?\s*:?\s*\n", 2), F.lit(0)))


def diagnose(answers: DataFrame, question: str) -> DataFrame:
    """num_results, score_min, score_max, missing (struct by kind), has_missing: what a question names and
    the retrieved material doesn't."""
    hay = F.array_join(F.transform("chunks", lambda c: F.concat_ws("\n", c["filename"], c["text"])), "\n")
    scores = F.filter(F.transform("chunks", lambda c: F.trim(c["score"]).try_cast("double")), lambda x: x.isNotNull())
    rows = answers.withColumns({"_hay": hay, "_scores": scores})
    rows = rows.withColumns({"_asked": refs.reference_keys(question), "_found": refs.reference_keys("_hay")})
    missing = F.struct(*[F.array_except(F.col("_asked")[k], F.col("_found")[k]).alias(k) for k in refs.KINDS])
    out = rows.withColumns(
        {"missing": missing, "num_results": F.coalesce(F.size("chunks"), F.lit(0)), "score_min": F.array_min("_scores"), "score_max": F.array_max("_scores")}
    )
    return out.withColumn("has_missing", F.size(F.flatten(F.array(*[F.col("missing")[k] for k in refs.KINDS]))) > 0).drop("_asked", "_found", "_hay", "_scores")
