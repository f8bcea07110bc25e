"""Surveys and assemblies over law documents, cases and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import refs
from palimpsest.functions.text import strip
from palimpsest.operators.ordering import char_budget, first_wins

#: Kinds of context, in the order in which they are framed.
CONTEXT_KINDS = ("fakta", "retskilde", "skrivevejledning")


#: A context's frame, what stands for names it lacks, and the mark where it was cut.
FRAME = ("[Kontekstfil: ", " | type: ", "]\n")
NO_NAME, NO_TYPE = "ukendt_fil", "ukendt"
CUT = "\n[NOTE: Kontekst afkortet pga. længde]\n"


# --- contexts -------------------------------------------------------------------------------------


def context_blocks(files: DataFrame, budget: int, session: str = "session_id") -> DataFrame:
    """Enabled context files of each session as blocks, newest first, within a character budget.

    ``files``: session, filename, file_type, kind, enabled, created, text. A kind that isn't known is facts;
    a file that doesn't say is enabled; files without text are left out.
    """
    kind = F.when(F.col("kind").isin(*CONTEXT_KINDS), F.col("kind")).otherwise(CONTEXT_KINDS[0])
    named = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    block = F.concat(F.lit(FRAME[0]), named("filename", NO_NAME), F.lit(FRAME[1]), named("file_type", NO_TYPE), F.lit(FRAME[2]), F.trim("text"), F.lit("\n"))
    rows = files.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    rows = rows.withColumns({"kind": kind, "block": block})
    return char_budget(rows, "block", budget, [F.desc("created"), "filename"], [session], out="kept_block", mark=CUT)


def context_text(blocks: DataFrame, session: str = "session_id") -> DataFrame:
    """session, kinds (first seen first), context: a session's kept blocks joined, newest first."""
    row = F.struct((-F.unix_micros(F.col("created").cast("timestamp"))).alias("o"), "filename", "kind", "kept_block")
    ordered = F.array_sort(F.collect_list(row))
    both = blocks.groupBy(session).agg(ordered.alias("_b"))
    return both.select(session, F.array_distinct(F.transform("_b", lambda b: b["kind"])).alias("kinds"), strip(F.array_join(F.transform("_b", lambda b: b["kept_block"]), "\n")).alias("context"))


# --- committee stage, discovery, relations ---------------------------------------------------------


def committee_stage(bills: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """Of each bill (id): its first report with the file's address, and the amendments proposed to it.

    ``documents``: bill_id, document_id, title, ord; ``files``: document_id, url.
    """
    title = F.lower(F.trim("title"))
    kind = F.when(F.rlike(title, F.lit("(?iu)^(betænkning|tillægsbetænkning)")), "report").when(F.rlike(title, F.lit("(?iu)^ændringsforslag")), "amendment")
    told = documents.withColumn("_k", kind).where("_k is not null").join(first_wins(files, ["document_id"], "url"), "document_id", "left")
    report = F.min_by(F.when(F.col("_k") == "report", F.struct("title", "url")), F.when(F.col("_k") == "report", F.col("ord"))).alias("_r")
    amendments = F.array_sort(F.collect_list(F.when(F.col("_k") == "amendment", F.struct("ord", "title")))).alias("_a")
    stages = told.groupBy("bill_id").agg(report, amendments)
    rows = bills.join(stages, F.col("id") == F.col("bill_id"), "left")
    titles = F.coalesce(F.transform("_a", lambda a: a["title"]), F.array().cast("array<string>"))
    return rows.select("id", F.col("_r.title").alias("report_title"), F.col("_r.url").alias("report_url"), titles.alias("amendment_titles"), (F.size(titles) > 0).alias("explains"))


def by_title(acts: DataFrame, term: str, most: int, title: str = "title", date: str = "date") -> DataFrame:
    """Acts whose title contains a term, newest first; a top-k report."""
    return acts.where(F.contains(F.lower(title), F.lit(term.lower()))).orderBy(F.desc(date), title).limit(most)


def relation_share(relations: DataFrame, document: str, target: str, part: str = "/ft/") -> DataFrame:
    """documents, related: how many documents have a relation to an address with a given part."""
    hit = relations.groupBy(document).agg(F.bool_or(F.contains(F.col(target), F.lit(part))).alias("_h"))
    return hit.agg(F.count("*").alias("documents"), F.count_if("_h").alias("related"))


def relation_counts(metadata: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """Sizes of each relation's array."""
    return metadata.select("*", *[F.coalesce(F.size(r), F.lit(0)).alias(f"n_{r}") for r in relations])


# --- validation of targets ------------------------------------------------------------------------


def target_checks(items: DataFrame, units: DataFrame) -> DataFrame:
    """bucket, n: how the first target of each item fares in a law's units.

    "no target", "unreadable", "no section", "no subsection", "no item", "sentence out of range", "found".
    """
    pointer = refs.target(F.coalesce(F.get("probable_targets", F.lit(0)), F.lit("")))
    rows = items.select("eli", "ord", (F.size("probable_targets") > 0).alias("_any"), pointer.alias("t"))
    rows = rows.withColumns({"_p": F.upper("t.paragraph_id"), "_s": F.coalesce("t.stk_number", F.lit(1)), "_n": F.col("t.nr_number"), "_top": F.array_max("t.sentence_numbers")})
    u = units.select(F.upper("paragraph_id").alias("_up"), F.col("stk_number").alias("_us"), F.col("nr_number").alias("_un"), F.size("sentences").alias("_size"))
    sections = u.select(F.col("_up").alias("_sp"), F.lit(True).alias("_section")).distinct()
    parts = u.select(F.col("_up").alias("_pp"), F.col("_us").alias("_ps"), F.lit(True).alias("_part")).distinct()
    exact = u.groupBy("_up", "_us", "_un").agg(F.max("_size").alias("_size"))
    rows = rows.join(sections, F.col("_p") == F.col("_sp"), "left").join(parts, (F.col("_p") == F.col("_pp")) & (F.col("_s") == F.col("_ps")), "left")
    rows = rows.join(exact, (F.col("_p") == F.col("_up")) & (F.col("_s") == F.col("_us")) & F.col("_n").eqNullSafe(F.col("_un")), "left")
    bucket = (
        F.when(~F.col("_any"), "no target")
        .when(F.col("_p") == "", "unreadable")
        .when(F.col("_section").isNull(), "no section")
        .when(F.col("_part").isNull(), "no subsection")
        .when(F.col("_size").isNull(), "no item")
        .when(F.col("_top") > F.col("_size"), "sentence out of range")
        .otherwise("found")
    )
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


# --- case facts -----------------------------------------------------------------------------------


def work_countries(facts: Column) -> Column:
    """Countries of a map of country to days, blank ones left out, equal but for case once, sorted."""
    return F.array_sort(refs.distinct_folded(F.filter(F.map_keys(facts), lambda c: F.trim(c) != "")))


def pruned_days(days: Column, countries: Column) -> Column:
    """A map of days without countries that are no longer named."""
    named = F.transform(countries, lambda c: F.lower(F.trim(c)))
    return F.map_filter(days, lambda c, _: F.array_contains(named, F.lower(F.trim(c))))


def decision_fact(key: str, value: Column, source: str = "ui", origin: str = "oplyst", certainty: str = "middel") -> Column:
    """A fact of a case, active where it has a value."""
    text = F.trim(value.cast("string"))
    given = F.coalesce(text, F.lit("")) != ""
    return F.struct(
        F.lit(key).alias("fact_key"), F.when(given, text).alias("value"), F.lit(source).alias("source"), F.lit(origin).alias("origin"), F.lit(certainty).alias("certainty"), F.when(given, "aktiv").otherwise("uafklaret").alias("status")
    )
