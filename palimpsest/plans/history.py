"""Histories of sections: which acts changed a section, and what their bills said about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import refs
from palimpsest.operators import graph, matching, ordering
from palimpsest.operators.ordering import first_wins
from palimpsest.operators.postings import Index
from palimpsest.sources import lawxml

WHOLE, INSERTED = "hele paragraffen", "hele paragraffen — indsat"


def chain(consolidations: DataFrame, starts: DataFrame, max_steps: int = 40) -> DataFrame:
    """start, node, depth: consolidations from the newest back. ``consolidations``: of ``lawxml``."""
    edges = consolidations.where("previous is not null and previous <> eli").select(F.col("eli").alias("src"), F.col("previous").alias("dst"))
    return graph.walk(edges, starts, max_steps)


def listed_amendments(consolidations: DataFrame) -> DataFrame:
    """eli, seq, document_path, paragraph."""
    return consolidations.select("eli", F.posexplode("amendments").alias("seq", "_a")).select("eli", "seq", "_a.document_path", "_a.paragraph")


def places(items: DataFrame, section: Column) -> Column:
    """array of struct(place, sentences) at which an item touches a section; none: empty."""
    targets = F.transform("probable_targets", lambda t: refs.target(t))
    hits = F.filter(targets, lambda t: F.upper(t["paragraph_id"]) == section)
    named = F.transform(
        hits,
        lambda t: F.struct(
            F.when(F.coalesce(t["stk_number"], F.lit(0)) != 0, F.concat(F.lit("stk. "), t["stk_number"].cast("string"))).otherwise(WHOLE).alias("place"),
            F.array_join(F.transform(t["sentence_numbers"], lambda n: F.concat(n.cast("string"), F.lit(". pkt."))), ", ").alias("sentences"),
        ),
    )
    inserted = F.array(F.struct(F.lit(INSERTED).alias("place"), F.lit("").alias("sentences")))
    return F.when(F.size(named) > 0, named).when(F.array_contains("inserted", section), inserted).otherwise(F.filter(named, lambda _: F.lit(False)))


def changes(docs: DataFrame, asked: DataFrame, law: str, max_steps: int = 8) -> DataFrame:
    """Changes of the asked sections (start, section), newest first by the act's year and number.

    start, section, consolidation, document_path, amendment_path, text, places, inserted, year, number. An
    act counts once, at the newest consolidation that lists it.
    """
    said = lawxml.consolidations(docs)
    path = chain(said, asked.select("start").distinct(), max_steps)
    acts = graph.amendments_along(path, listed_amendments(said))
    items = lawxml.instructions(docs, law)
    own = F.regexp_extract("amendment_path", r"§\s*(\d+),", 1).try_cast("int")
    rows = acts.join(items, acts["document_path"] == items["eli"]).where((F.col("paragraph") == 0) | (own == F.col("paragraph")))
    rows = rows.join(asked, "start").withColumn("section", refs.normal_section("section"))
    rows = rows.withColumn("places", places(rows, F.col("section"))).where(F.size("places") > 0)
    parts = F.split("document_path", "/")
    return rows.select(
        "start", "section", F.col("node").alias("consolidation"), "document_path", "amendment_path", F.col("ord").alias("item_ord"), "text", "places",
        (F.get("places", F.lit(0))["place"] == INSERTED).alias("inserted"),
        F.try_element_at(parts, F.lit(-2)).try_cast("int").alias("year"), F.try_element_at(parts, F.lit(-1)).try_cast("int").alias("number"), "depth", "seq",
    )


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("year"), F.desc("number"), "depth", "seq", "item_ord")


def by_place(rows: DataFrame) -> DataFrame:
    """start, section, place, changes: how many changes touched each place, "whole" first when ordered."""
    flat = rows.select("start", "section", F.explode("places").alias("p"))
    return flat.groupBy("start", "section", F.col("p.place").alias("place")).agg(F.count("*").alias("changes")).orderBy("start", "section", ~F.col("place").startswith("hele"), "place")


def bills_of(acts: DataFrame, bills: DataFrame) -> DataFrame:
    """Acts (document_path, law_number, law_date) with their bill (id, number, period), the first by id: a
    law's number alone isn't unique, so the date is part of the key."""
    b = bills.select("id", "lovnummer", "lovnummerdato", F.col("nummernumerisk").alias("bill_number"), "period")
    hit = acts.join(b, (F.col("law_number") == F.col("lovnummer")) & (F.to_date("law_date") == F.to_date("lovnummerdato")), "left")
    one = first_wins(hit, ["document_path"], "id")
    return one.withColumn("accession", refs.accession(F.col("period"), F.col("bill_number")))


#: Why a change has no note, as it is told.
NO_BILL, UNREAD = "lovforslaget findes ikke i Folketingets data", "L %s kunne ikke hentes"
NOT_IN_BILL, NO_NOTE = "punktet findes ikke i L %s", "L %s har ingen bemærkning til punktet"
AMENDED = "punktet findes ikke i L %s som fremsat, men der blev stillet ændringsforslag (%s). Bemærkningen står i %s, som Folketinget kun udgiver som PDF, vi ikke kan hente"
UNAMENDED = "punktet findes ikke i L %s, og der blev ikke stillet ændringsforslag på sagen. Årsagen er ukendt"
THE_REPORT = "betænkningen"


def _not_in_bill(number: Column, asked: bool) -> Column:
    """Why a bill hasn't the item: an amendment in committee if one was moved, else nothing that is known."""
    if not asked:
        return F.format_string(NOT_IN_BILL, number)
    moved = F.format_string(AMENDED, number, F.get("amendment_titles", F.lit(0)), F.coalesce(F.nullif("report_title", F.lit("")), F.lit(THE_REPORT)))
    return F.when(F.col("explains").isNull(), F.format_string(NOT_IN_BILL, number)).when(F.col("explains"), moved).otherwise(F.format_string(UNAMENDED, number))


def notes_for(rows: DataFrame, acts: DataFrame, bills: DataFrame, bill_docs: DataFrame, law: str, committee: DataFrame | None = None) -> DataFrame:
    """Changes with the note of their bill: note, precise, realigned, problem, confirmation.

    ``committee``: of each bill's case (id) what ``survey.committee_stage`` says. A change that its bill hasn't is then put down
    to an amendment in committee where one was moved, and ``report_title`` and ``report_url`` say where its reasons are.

    An item is found again in the bill by its text, since its numbers may differ there; its note is looked
    up by the bill's own numbers, else that of the whole section, which isn't precise.
    """
    keyed = rows.withColumn("change_id", F.concat_ws("|", "start", "section", "document_path", "amendment_path", F.col("item_ord").cast("string")))
    with_bill = keyed.join(bills_of(acts, bills).select("document_path", F.col("id").alias("case_id"), "bill_number", "accession"), "document_path", "left")
    proposed = lawxml.instructions(bill_docs, law).select(F.regexp_extract("eli", r"([^/]+)\z", 1).alias("accession"), "ord", "text", "act_number", F.regexp_replace("item_number", r"\.\z", "").alias("item_number"))
    proposed = proposed.withColumn("proposed_id", F.struct("ord", "act_number", "item_number"))
    match = matching.best_match(with_bill.where("accession is not null").select("accession", "change_id", "text"), proposed, ["accession"], wanted_id="change_id", proposed_id="proposed_id")
    at = match.select("change_id", F.col("proposed_id.act_number").try_cast("int").alias("_p"), F.col("proposed_id.item_number").try_cast("int").alias("_i"))
    notes = lawxml.explanatory_notes(bill_docs).select(F.regexp_extract("eli", r"([^/]+)\z", 1).alias("accession"), "paragraph", "item", F.col("text").alias("_note"))
    found = with_bill.join(at, "change_id", "left")
    own = notes.withColumnsRenamed({"paragraph": "_p", "item": "_i", "_note": "_own"})
    whole = notes.where("item = 0").select("accession", F.col("paragraph").alias("_p"), F.col("_note").alias("_whole"))
    found = found.join(own, ["accession", "_p", "_i"], "left").join(whole, ["accession", "_p"], "left")
    here = bill_docs.select(F.regexp_extract("eli", r"([^/]+)\z", 1).alias("accession"), F.lit(True).alias("_here")).distinct()
    found = found.join(here, "accession", "left")
    law_p, law_i = (F.regexp_extract("amendment_path", r"§\s*(\d+), nr\. (\d+)", g).try_cast("int") for g in (1, 2))
    if committee is not None:
        stage = committee.select(F.col("id").alias("case_id"), "report_title", "report_url", "amendment_titles", "explains")
        found = found.join(first_wins(stage, ["case_id"], "report_title"), "case_id", "left")
    number = F.col("bill_number").cast("string")
    problem = (
        F.when(F.col("accession").isNull(), NO_BILL)
        .when(F.col("_here").isNull(), F.format_string(UNREAD, number))
        .when(F.col("_p").isNull(), _not_in_bill(number, committee is not None))
        .when(F.coalesce("_own", "_whole").isNull(), F.format_string(NO_NOTE, number))
    )
    out = found.withColumns(
        {
            "note": F.coalesce("_own", "_whole", F.lit("")),
            "precise": F.col("_own").isNotNull(),
            "realigned": F.when((F.col("_p") != law_p) | (F.col("_i") != law_i), F.format_string("forslagets § %d, nr. %d", "_p", "_i")),
            "problem": problem,
        }
    )
    out = out.withColumn("_flat", matching.flat("note"))
    return out.withColumn("confirmation", matching.confirmation(F.col("text"), F.col("note"), F.col("section"), held=F.col("_flat"))).drop("_p", "_i", "_own", "_whole", "_here", "_flat")


def summary(noted: DataFrame) -> DataFrame:
    """start, section, changes, with_note, confirmed, suspect."""
    ok = F.col("confirmation.how").isNotNull()
    return noted.groupBy("start", "section").agg(
        F.count("*").alias("changes"), F.count_if(F.col("note") != "").alias("with_note"), F.count_if(ok).alias("confirmed"), F.count_if(~ok & F.col("confirmation.checkable")).alias("suspect")
    )


def mining(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(constructions, totals) of items: each construction with its share of items (shares sum to more than
    one), and counts of items, acts, items with several targets, by kind of markup."""
    # An item counts once under the names it has, taken together, and these counts are few: items are read once.
    kinds = items.groupBy("constructions").agg(F.count("*").alias("n"))
    kinds = kinds.select("constructions", "n", F.sum("n").over(Window.partitionBy()).alias("_n"))  # a row for each set of names
    hist = kinds.select(F.explode("constructions").alias("construction"), "n", "_n").groupBy("construction", "_n").agg(F.sum("n").alias("items"))
    hist = hist.select("construction", "items", (F.col("items") / F.col("_n")).alias("share"))
    markup = F.col("target_markup")
    totals = items.agg(
        F.count("*").alias("items"), F.countDistinct("eli").alias("acts"), F.count_if(F.size("targets") > 1).alias("several_targets"),
        F.count_if(markup == "signi_char").alias("marked"), F.count_if(markup == "italic").alias("italic"), F.count_if(markup == "none").alias("unmarked"),
    )
    return hist, totals


def leaks(changed_by: DataFrame, seen: DataFrame, unincorporated: DataFrame, newest_year: int) -> DataFrame:
    """Acts said to change a law that no consolidation lists: document_path, excuse (null: a leak)."""
    lost = changed_by.select("document_path").distinct().join(seen.select("document_path").distinct(), "document_path", "left_anti")
    excused = unincorporated.select("document_path", F.lit(True).alias("_said")).distinct()
    year = F.try_element_at(F.split("document_path", "/"), F.lit(-2)).try_cast("int")
    excuse = F.when(year > newest_year, "newer").when(F.col("_said").isNotNull(), "declared")
    return lost.join(excused, "document_path", "left").select("document_path", excuse.alias("excuse"))


def touched_sections(items: DataFrame) -> DataFrame:
    """section, as_target: what items point at or insert, for ``matching.coverage``."""
    named = F.transform("probable_targets", lambda t: F.struct(F.upper(refs.target(t)["paragraph_id"]).alias("section"), F.lit(True).alias("as_target")))
    fresh = F.transform("inserted", lambda s: F.struct(s.alias("section"), F.lit(False).alias("as_target")))
    return items.select(F.explode(F.array_distinct(F.concat(named, fresh))).alias("x")).select("x.*").where("section <> ''")


def section_postings(items: DataFrame) -> DataFrame:
    """section, eli, as_target, ord, amendment_path, text: one row for each section that an item points at or inserts.

    A section that an item both points at and inserts is a target, as ``places`` has it.
    """
    named = F.array_distinct(F.filter(F.transform("probable_targets", lambda t: F.upper(refs.target(t)["paragraph_id"])), lambda s: s != ""))
    fresh = F.array_except(F.transform("inserted", lambda s: F.upper(s)), F.col("_named"))
    both = F.concat(F.transform("_named", lambda s: F.struct(s.alias("section"), F.lit(True).alias("as_target"))), F.transform(fresh, lambda s: F.struct(s.alias("section"), F.lit(False).alias("as_target"))))
    rows = items.withColumn("_named", named).select("eli", "ord", "amendment_path", "text", F.explode(both).alias("x"))
    return rows.select("x.section", "eli", "x.as_target", "ord", "amendment_path", "text").where("section <> ''")


def section_index(spark: SparkSession, folder: str) -> Index:
    """The index from sections to the items that touch them, in ``folder``; ``index_acts`` fills it."""
    return Index(spark, folder, term="section", doc="eli")


def index_acts(index: Index, docs: DataFrame, law: str, withdrawn: DataFrame | None = None, buckets: int = 64) -> None:
    """Add acts (eli, body), or put them in place of what was known of them, and take out ``withdrawn`` ones (eli)."""
    spoken_for = docs.select("eli") if withdrawn is None else docs.select("eli").unionByName(withdrawn.select("eli"))
    index.update(section_postings(lawxml.instructions(docs, law)), spoken_for, buckets)


def survey(index: Index, wanted: DataFrame, changed_by: DataFrame, unincorporated: DataFrame, newest_year: int) -> tuple[DataFrame, DataFrame]:
    """(sections, totals) of a law, read from the index: how far its changes can be found.

    sections: each wanted section (``section``) with its verdict (``matching.coverage``), how many items touch it, and the
    first of these, by act and place. totals, one row: sections, found ones, ones found only as inserted, missing ones and
    of these lettered ones, which must have been inserted; items, acts; acts that are said to change the law
    (``changed_by``: document_path) and aren't in the index, and those of them without an excuse.
    """
    held = index.postings()
    covered = matching.coverage(wanted, held, "section", _f=F.min(F.struct("eli", "ord", "amendment_path")))  # postings are read once
    rows = covered.select("section", "verdict", "items", F.concat_ws(" ", "_f.eli", "_f.amendment_path").alias("first_item"))
    lost = leaks(changed_by, index.documents().select(F.col("eli").alias("document_path")), unincorporated, newest_year)
    of = lambda *kinds: F.count_if(F.col("verdict").isin(*kinds))
    counted = rows.agg(
        F.count("*").alias("sections"), of("found", "only_inserted").alias("found"), of("only_inserted").alias("only_inserted"),
        of("missing", "missing_lettered").alias("missing"), of("missing_lettered").alias("missing_lettered"),
    )
    items = held.agg(F.count("*").alias("items"), F.countDistinct("eli").alias("acts"))
    outside = lost.agg(F.count("*").alias("outside"), F.count_if(F.col("excuse").isNull()).alias("unexplained"))
    return rows, counted.crossJoin(F.broadcast(items)).crossJoin(F.broadcast(outside))  # a row each


def examples(rows: DataFrame, kind: str, label: str, k: int = 5) -> DataFrame:
    """kind, n, examples: each class with the number of its rows and its first k labels, comma-separated."""
    first = ordering.least_rows(rows.select(kind, label), [kind], [label], k)
    each = [F.max(F.when(F.col("place") == i, F.col(label).cast("string"))) for i in range(1, k + 1)]
    return first.groupBy(kind).agg(F.max("rows").alias("n"), F.concat_ws(", ", *each).alias("examples"))


def segmentation(units: DataFrame) -> DataFrame:
    """How well sentences are told apart: blocks, sentences, blocks of several, units whose own references
    name more sentences than they have."""
    from palimpsest.functions.text import sentences

    several = F.aggregate("lineas", F.lit(0), lambda a, x: a + F.when(F.size(sentences(x)) > 1, 1).otherwise(0))
    named = refs.highest_referenced_sentence(F.col("text"))
    rows = units.select(F.size("lineas").alias("b"), F.size("sentences").alias("s"), several.alias("m"), named.alias("h"))
    return rows.agg(
        F.sum("b").alias("blocks"), F.sum("s").alias("sentences"), F.sum("m").alias("several"),
        F.count_if(F.col("h") > 0).alias("checkable"), F.count_if(F.col("h") > F.col("s")).alias("conflicts"),
    )


def serialised(noted: DataFrame) -> DataFrame:
    """Changes as JSON with a context block to read."""
    where = F.array_join(F.transform("places", lambda p: F.concat_ws(", ", p["place"], F.nullif(p["sentences"], F.lit("")))), "; ")
    caveat = F.when(F.col("note") == "", F.concat(F.lit("Ingen bemærkning: "), F.coalesce("problem", F.lit("ukendt")))).when(~F.col("precise"), "Bemærkningen gælder hele paragraffen.")
    block = F.concat_ws("\n", F.concat(F.col("document_path"), F.lit(" "), F.col("amendment_path")), where, "text", F.nullif("note", F.lit("")), caveat)
    return noted.select("start", "section", "year", "number", F.to_json(F.struct("document_path", "amendment_path", "places", "inserted", "note", "precise", "realigned", "problem", block.alias("context"))).alias("json"))
