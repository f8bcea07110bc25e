"""A catalog of law files: what their names and first pages say, aliases, order and search results.

All column expressions over file listings; a listing has a row a file and is read as any table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import col, collapse, match_text, strip
from palimpsest.operators.ordering import first_wins, numbered

#: Names of countries as folders and first pages write them, and their codes.
COUNTRIES = (
    ("danmark", "dk"), ("tyskland", "de"), ("sverige", "se"), ("norge", "no"), ("finland", "fi"), ("faeroeerne", "fo"), ("feroeerne", "fo"), ("island", "is"),
)
#: The Nordic convention's names, code and countries; aliases of any convention.
NORDIC_NAMES, NORDIC = ("norden", "nordiske lande"), "norden"
NORDIC_COUNTRIES = ("norge", "sverige", "finland", "island", "færøerne", "grønland")
CONVENTION = ("dbo", "dobbeltbeskatningsoverenskomst")
#: Forms of identifiers.
SESSION_ID, SOURCE_ID = r"^[a-zA-Z0-9_-]{8,80}\z", r"^[a-z0-9_]{5,160}\z"


def section_of(name: str | Column) -> Column:
    """struct(kind, number, label): article with its number, protocol, or document."""
    low = F.lower(col(name))
    number = F.nullif(F.regexp_extract(low, r"(?U)artikel\s*(\d+)", 1), F.lit("")).try_cast("int")
    protocol = F.contains(low, F.lit("protokol"))
    kind = F.when(number.isNotNull(), "article").when(protocol, "protocol").otherwise("document")
    label = F.when(number.isNotNull(), F.concat(F.lit("artikel "), number.cast("string"))).when(protocol, "protokol").otherwise("")
    return F.struct(kind.alias("kind"), number.alias("number"), label.alias("label"))


def title_suffix(name: str | Column) -> Column:
    """What a name's last parenthesis holds; empty without one at its end."""
    return strip(F.regexp_extract(strip(col(name)), r"(?U)\(([^()]*)\)\s*\z", 1))


def version_of(name: str | Column, default: str) -> Column:
    """v and the first date of eight digits, else the first year, of 1900 to 2099."""
    date, year = (F.regexp_extract(col(name), p, 1) for p in (r"((?:19|20)\d{6})", r"((?:19|20)\d{2})"))
    return F.when(date != "", F.concat(F.lit("v"), F.left(date, F.lit(4)))).when(year != "", F.concat(F.lit("v"), year)).otherwise(default)


def jurisdiction_of(*said: str | Column, default: str = "dk") -> Column:
    """The code of the countries that a folder and a first page name: the Nordic one before all; Denmark with another first."""
    text = match_text(F.concat_ws("\n", *[col(x) for x in said]))

    def hit(names: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in names])

    codes = sorted({c for _, c in COUNTRIES})
    found = F.array_compact(F.array(*[F.when(hit([n for n, c in COUNTRIES if c == code]), code) for code in codes]))
    pair = F.when((F.size(found) == 2) & F.array_contains(found, "dk"), F.concat(F.lit("dk-"), F.array_join(F.array_remove(found, "dk"), "")))
    return F.when(hit(NORDIC_NAMES), NORDIC).otherwise(F.coalesce(pair, F.when(F.size(found) > 0, F.array_join(found, "-")), F.lit(default)))


def source_id(prefix: Column, name: str | Column, version: Column) -> Column:
    """prefix, the article's two digits, protokol or the name's own words, and the version, by underscores."""
    section = section_of(name)
    slug = F.regexp_replace(F.regexp_replace(match_text(name), "[^a-z0-9]+", "_"), r"^_|_\z", "")
    middle = F.when(section["kind"] == "article", F.format_string("art%02d", section["number"])).when(section["kind"] == "protocol", "protokol").otherwise(slug)
    return F.concat_ws("_", prefix, middle, version)


def aliases(title: Column, code: Column, label: Column) -> Column:
    """What a file may be searched by: its convention's names, title, countries, pair of countries and section; each once."""
    other = F.regexp_extract(code, "^dk-(.*)", 1)
    pair = F.when(other != "", F.array(code, F.concat(F.lit("danmark "), other), F.concat(F.lit("dbo "), other)))
    section = F.when(label != "", F.array(label, F.replace(label, F.lit("artikel "), F.lit("art "))))
    none = F.array().cast("array<string>")
    every = F.concat(
        F.array(*[F.lit(x) for x in CONVENTION], title),
        F.when(code == NORDIC, F.array(*[F.lit(x) for x in NORDIC_COUNTRIES])).otherwise(none), F.coalesce(pair, none), F.coalesce(section, none),
    )
    return F.array_distinct(F.filter(F.transform(every, lambda x: collapse(F.lower(x))), lambda x: x != ""))


def file_rows(files: DataFrame, *, name: str = "name", folder: str = "folder", head: str = "head", title: str = "", default_version: str = "v1") -> DataFrame:
    """Rows of (folder, name, head: text of the first pages) as the catalog keeps them: source_id, title, jurisdiction,
    section, section_title, version, path, aliases. The id goes by the name alone, the section by the name, then the head."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*\z", "")
    rows = files.withColumns({"_stem": stem, "jurisdiction": jurisdiction_of(folder, head), "version": version_of(stem, default_version)})
    own, read = section_of("_stem"), section_of(F.coalesce(head, F.lit("")))
    section = F.when(own["kind"] != "document", own).otherwise(read)
    rows = rows.withColumns({"section": section, "section_title": title_suffix("_stem"), "title": F.lit(title)})
    rows = rows.withColumn("source_id", source_id(F.concat("jurisdiction", F.lit("_dbo")), F.col("_stem"), F.col("version")))
    path = F.concat_ws("/", F.lit("/documents/dbo"), "jurisdiction", "source_id", F.lit("source.pdf"))
    return rows.withColumns({"path": path, "aliases": aliases(F.col("title"), F.col("jurisdiction"), F.col("section.label"))}).drop("_stem")


def section_order(kind: str | Column, number: str | Column, label: str | Column) -> Column:
    """Articles by number, those whose number isn't one last, then protocols, then the rest by label."""
    n = F.when(F.lower(F.trim(col(kind))) == "article", F.coalesce(F.nullif(F.trim(col(number).cast("string")), F.lit("")), F.lit("0")).try_cast("int"))
    article = F.lower(F.trim(col(kind))) == "article"
    place = F.when(article, 0).when(F.lower(F.trim(col(kind))) == "protocol", 1).otherwise(2)
    return F.struct(place.alias("place"), F.when(article, F.coalesce(n, F.lit(9999))).otherwise(0).alias("number"), F.when(article & n.isNotNull(), "").otherwise(col(label)).alias("label"))


def nested(sections: DataFrame, instrument: str, source: str, kind: str, number: str, label: str) -> DataFrame:
    """instrument, sections: a catalog's sections nested under their instrument, in their order; written as JSON it is the
    file that a reader loads. An instrument has at most some thousand sections."""
    row = F.struct(section_order(kind, number, label).alias("o"), F.col(source).alias("id"), F.col(label).alias("label"))
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label")))
    return sections.groupBy(instrument).agg(listed.alias("sections"))


def ranked(hits: DataFrame, instrument: str, version: str, status: str, active: str = "active") -> DataFrame:
    """Search results with ``rank`` in their instrument: what is active first, then the newest version."""
    by = [F.desc(F.coalesce(F.col(status) == active, F.lit(False))), F.desc_nulls_last(version)]
    return numbered(hits, by, "rank", [instrument]).withColumn("rank", F.col("rank").cast("int"))


def labels_with(registry: DataFrame, label: str, term: str) -> DataFrame:
    """Registry rows whose label holds a term, without case."""
    return registry.where(F.contains(F.lower(label), F.lit(term.lower())))


def valid_id(value: str | Column, form: str = SESSION_ID) -> Column:
    """The stripped identifier; null if it isn't of the form."""
    clean = strip(F.coalesce(col(value), F.lit("")))
    return F.when(F.rlike(clean, F.lit(form)), clean)


def namespace_of(value: str | Column) -> Column:
    """What a source id has before _dbo_; null if it has none or isn't of an id's form."""
    clean = valid_id(F.lower(col(value)), SOURCE_ID)
    return F.nullif(F.regexp_extract(clean, "^(.*?)_dbo_", 1), F.lit(""))


def inspected(items: DataFrame, constructions: Sequence[str] = (), marks: Sequence[str] = (), search: str = "", *, names: str = "constructions", mark: str = "mark", text: str = "text") -> DataFrame:
    """Items that show one of some constructions, are marked up in one of some ways, and whose text a pattern fits without
    case; what isn't asked for doesn't filter."""
    out = items
    if constructions:
        out = out.where(F.exists(names, lambda c: F.rlike(c, F.lit("|".join(constructions)))))
    if marks:
        out = out.where(F.col(mark).isin(*marks))
    if search.strip():
        out = out.where(F.rlike(text, F.lit(f"(?iu){search.strip()}")))
    return out


#: Fixed value: the notice that an older version was asked for.
NEWER = "Der er kommet %d nyere udgave%s siden %s. Bruger %s."


def versions(chain: DataFrame, names: DataFrame) -> DataFrame:
    """Of walks from a known version to newer ones (start, node, depth) with ``names`` (node, label, date): start, newest,
    skipped, notice, versions (newest first). The notice says that an older version was asked for."""
    rows = chain.join(names, "node", "left")
    row = F.struct(F.col("depth"), F.col("node"), F.col("label"), F.col("date"))
    listed = F.reverse(F.array_sort(F.collect_list(row)))
    out = rows.groupBy("start").agg(listed.alias("versions")).withColumns({"newest": F.get("versions", F.lit(0))["node"], "skipped": F.size("versions") - 1})
    notice = F.format_string(NEWER, F.col("skipped"), F.when(F.col("skipped") > 1, "r").otherwise(""), F.col("start").cast("string"), F.col("newest").cast("string"))
    return out.select("start", "newest", "skipped", F.when(F.col("skipped") > 0, notice).otherwise("").alias("notice"), "versions")


def by_valid_from(rows: DataFrame, key: Sequence[str], valid_from: str) -> DataFrame:
    """Versions with ``place``: the latest validFrom first, compared as text."""
    return numbered(rows, F.desc_nulls_last(F.col(valid_from).cast("string")), "place", key).withColumn("place", F.col("place").cast("int"))


def first_pages(pages: DataFrame, document: str, page: str, text: str, most: int = 2) -> DataFrame:
    """document, head: the texts of a document's first pages."""
    rows = pages.where(F.col(page) < most).groupBy(document).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("_p"))
    return rows.select(document, F.array_join(F.transform("_p", lambda x: x[text]), "\n").alias("head"))


def shelved(rows: DataFrame, key: Sequence[str], kind: str, number: str, label: str) -> DataFrame:
    """The first section of each key, in the sections' order."""
    return first_wins(rows, key, section_order(kind, number, label))
