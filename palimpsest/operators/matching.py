"""Similarity, overlap and structured lookups."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from palimpsest.functions.text import fingerprint, match_text, spaced_words, words
from palimpsest.operators.ordering import first_wins
from palimpsest.session import spool

MATCH_THRESHOLD = 0.9
LETTERS = "abcdefghijklmnopqrstuvwxyzæøå0123456789"
RUN_WORDS = 8
GRAM = 3  # characters of the stretches by which names are found


@F.pandas_udf(DoubleType())
def sequence_ratio(candidate: pd.Series, wanted: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, candidate first."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in zip(candidate, wanted, strict=True)])


def _longest(first: str | None, second: str | None) -> int:
    """Length of the longest run of words that both have: of each run that goes on, where it ends in the second."""
    a, b = (first or "").split(), (second or "").split()
    if not a or not b or set(a).isdisjoint(b):
        return 0
    places: dict = {}
    for j, item in enumerate(b):
        places.setdefault(item, []).append(j)
    best, ends = 0, {}
    for item in a:
        ends = {j: ends.get(j - 1, 0) + 1 for j in places.get(item, ())}
        if ends:
            best = max(best, *ends.values())
    return best


@F.arrow_udf(IntegerType())
def longest_run(first: pa.Array, second: pa.Array) -> pa.Array:
    """Longest run of words that two texts, of words parted by spaces, share."""
    return pa.array([_longest(a, b) for a, b in zip(first.to_pylist(), second.to_pylist(), strict=True)], pa.int32())


def letter_counts(text: Column) -> Column:
    """How often each of ``LETTERS`` is in a text, then how many other characters it has."""
    each = [F.length(text) - F.length(F.translate(text, c, "")) for c in LETTERS]
    return F.array(*each, F.length(F.translate(text, LETTERS, "")))


def _grams(text: Column, n: int) -> Column:
    """Distinct stretches of n characters; of shorter texts none."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def best_match(wanted: DataFrame, proposed: DataFrame, block: Sequence[str], *, wanted_id: str, proposed_id: str, text: str = "text", least: float = MATCH_THRESHOLD) -> DataFrame:
    """For each wanted row the most similar proposed row of its block: wanted_id, proposed_id, ratio.

    Equal fingerprints need no comparison; only what has no equal is compared, and only in its block, and
    only where lengths and the letters that both have allow the ratio at all: a match can't hold more of a letter than
    either text. Then the pairs of neighbouring letters are counted: what isn't matched, x characters of one text and y of
    the other, breaks at most 2x of its pairs and adds at most y. A block's rows meet in pairs, so blocks are meant to be
    narrow. Of equal ratios the first proposed row wins.
    """
    w = wanted.select(*block, F.col(wanted_id).alias("_w"), fingerprint(text).alias("_a")).withColumns({"_la": letter_counts(F.col("_a")), "_ga": _grams(F.col("_a"), 2)})
    p = proposed.select(*block, F.col(proposed_id).alias("_p"), fingerprint(text).alias("_b")).withColumns({"_lb": letter_counts(F.col("_b")), "_gb": _grams(F.col("_b"), 2)})
    same = w.join(p.withColumnRenamed("_b", "_a"), [*block, "_a"]).select("_w", "_p", F.lit(1.0).alias("ratio"))
    rest = w.join(same.select("_w").distinct(), "_w", "left_anti")
    short, long = F.least(F.length("_a"), F.length("_b")), F.greatest(F.length("_a"), F.length("_b"))
    both = F.aggregate(F.zip_with("_la", "_lb", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    possible = (2.0 * short >= F.lit(least) * (short + long)) & (2.0 * both >= F.lit(least) * (short + long))
    # Repeated pairs of letters count once in the arrays, so as many as either text repeats may be missing there.
    repeats = F.least(F.length("_a") - 1 - F.size("_ga"), F.length("_b") - 1 - F.size("_gb"))
    kept = F.length("_a") - 1 - 2 * F.length("_a") - F.length("_b") + 1.5 * F.lit(least) * (short + long)
    alike = F.when(kept - repeats > 0, F.size(F.array_intersect("_ga", "_gb")) >= kept - repeats - 1e-9).otherwise(True)
    near = rest.join(p, list(block)).where(possible & alike).select("_w", "_p", sequence_ratio("_b", "_a").alias("ratio"))
    found = same.unionByName(near.where(F.col("ratio") >= least))
    best = first_wins(found, ["_w"], -F.col("ratio"), "_p")
    return best.select(F.col("_w").alias(wanted_id), F.col("_p").alias(proposed_id), "ratio")


def shingles(df: DataFrame, key: str, text: str, n: int = RUN_WORDS) -> DataFrame:
    """key, h1, h2: runs of n words as they follow each other, as two hashes of 64 bits of their words' hashes."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    w = df.select(key, hashed.alias("_h")).where(F.size("_h") >= n)

    def run(i: Column) -> Column:
        parts = [F.get("_h", i + k) for k in range(n)]
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(n), *reversed(parts)).alias("h2"))

    runs = F.transform(F.sequence(F.lit(0), F.size("_h") - n), run)
    return w.select(key, F.explode(runs).alias("run")).select(key, "run.h1", "run.h2")


def shared_runs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text", n: int = RUN_WORDS) -> DataFrame:
    """Pairs that share a run of n words or more: left_id, right_id, shared (distinct runs of n).

    A run of n or more is the same as a common shingle of n, so this is an equi-join. ``right`` is meant to be the
    smaller side: its runs are written, so that Spark knows their size and, while they are small, sends them to ``left``
    rather than shuffling all of ``left``'s. Repeated runs of a text are told apart only among what was matched. Of a run
    that is common on one side all pairs are wanted, so the result is as large as that.
    """
    runs = spool(shingles(right, right_id, text, n).distinct(), "runs")
    matched = shingles(left, left_id, text, n).join(runs, ["h1", "h2"]).select(left_id, right_id, "h1", "h2").distinct()
    return matched.groupBy(left_id, right_id).agg(F.count("*").alias("shared"))


def flat(note_text: str | Column) -> Column:
    """A note upper-cased and without white space, in which sections are looked for; empty of no note."""
    note = F.col(note_text) if isinstance(note_text, str) else note_text
    return F.upper(F.regexp_replace(F.coalesce(note, F.lit("")), r"(?U)\s+", ""))


#: Fixed value: stands for a section's name while what follows it is looked at.
MARK = "\x01"


def _mentioned(held: Column, section: Column) -> Column:
    """Somewhere no letter or digit follows the section's name. A pattern made from each row's section would be compiled
    for each row; that way only rows go where names may overlap or the mark stands for itself."""
    name = F.concat(F.lit("§"), F.upper(section))
    odd = F.contains(section, F.lit("§")) | F.contains(held, F.lit(MARK))
    own = F.rlike(held, F.concat(F.lit("§\\Q"), F.upper(section), F.lit("\\E(?![\\p{L}\\p{N}])")))
    return F.when(odd, own).otherwise(F.rlike(F.replace(held, name, F.lit(MARK)), F.lit(MARK + r"(?![\p{L}\p{N}])")))


def confirmation(change_text: Column, note_text: Column, section: Column, run_words: int = RUN_WORDS, held: Column | None = None) -> Column:
    """struct(how, run, checkable, exact_mention): whether a note is about the change it was found for.

    It names the section (as a substring; ``exact_mention``: no letter follows), or shares a run of words
    with the change; otherwise it is suspect if the change quotes text that a note would repeat. ``held``: ``flat`` of the
    note, best a column, found once.
    """
    from palimpsest.functions.text import quotes_real_text

    found = F.coalesce(note_text, F.lit("")) != ""
    held = flat(note_text) if held is None else held
    named = F.contains(held, F.concat(F.lit("§"), F.upper(section)))
    exact = F.when(named, _mentioned(held, section)).otherwise(named)
    run = F.when(found & ~named, longest_run(spaced_words(F.when(found & ~named, change_text)), spaced_words(F.when(found & ~named, note_text))))
    how = F.when(found & named, "section named").when(run >= run_words, "words repeated")
    checkable = F.when(~found, False).when(how.isNotNull(), True).otherwise(quotes_real_text(change_text))
    return F.struct(how.alias("how"), F.coalesce(run, F.lit(0)).alias("run"), checkable.alias("checkable"), (found & exact).alias("exact_mention"))


# --- structured lookups ---------------------------------------------------------------------------


def token_search(haystack: Column, query: str) -> Column:
    """All tokens of a query occur, accents and case apart; an empty query fits everything."""
    import unicodedata

    plain = "".join(ch for ch in unicodedata.normalize("NFKD", query) if not unicodedata.combining(ch)).lower()
    out = F.lit(True)
    for t in plain.split():
        out = out & F.contains(match_text(haystack), F.lit(t))
    return out


def parse_catalog_query(query: str, hints: dict[str, str]) -> dict:
    """id_prefix, article and tokens of a catalog query: the longest hint that occurs, an article's number
    (said, alone, or glued to the hint), and what remains in tokens of two characters or more."""
    import re

    q = " ".join(query.lower().split())
    term = max((t for t in hints if t in q), key=lambda t: (len(t), -list(hints).index(t)), default="")
    said = re.search(r"\b(?:artikel|art\.?)\s*(\d+)", q) or re.fullmatch(r"(\d+)", q)
    glued = re.search(re.escape(term) + r"\s*(\d+)", q) if term else None
    rest = q.replace(term, " ") if term else q
    alone = re.fullmatch(r"\D*\b(\d+)\b\D*", rest) if not said and not glued else None
    number = next((int(m[1]) for m in (said, glued, alone) if m), None)
    drop = {"artikel", "art", "art."} | ({str(number)} if number is not None else set())
    tokens = [t for t in re.split(r"[^\w]+", rest) if len(t) >= 2 and t not in drop]
    return {"id_prefix": hints.get(term), "article": number, "tokens": tokens}


def catalog_search(sections: DataFrame, parsed: dict, *, id_col: str = "source_id", article: str = "article", text: str = "haystack") -> DataFrame:
    """Sections that fit a parsed query: by id prefix and article, then all tokens."""
    out = sections
    if parsed["id_prefix"]:
        out = out.where(F.col(id_col).startswith(parsed["id_prefix"]))
    if parsed["article"] is not None:
        out = out.where(F.col(article) == parsed["article"])
    for t in parsed["tokens"]:
        out = out.where(F.contains(F.lower(text), F.lit(t)))
    return out


def contains_join(rows: DataFrame, files: DataFrame, row_id: str, needles: Sequence[str | Column], name: str) -> DataFrame:
    """For each row the first file, by name, whose name holds one of its needles anywhere, upper and lower case alike.

    Needles of up to three characters are looked up among the stretches of that length, each with its first name. A longer
    one meets the names that hold the rarest of its stretches of three, and these are looked at; one that has a stretch
    which no name holds meets none. Needles and names may have any length.

    Null and empty needles are none, null names no files; of rows with one id any needle counts; null ids find like others.
    """
    as_column = lambda n: F.col(n) if isinstance(n, str) else n
    tried = rows.select(F.col(row_id).alias("_id"), F.explode(F.array(*[F.lower(as_column(n)) for n in needles])).alias("_needle"))
    tried = spool(tried.where(F.length("_needle") > 0).distinct(), "needles")
    named = files.select(F.col(name).alias("_name"), F.lower(name).alias("_low")).where("_name is not null").distinct()
    wide = F.least(F.length("_needle"), F.lit(GRAM))
    widths = [r[0] for r in tried.select(wide).distinct().collect()]  # three numbers at most
    every = F.flatten(F.array(*[_grams(F.col("_low"), n) for n in sorted(widths)])) if widths else F.array().cast("array<string>")
    held = spool(named.select("_name", "_low", F.explode(every).alias("_gram")), "name-grams")
    known = spool(held.groupBy("_gram").agg(F.count("*").alias("_names"), F.min("_name").alias("_first")), "gram-counts")
    short = tried.where(F.length("_needle") <= GRAM).join(known, F.col("_needle") == F.col("_gram")).select("_id", F.col("_first").alias("_name"))
    long = tried.where(F.length("_needle") > GRAM).select("_needle").distinct()
    parts = long.select("_needle", F.size(_grams(F.col("_needle"), GRAM)).alias("_of"), F.explode(_grams(F.col("_needle"), GRAM)).alias("_gram"))
    rarest = parts.join(known, "_gram").groupBy("_needle", "_of").agg(F.count("*").alias("_found"), F.min(F.struct("_names", "_gram"))["_gram"].alias("_gram"))
    seen = rarest.where("_found = _of").select("_needle", "_gram").join(held, "_gram").where(F.contains("_low", F.col("_needle")))
    found = tried.join(seen.groupBy("_needle").agg(F.min("_name").alias("_name")), "_needle").select("_id", "_name").unionByName(short)
    return found.groupBy(F.col("_id").alias(row_id)).agg(F.min("_name").alias(name))


def coverage(wanted: DataFrame, touched: DataFrame, key: str, **also: Column) -> DataFrame:
    """key, verdict, items: of each wanted key whether items touch it, found it only as inserted, or miss it.

    ``touched``: key, as_target (boolean). Keys compare upper-cased. ``also``: aggregates of the touching rows, by name,
    found in the same pass; null where there are none.
    """
    t = touched.groupBy(F.upper(key).alias("_k")).agg(F.count("*").alias("items"), F.bool_or("as_target").alias("_t"), *[c.alias(n) for n, c in also.items()])
    lettered = F.rlike(F.upper(key), F.lit(r"^\d+[A-ZÆØÅ]\z"))
    rows = wanted.select(key).distinct().join(t, F.upper(key) == F.col("_k"), "left")
    verdict = F.when(F.col("items").isNull(), F.when(lettered, "missing_lettered").otherwise("missing")).when(F.col("_t"), "found").otherwise("only_inserted")
    return rows.select(key, verdict.alias("verdict"), F.coalesce("items", F.lit(0)).alias("items"), *also)
