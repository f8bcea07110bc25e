"""Text functions as column expressions.

Java's regular expressions fold only ASCII under (?i) and know only ASCII white space and word
characters, so patterns here say (?iu) and (?U) wherever characters beyond ASCII count.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = ("jf.", "ca.", "f.eks.", "bl.a.", "litra", "art.", "kap.")
#: Characters that leave no trace in printed text, and those with a plain equivalent.
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"
PLAIN = {"\u00a0": " ", "\u2011": "-"}
#: Traces of text decoded by a wrong code page.
MOJIBAKE = ("Ã", "Â", "â")
#: Fixed value: a word, as (?iu)[0-9a-zæøå]+ has it; its letters written out, so that none has to be folded.
WORD = "[0-9A-Za-zæøåÆØÅ\u0130\u0131\u017f\u212a\u212b]+"
#: Marks that follow a word without a space.
NO_SPACE_BEFORE = ",.;:)!?"
#: Names of the classes of differences, in the order in which they are tried.
DIFFERENCES = (
    "ens",
    "kun mellemrum",
    "vi mangler tekst til sidst",
    "vi har for meget til sidst",
    "vi har tekst udenom facit",
    "facit har tekst udenom vores",
    "helt forskellig tekst",
    "forskel midt i teksten",
)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: str | Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+\z", "")


def collapse(text: str | Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def visible(text: str | Column) -> Column:
    """Element text: invisible characters gone, special spaces and hyphens plain, collapsed."""
    return collapse(F.translate(col(text), "".join(PLAIN) + INVISIBLE, "".join(PLAIN.values())))


def sentences(text: str | Column) -> Column:
    """Sentences end at a full stop before white space and a capital, unless an abbreviation ends there."""
    parts = F.split(col(text), r"(?U)(?<=\.)\s+(?=[A-ZÆØÅ])")
    goes_on = "(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r")\z"

    def step(done: Column, part: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), part)))
        return F.when(F.rlike(F.lower(last), F.lit(goes_on)), grown).otherwise(F.concat(done, F.array(part)))

    merged = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.filter(F.transform(merged, strip), lambda s: s != "")


def fingerprint(text: str | Column) -> Column:
    """Without a leading item number and any white space, lower-cased: equal for items that moved."""
    return F.lower(F.regexp_replace(F.regexp_replace(col(text), r"(?U)^\s*\d+\.\s*", ""), r"(?U)\s+", ""))


def tidy(text: str | Column) -> Column:
    """Runs of blanks as one, no white space before a comma, stop, semicolon or colon, stripped."""
    once = F.regexp_replace(col(text), r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(once, r"(?U)\s+([,.;:])", "$1"))


def join_after(anchor: str | Column, addition: str | Column) -> Column:
    """anchor then addition, with the space that quoting both leaves out."""
    a, b = col(anchor), col(addition)
    touching = (a == "") | (b == "") | a.endswith(" ") | b.startswith(" ") | F.left(b, F.lit(1)).isin(*NO_SPACE_BEFORE)
    return F.concat(a, F.when(touching, "").otherwise(" "), b)


def difference_class(ours: str | Column, theirs: str | Column, shared: int = 20) -> Column:
    """Name of how two texts differ; ``shared`` equal characters at the start count as one text."""
    a, b = col(ours), col(theirs)
    bare = lambda x: F.regexp_replace(x, r"(?U)\s", "")
    same_start = (F.length(a) >= shared) & (F.length(b) >= shared) & (F.left(a, F.lit(shared)) == F.left(b, F.lit(shared)))
    tests = [a == b, bare(a) == bare(b), b.startswith(a), a.startswith(b), F.contains(a, b), F.contains(b, a), ~same_start]
    out = F.lit(DIFFERENCES[-1])
    for test, name in reversed(list(zip(tests, DIFFERENCES, strict=False))):
        out = F.when(test, name).otherwise(out)
    return out


def quotes_real_text(text: str | Column, words: int = 3) -> Column:
    """Some »quoted« stretch holds so many words of three letters or more."""
    quotes = F.regexp_extract_all(col(text), F.lit("»([^«»]+)«"), F.lit(1))
    return F.exists(quotes, lambda q: F.size(F.regexp_extract_all(q, F.lit("(?iu)[a-zæøå]{3,}"), F.lit(0))) >= words)


def words(text: str | Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0)), F.lower)


def spaced_words(text: str | Column) -> Column:
    """``words`` as one text, parted by spaces."""
    return F.lower(F.array_join(F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0)), " "))


def truncate(text: str | Column, most: int, mark: str = "") -> Column:
    """At most ``most`` characters, then the mark if anything was cut."""
    t = col(text)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit(mark))).otherwise(t)


def newlines(text: str | Column) -> Column:
    """Line ends of any system as \\n, at most one blank line in a row, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(col(text), "\r\n?", "\n"), "\n{3,}", "\n\n"))


def unwrap_lines(text: str | Column) -> Column:
    """Hard-wrapped lines joined: a hyphen at the end goes, a lower-case continuation follows a space."""
    joined = F.regexp_replace(col(text), r"(?<=\p{L})-\n(?=\p{Ll})", "")
    return F.regexp_replace(joined, r"(?<=[\p{L}\p{N},])\n(?=\p{Ll})", " ")


def safe_filename(name: str | Column) -> Column:
    return F.regexp_replace(col(name), r"[^A-Za-z0-9._-]", "_")


def without_suffix(name: str | Column, suffix: str = "pdf") -> Column:
    return F.regexp_replace(col(name), rf"(?i)\.{suffix}\z", "")


def drop_lines(text: str | Column, pattern: str) -> Column:
    """Without the lines that match, such as licence lines."""
    return F.array_join(F.filter(F.split(col(text), "\n"), lambda x: ~F.rlike(x, F.lit(pattern))), "\n")


def from_marker(text: str | Column, marker: str) -> Column:
    """What follows the marker's first occurrence; the whole text without one."""
    t = col(text)
    at = F.instr(t, marker)
    return F.when(at > 0, F.substring(t, at + len(marker), F.length(t))).otherwise(t)


def occurrences(text: str | Column, needle: str | Column) -> Column:
    """Non-overlapping occurrences; 0 of an empty needle."""
    t, n = col(text), F.lit(needle) if isinstance(needle, str) else needle
    return F.when(n == "", 0).otherwise(((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("int"))


def windows_around(text: str | Column, needle: str, around: int, most: int) -> Column:
    """The first ``most`` hits of a needle with up to ``around`` characters either side."""
    found = F.regexp_extract_all(col(text), F.lit(f"(?s).{{0,{around}}}\\Q{needle}\\E.{{0,{around}}}"), F.lit(0))
    return F.slice(found, 1, most)


def without_marks(text: str | Column, keep_markup: bool = False) -> Column:
    """An answer without private-use citation marks, quote and bold marks, and surplus blank lines."""
    out = F.regexp_replace(col(text), "(?s)\ue200filecite.*?\ue201", "")
    if not keep_markup:
        out = F.regexp_replace(out, r"(?m)^\s*>\s?", "")
        out = F.replace(F.regexp_replace(out, r"(?s)\*\*(.*?)\*\*", "$1"), F.lit("**"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), "\n{3,}", "\n\n")


def clean_answer(text: str | Column, keep_markup: bool = False) -> Column:
    """``without_marks``, with the traces of a wrong code page repaired, stripped."""
    return strip(mojibake_repaired(without_marks(text, keep_markup)))


# --- what Catalyst has no function for: Arrow-batched, skipped by rows that need it not -------------


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _accents_stripped(text: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return text.map(one, na_action="ignore")


def _plain(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^\p{ASCII}*\z"))


def match_text(text: str | Column) -> Column:
    """For matching: compatibility forms without accents (å becomes a; ø and æ stay), lower-cased, collapsed."""
    t = col(text)
    return collapse(F.lower(F.when(_plain(t), t).otherwise(_accents_stripped(F.when(~_plain(t), t)))))


def slug(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(match_text(text), "[^a-z0-9]+", "-"), r"^-|-\z", "")


@F.pandas_udf(StringType())
def _repaired(text: pd.Series) -> pd.Series:
    def marks(x: str) -> int:
        return sum(x.count(m) for m in MOJIBAKE)

    def one(x: str) -> str:
        readings = [x]
        for page in ("latin1", "cp1252"):
            try:
                readings.append(x.encode(page).decode("utf-8"))
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return unicodedata.normalize("NFC", min(readings, key=marks))

    return text.map(one, na_action="ignore")


def mojibake_repaired(text: str | Column) -> Column:
    """The reading with the fewest traces of a wrong code page, first of equals; text without traces as it is."""
    t = col(text)
    odd = F.rlike(t, F.lit("[" + "".join(MOJIBAKE) + "]"))
    return F.when(odd, _repaired(F.when(odd, t))).otherwise(t)
