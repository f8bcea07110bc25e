"""Amounts, shares and years, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import col, strip


def danish_amount(text: str | Column) -> Column:
    """'1.234,50' as a double: blanks and points dropped, the first comma is the decimal point, what
    follows the leading number is ignored; null without a number."""
    t = F.regexp_replace(F.regexp_replace(strip(col(text)), r"(?U)\s", ""), r"\.", "")
    return F.regexp_extract(F.regexp_replace(t, "^([^,]*),", "$1."), r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def danish_money(amount: str | Column) -> Column:
    """1234.5 as '1.234,50'."""
    return F.translate(F.format_number(col(amount), 2), ",.", ".,")


def leading_int(text: str | Column) -> Column:
    return F.regexp_extract(strip(col(text)), r"^([+-]?\d{1,9})", 1).try_cast("int")


def half_up(x: str | Column, digits: int) -> Column:
    """Rounded half towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(col(x) * scale + 0.5) / scale


def percent_label(part: str | Column, whole: str | Column) -> Column:
    """'33,33 %' with a decimal comma; empty if the whole isn't positive."""
    share = half_up(F.lit(100.0) * col(part) / F.nullif(col(whole), F.lit(0)), 2)
    return F.when(col(whole) > 0, F.concat(F.translate(F.format_string("%.2f", share), ".", ","), F.lit(" %"))).otherwise("")


def income_years(text: str | Column) -> Column:
    """Years of 1900 to 2099 in a text, ascending, each once."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?U)\b((?:19|20)\d{2})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def danish_list(xs: Column) -> Column:
    """'a, b og c'."""
    n = F.size(xs)
    return F.when(n <= 1, F.array_join(xs, "")).otherwise(
        F.concat(F.array_join(F.slice(xs, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" og "), F.element_at(xs, -1))
    )


def years_display(years: Column) -> Column:
    """'2023', '2022 og 2023' or '2022-2024'."""
    s = F.transform(years, lambda y: y.cast("string"))
    span = F.concat_ws("-", F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(-1)))
    return F.when(F.size(s) > 2, span).otherwise(danish_list(s))


def input_quality(unresolved: Column) -> Column:
    """Level by the number of unresolved points."""
    return F.when(unresolved >= 3, "lav").when(unresolved > 0, "middel").otherwise("høj")
