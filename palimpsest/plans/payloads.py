"""Cases whose facts differ from case to case: VARIANT columns instead of fixed structs.

Facts come as JSON objects of which no two need have the same fields. They are parsed once into VARIANT; what is asked for
is extracted by path and type, and what all cases have together is a schema merged over all of them (``merged_schema``, an
aggregate combined before the shuffle), into which every case can be read (``flattened``).

Defined results: text that isn't a JSON object is a case without facts (``is_case`` tells); a field of an unlike type is
missing, never an error; of fields that have unlike types from case to case the merged type is VARIANT; fields that are
null in every case are strings; repeated keys in one object make it no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.numbers import danish_list, income_years
from palimpsest.functions.text import col

#: Titles of the reasons for a case, as they stand in a letter.
FACTORS = {
    "self_employed_business": "Selvstændig erhvervsvirksomhed",
    "foreign_income": "Indkomst fra udlandet",
    "foreign_real_estate": "Fast ejendom i udlandet",
    "work_abroad_with_relief": "Lønindkomst for arbejde udført i udlandet med lempelse",
    "special_tax_liability_conditions": "Særlige skattepligtsforhold",
    "major_shareholder_status": "Hovedaktionærstatus",
    "foreign_assets_liabilities_significant": "Aktiver eller passiver i udlandet af betydning for skatteansættelsen",
    "cross_border_commuter_taxation": "Grænsegængerbeskatning",
}
#: What is written of the kinds of foreign income, of liability and of assets.
INCOME_TYPES = {"salary": "lønindkomst", "pension": "pension", "capital_income": "kapitalindkomst"}
LIABILITY = {
    "shift_full_limited": "skift mellem fuld og begrænset skattepligt",
    "tax_resident_abroad": "skattemæssigt hjemmehørende i udlandet",
    "offset_income_year": "forskudt indkomstår",
    "duty_under_section_8_2": "oplysningspligt efter skattekontrollovens § 8, stk. 2",
    "request_information_schema": "anmodning om oplysningsskema",
}
ASSETS = {"bankkonti": "bankkonti", "værdipapirer": "værdipapirer", "gæld": "gæld"}
#: Residence as it is written.
ALWAYS, SINCE = "Da du altid har haft bopæl i Danmark", "Da du har haft bopæl i Danmark siden "


def facts(text: str | Column) -> Column:
    """JSON as a VARIANT object; anything else is null."""
    parsed = F.try_parse_json(col(text))
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed)


def said(held: Column, path: str) -> Column:
    """A fact as text without white space at its ends; missing, null or no plain value: empty."""
    kind = F.schema_of_variant(F.try_variant_get(held, path, "variant"))
    plain = ~F.coalesce(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.lit(True))
    return F.when(plain, F.trim(F.coalesce(F.try_variant_get(held, path, "string"), F.lit("")))).otherwise("")


def listed(held: Column, path: str) -> Column:
    """A fact that is a list, as texts; else an empty array."""
    return F.filter(F.coalesce(F.try_variant_get(held, path, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def _named(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def payload(held: Column) -> dict[str, Column]:
    """The columns of a case that a letter is made from, out of its facts (VARIANT)."""
    chosen = listed(held, "$.selectedFactors")
    details = F.coalesce(F.try_variant_get(held, "$.factorDetails", "map<string,string>"), F.create_map().cast("map<string,string>"))
    income = danish_list(F.filter(F.transform(listed(held, "$.foreignIncomeTypes"), lambda t: F.coalesce(_named(INCOME_TYPES, t), F.lit(""))), lambda t: t != ""))
    liability = F.coalesce(_named(LIABILITY, said(held, "$.specialTaxLiabilityMode")), F.lit(""))
    assets = F.coalesce(_named(ASSETS, said(held, "$.foreignAssetsLiabilitiesType")), F.lit(""))

    def detail(factor: Column) -> Column:
        own = F.trim(F.coalesce(F.try_element_at(details, factor), F.lit("")))
        known = F.when(factor == "foreign_income", income).when(factor == "special_tax_liability_conditions", liability)
        return known.when(factor == "foreign_assets_liabilities_significant", assets).otherwise(own)

    def titled(factor: Column) -> Column:
        title = F.coalesce(_named(FACTORS, factor), factor)
        return F.when(detail(factor) != "", F.concat(title, F.lit(": "), detail(factor))).otherwise(title)

    first = F.coalesce(F.try_element_at(chosen, F.lit(1)), F.lit(""))
    mode, since = said(held, "$.residenceMode"), said(held, "$.residenceSinceYear")
    residence = F.when(mode == "always", ALWAYS).when(mode == "since_year", F.when(since != "", F.concat(F.lit(SINCE), since)).otherwise("")).otherwise(said(held, "$.residenceFact"))
    return {
        "income_years": F.array_join(income_years(said(held, "$.incomeYears")).cast("array<string>"), ","),
        "foreign_income": F.array_join(F.filter(F.transform(chosen, titled), lambda t: F.trim(t) != ""), "; "),
        "residence_fact": residence,
        "residence_mode": mode,
        "selected_trigger": first,
        "selected_trigger_detail": F.when(first != "", detail(first)).otherwise(""),
        "self_employed_business_mode": said(held, "$.selfEmployedMode"),
        "one_trigger": F.size(chosen) == 1,
    }


def merged_schema(rows: DataFrame, held: str) -> str:
    """One schema into which all cases can be read, as DDL; without any case an empty struct."""
    merged = rows.select(F.schema_of_variant_agg(held)).first()[0] or "VOID"
    return merged.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING") if merged.startswith("OBJECT") else "STRUCT<>"


def flattened(rows: DataFrame, held: str, prefix: str = "") -> DataFrame:
    """``rows`` with a column for each field that any case has, of the type that fits all cases."""
    schema = merged_schema(rows, held)
    if schema == "STRUCT<>":
        return rows.drop(held)
    whole = rows.withColumn("_flat", F.try_variant_get(held, "$", schema))
    names = whole.schema["_flat"].dataType.names
    return whole.select(*[c for c in rows.columns if c != held], *[F.col("_flat")[n].alias(prefix + n) for n in names])
