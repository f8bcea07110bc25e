"""Decision rules: deadlines, pro-rata allocation, article profiles, case facts.

Rule tables are small DataFrames of fixed size joined by key; conditions that can't be decided stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import numbers
from palimpsest.functions.text import match_text

#: Trigger, mode (null: none asked), falls under the annual-statement order, its provision, number
#: in the short-deadline order, needs a detail.
TRIGGERS = (
    ("self_employed_business", "oplysningsskema", True, "§ 1, stk. 2, nr. 1", "1", False),
    ("self_employed_business", "undtagelse", True, "§ 2", "2", False),
    ("foreign_income", None, True, "§ 3", "2", True),
    ("foreign_real_estate", None, True, "§ 3", "2", False),
    ("work_abroad_with_relief", None, True, "§ 1, stk. 2, nr. 5", "1", False),
    ("special_tax_liability_conditions", None, True, "§ 1, stk. 3", "1", True),
    ("major_shareholder_status", None, False, "", "3", True),
    ("foreign_assets_liabilities_significant", None, False, "", "4", True),
    ("cross_border_commuter_taxation", None, False, "", "5", False),
)
#: Names that older cases give to modes.
MODES = {"not_covered_by_section_2": "oplysningsskema", "with_annual_statement_exception_rule": "undtagelse"}
#: The orders on short deadlines, by the last income year of the first.
FIRST_ORDER_UNTIL, FIRST_ORDER, SECOND_ORDER = 2023, "1305 af 14. november 2018", "49 af 24. januar 2025"
DEADLINE_YEARS = 4
DAY_LIMIT = 183


def orders_for(years: Column) -> Column:
    """Orders that apply to an array of income years."""
    early, late = F.exists(years, lambda y: y <= FIRST_ORDER_UNTIL), F.exists(years, lambda y: y > FIRST_ORDER_UNTIL)
    return F.array_compact(F.array(F.when(early, FIRST_ORDER), F.when(late, SECOND_ORDER)))


def deadline_lines(years: Column) -> Column:
    """When to give notice and when to assess, for each income year."""
    one = lambda y: F.concat(
        F.lit("For indkomståret "), y.cast("string"), F.lit(" kan vi derfor varsle ændring senest den 1. maj "), (y + DEADLINE_YEARS).cast("string"),
        F.lit(" og foretage ansættelsen senest den 1. august "), (y + DEADLINE_YEARS).cast("string"), F.lit("."),
    )
    line = lambda y: F.concat(
        F.lit("- Indkomståret "), y.cast("string"), F.lit(": varsling senest den 1. maj "), (y + DEADLINE_YEARS).cast("string"),
        F.lit(" og ansættelse senest den 1. august "), (y + DEADLINE_YEARS).cast("string"), F.lit("."),
    )
    head = F.concat(F.lit("For indkomstårene "), numbers.years_display(years), F.lit(" kan vi derfor varsle og ansætte således:"))
    return F.when(F.size(years) == 1, one(F.get(years, F.lit(0)))).otherwise(F.array_join(F.concat(F.array(head), F.transform(years, line)), "\n"))


def trigger_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRIGGERS), "trigger string, mode string, annual_statement boolean, provision string, number string, needs_detail boolean")


def deadlines(cases: DataFrame) -> DataFrame:
    """Cases (case_id, income_years, triggers array, mode, detail, residence) with their verdict.

    years, trigger, annual_statement, provision, number, orders, last_deadline, lines, problem: just one
    trigger, at least one year, a mode, a detail and a residence where they're needed.
    """
    mode = F.col("mode")
    for old, new in MODES.items():
        mode = F.when(F.col("mode") == old, new).otherwise(mode)
    chosen = F.array_distinct(F.filter(F.transform("triggers", F.trim), lambda t: t != ""))
    rows = cases.withColumns({"years": numbers.income_years("income_years"), "_chosen": chosen, "_mode": mode})
    rows = rows.withColumn("trigger", F.when(F.size("_chosen") == 1, F.get("_chosen", F.lit(0))))
    table = F.broadcast(trigger_table(cases.sparkSession)).withColumnsRenamed({"trigger": "_t", "mode": "_m"})  # nine rows
    rows = rows.join(table, (F.col("trigger") == F.col("_t")) & (F.col("_m").isNull() | (F.col("_m") == F.col("_mode"))), "left")
    known = [t for t, *_ in TRIGGERS]
    residence = (F.col("trigger") != "cross_border_commuter_taxation") & (F.coalesce(F.trim("residence"), F.lit("")) == "")
    problem = (
        F.when(F.size("years") == 0, "no income year")
        .when(F.coalesce(F.size("_chosen"), F.lit(0)) != 1, "not just one trigger")
        .when(~F.col("trigger").isin(known), "unknown trigger")
        .when(F.col("_t").isNull(), "unknown mode")
        .when(F.col("needs_detail") & (F.coalesce(F.trim("detail"), F.lit("")) == ""), "detail missing")
        .when(residence, "residence missing")
    )
    return rows.select(
        "case_id", "years", "trigger", "annual_statement", "provision", "number", orders_for(F.col("years")).alias("orders"),
        (F.array_max("years") + DEADLINE_YEARS).alias("last_deadline"), deadline_lines(F.col("years")).alias("lines"), problem.alias("problem"),
    )


def allocate(workdays: DataFrame, cases: DataFrame, case: str = "case_id") -> DataFrame:
    """Gross income shared out by days worked: case, country, days, share_ratio, amount, taxed_in.

    ``workdays``: case, country, days; ``cases``: case, amount, employer_country. Days in a country that's
    neither home nor the employer's count for home. Countries compare without case and accents.
    """
    home = "danmark"
    rows = workdays.where("days > 0").join(cases, case)
    total = rows.groupBy(case).agg(F.sum("days").alias("_total"))
    rows = rows.join(total, case)
    share = F.col("days") / F.col("_total")
    key, employer = match_text("country"), match_text("employer_country")
    other = (key != home) & ~key.eqNullSafe(employer)
    return rows.select(
        case, "country", "days", numbers.half_up(share, 5).alias("share_ratio"), numbers.half_up(F.col("amount") * share, 2).alias("amount"), F.when(other, home).otherwise(F.col("country")).alias("taxed_in")
    )


def article15(cases: DataFrame, workdays: DataFrame, case: str = "case_id") -> DataFrame:
    """The tests of the employment article: day_test and employer_test by the first foreign country worked in,
    null where it can't be told. ``workdays``: case, ord, country, days; ``cases``: case, section, employer_country."""
    foreign = workdays.where(F.lower(F.trim("country")) != "danmark")
    first = foreign.groupBy(case).agg(F.min_by(F.struct("country", "days"), "ord").alias("_f"))
    employer = F.nullif(F.trim("employer_country"), F.lit(""))
    rows = cases.join(first, case, "left").withColumns({"work_country": F.trim("_f.country"), "work_days": F.col("_f.days")})
    day = F.when(F.col("section") == 2, F.col("work_days") <= DAY_LIMIT)
    emp = F.when(F.col("section") == 2, F.lower(employer) != F.lower("work_country"))
    word = lambda c: F.when(c, "opfyldt").when(~c, "ikke_opfyldt").otherwise("uafklaret")
    return rows.select(case, "section", "work_country", "work_days", day.alias("day_test"), emp.alias("employer_test"), word(day).alias("day_result"), word(emp).alias("employer_result"))


#: What each article's profile asks for and says. profile, day allocation, employer's character, sources as
#: (label, reason), premises, conclusion.
FULL_LIABILITY = (("KSL § 1, stk. 1, nr. 1", "Mulig fuld dansk skattepligt"), ("SSL § 4", "Globalindkomstprincip ved fuld skattepligt"))
PROFILES = (
    (
        18, "employment_article_18", False, False, ("DBO artikel 18", "Valgt artikel for pension/tilsvarende ydelser"),
        ("Det lægges til grund, at vurderingen sker efter DBO artikel 18.",),
        "Foreløbig vurdering efter artikel 18 forudsætter yderligere afklaring af indkomsttype og kildedata.",
    ),
    (
        19, "employment_article_19", False, True, ("DBO artikel 19", "Valgt artikel for offentligt hverv/ydelse"),
        ("Det lægges til grund, at vurderingen sker efter DBO artikel 19.", "Arbejdsgivers offentlige/private karakter anses for central i vurderingen."),
        "Foreløbig vurdering efter artikel 19 kræver afklaring af arbejdsgivers offentlige status.",
    ),
)
GENERIC = "Der er ikke valgt en specialiseret artikelprofil; vurderingen er foreløbig."
DAYS_UNUSED = "Arbejdsdage er oplyst, men artikel 18-profil bruger normalt ikke dagsbaseret allokering."
EMPLOYER_OPEN = "For artikel 19 bør det afklares, om arbejdsgiver er offentlig myndighed/offentligt organ."
PRIVATE_EMPLOYER = "private_foreign"
#: Types of income by the first that a text names.
INCOME_TYPES = ("løn", "pension", "kapital")


def profile_of(article: Column) -> Column:
    """Which profile decides an article."""
    out = F.when(article == 15, "employment_article_15")
    for number, name, *_ in PROFILES:
        out = out.when(article == number, name)
    return out.otherwise("employment_generic")


def profiles(cases: DataFrame) -> DataFrame:
    """Cases (case_id, article, section, workdays: how many are given, employer_type) by the profiles other than article
    15's: case_id, profile, needs_days, needs_employer, sources, premises, warnings, open_questions, conclusion. A profile is
    a row of a table of fixed size; a case without one gets the generic profile, which names the article if there is one."""
    rows = [(n, name, days, emp, [*FULL_LIABILITY, source], list(said), end) for n, name, days, emp, source, said, end in PROFILES]
    fields = "_n int, profile string, needs_days boolean, needs_employer boolean, _sources array<struct<label:string,reason:string>>, premises array<string>, conclusion string"
    known = F.broadcast(cases.sparkSession.createDataFrame(rows, fields))  # two rows
    both = cases.where("article is null or article <> 15").join(known, F.col("article") == F.col("_n"), "left")
    source = lambda a, b: F.struct(a.alias("label"), b.alias("reason"))
    section = F.coalesce(F.concat(F.lit(", stk. "), F.col("section").cast("string")), F.lit(""))
    named = F.coalesce(F.concat(F.lit("DBO artikel "), F.col("article").cast("string"), section), F.lit("DBO (ikke præciseret)"))
    why = F.when(F.col("article").isNotNull(), "Valgt artikel til foreløbig subsumption").otherwise("Artikel skal afklares for sikker subsumption")
    generic = F.array(*[source(F.lit(a), F.lit(b)) for a, b in FULL_LIABILITY], source(named, why))
    only = lambda test, text: F.array_compact(F.array(F.when(test, text)))
    employer = F.coalesce(F.trim("employer_type"), F.lit(""))
    return both.select(
        "case_id", profile_of(F.col("article")).alias("profile"), F.coalesce("needs_days", F.lit(False)).alias("needs_days"), F.coalesce("needs_employer", F.lit(True)).alias("needs_employer"),
        F.coalesce("_sources", generic).alias("sources"), F.coalesce("premises", F.array().cast("array<string>")).alias("premises"),
        only((F.col("article") == 18) & (F.col("workdays") > 0), DAYS_UNUSED).alias("warnings"),
        only((F.col("article") == 19) & employer.isin("", PRIVATE_EMPLOYER), EMPLOYER_OPEN).alias("open_questions"),
        F.coalesce("conclusion", F.lit(GENERIC)).alias("conclusion"),
    )


def income_type(text: str | Column) -> Column:
    """The first type of income that a text names; empty if none."""
    from palimpsest.functions.text import col

    out = F.lit("")
    for kind in reversed(INCOME_TYPES):
        out = F.when(F.contains(F.lower(col(text)), F.lit(kind)), kind).otherwise(out)
    return F.coalesce(out, F.lit(""))


#: How a text writes an article ("art. 15, stk. 2"), and one that isn't called so ("15, stk. 2").
CALLED_ARTICLE = r"(?U)\b(?:artikel|art)\s*\.?\s*\d{1,2}(?:\s*,?\s*stk\.?\s*\d{1,2})?"
BARE_ARTICLE = r"(?U)\b\d{1,2}\s*,?\s*stk\.?\s*\d{1,2}\b"


def candidate_articles(text: str | Column) -> Column:
    """All articles that a text names, each once, as they are written but for case and white space: those called articles
    first, then numbers that only a subsection's number follows."""
    from palimpsest.functions.text import col, collapse

    t = F.lower(F.coalesce(col(text), F.lit("")))
    called, bare = (F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (CALLED_ARTICLE, BARE_ARTICLE))
    return F.array_distinct(F.transform(F.concat(called, bare), collapse))


def article_of(text: str | Column) -> Column:
    """struct(article, section) named in a text; null numbers where none is."""
    from palimpsest.functions.text import col

    t = F.lower(col(text))
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("int")
    return F.struct(number(r"(?U)\b(?:artikel|art\.?)\s*(\d+)").alias("article"), number(r"stk\.?\s*(\d+)").alias("section"))


def missing_facts(required: dict[str, str]) -> Column:
    """Labels of required columns that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", label) for c, label in required.items()]))
