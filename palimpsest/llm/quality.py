"""Quality rules by host, with DataFrame functions only.

Each document gets its counts and base verdict. Failures of every rule are summed by domain, a domain's
failure rate is shrunk towards all domains by a beta prior fitted to the domains' own rates (by
moments), and a domain whose shrunk rate exceeds the rule's limit is rejected as a whole: its verdict is
joined back to its documents. A document is kept if neither it nor its domain fails.

Defined results: null text has no words, so it fails; a null domain is a domain; a domain with few
documents stays near the prior; an empty table gives an empty table; repeated rows count each; a text of
any length is counted whole, in memory of a few times its size; a rate just at its limit doesn't reject;
columns of ``docs`` named like an added one are replaced, and those whose names start with ``_qr_`` are
left out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import spool

SPACES = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
NGRAM = 5

#: Rules whose failures are summed by domain, as SQL over the counts, and the shrunk failure rate above
#: which a whole domain goes. The limits are for domains that consist of junk: a domain with a fair
#: share of clean documents stays, and its junk goes document by document.
RULES: dict[str, tuple[str, float]] = {
    "few_words": (f"n_words < {MIN_WORDS}", 0.9),
    "repeated": (f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words", 0.8),
    "symbols": ("n_symbols * 10 > n_words", 0.8),
    "dup_lines": ("n_dup_lines * 10 > 3 * n_lines", 0.8),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "n_lines", "base_failed", "kept", "domain_rejected")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Positions that windows of NGRAM words cover, given their ascending starts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-NGRAM).alias("last"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(NGRAM), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )


def _repeated_words(words: Column) -> Column:
    """Words in windows of NGRAM words that occur twice or more, the first included.

    Windows are compared by 64-bit hashes of their words' hashes. Only where some window recurs are the
    (hash, position) pairs sorted, neighbours compared, and the recurring positions merged.
    """

    def grams(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - NGRAM)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(NGRAM)]))

    def positions(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def recurring(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
            return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

        return let(pairs, lambda s: F.array_sort(F.transform(recurring(s), lambda x: x["i"])))

    count = lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), F.lit(0)
    ).otherwise(_covered(positions(g)))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < NGRAM, F.lit(0)).otherwise(let(hashes, lambda h: let(grams(h), count)))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = lambda x: x.cast("long")

    def word_counts(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
        return F.struct(
            long(F.size(words)).alias("n_words"), chars.alias("word_chars"), long(_repeated_words(words)).alias("n_repeat_words")
        )

    words = F.array_remove(F.split(text, f"[{SPACES}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACES}]")))
    line_counts = let(
        lines,
        lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")),
    )
    symbols = long(F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
    return (
        docs.drop(*ADDED)
        .withColumns({"_qr_w": let(words, word_counts), "_qr_l": line_counts, "n_symbols": symbols})
        .withColumns({c: F.col(f"_qr_w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")})
        .withColumns({c: F.col(f"_qr_l.{c}") for c in ("n_dup_lines", "n_lines")})
        .withColumn("base_failed", F.expr(f"{RULES['few_words'][0]} or {RULES['repeated'][0]}"))
        .drop("_qr_w", "_qr_l")
    )


def domain_verdicts(counted: DataFrame, domain: str = "source", rules: Mapping[str, tuple[str, float]] = RULES) -> DataFrame:
    """One row a domain: documents, for each rule the shrunk failure rate, and domain_rejected.

    The prior of a rule is the beta distribution with the mean and the variance of the domains' rates,
    the variance without what the domains' sizes alone cause.
    """
    fails = {r: F.count_if(F.expr(test)).alias(f"{r}_failed") for r, (test, _) in rules.items()}
    hosts = spool(counted.groupBy(domain).agg(F.count("*").alias("documents"), *fails.values()), "quality-failures")
    n = F.col("documents")
    moments = []
    for r in rules:
        rate = F.col(f"{r}_failed") / n
        moments += [F.avg(rate).alias(f"{r}_mean"), F.var_pop(rate).alias(f"{r}_var"), F.avg(1 / n).alias(f"{r}_inv")]
    prior = {k: F.lit(v or 0.0) for k, v in hosts.agg(*moments).first().asDict().items()}  # three numbers a rule
    out = hosts
    rejected = F.lit(False)
    for r, (_, limit) in rules.items():
        mean, inv = prior[f"{r}_mean"], prior[f"{r}_inv"]
        noise = mean * (1 - mean) * inv
        var = F.greatest((prior[f"{r}_var"] - noise) / F.greatest(1 - inv, F.lit(1e-6)), F.lit(1e-6))
        strength = F.greatest(mean * (1 - mean) / var - 1, F.lit(1.0))
        shrunk = (F.col(f"{r}_failed") + mean * strength) / (n + strength)
        out = out.withColumn(f"{r}_rate", shrunk)
        rejected = rejected | (F.col(f"{r}_rate") > limit)
    return out.select(domain, "documents", *[f"{r}_rate" for r in rules], rejected.alias("domain_rejected"))


def judge(
    docs: DataFrame,
    *,
    domain: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    rules: Mapping[str, tuple[str, float]] = RULES,
    output: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its ``output`` columns) with counts, base_failed, domain_rejected and kept.

    Counts are made once and written to the shared folder without the texts. Where the texts are wanted, the written
    counts go back to them by the row's hash of id (where there is one), domain and text, a shuffle of the texts: rows
    equal in those have equal verdicts, so one of each is kept.
    """
    docs = docs.drop(*ADDED, *[c for c in docs.columns if c.startswith("_qr_")])
    keep = docs.columns if output is None else output
    wide = text_col in keep
    known = [c for c in (id_col, domain, text_col) if c in docs.columns]
    key = [F.xxhash64(*known).alias("_qr_a"), F.xxhash64(F.lit(1), *known).alias("_qr_b")]
    narrow = docs.select(*([] if wide else keep), F.col(domain).alias("_qr_domain"), F.col(text_col).alias("_qr_text"), *(key if wide else []))
    counted = spool(with_counts(narrow, "_qr_text").drop("_qr_text"), "quality-counts")
    verdicts = domain_verdicts(counted, "_qr_domain", rules).select(F.col("_qr_domain").alias("_qr_d"), "domain_rejected")
    verdicts = spool(verdicts, "quality-domains")
    judged = counted.join(verdicts, F.col("_qr_domain").eqNullSafe(F.col("_qr_d"))).withColumn("kept", ~F.col("base_failed") & ~F.col("domain_rejected"))
    added = [*COUNTS, "n_lines", "base_failed", "domain_rejected", "kept"]
    if not wide:
        return judged.select(*keep, *added)
    judged = spool(judged.select("_qr_a", "_qr_b", *added).dropDuplicates(["_qr_a", "_qr_b"]), "quality-verdicts")
    return docs.select(*keep, *key).join(judged, ["_qr_a", "_qr_b"]).select(*keep, *added)


def oracle() -> str:
    """The same in DuckDB's SQL, for rows with distinct ids."""
    space = f"[{SPACES}]"
    shrunk, moments, rejected = [], [], []
    for r, (test, limit) in RULES.items():
        moments.append(f"avg({r} / n) as {r}_mean, var_pop({r} / n) as {r}_var, avg(1.0 / n) as {r}_inv")
        noise = f"{r}_mean * (1 - {r}_mean) * {r}_inv"
        strength = f"greatest({r}_mean * (1 - {r}_mean) / greatest(({r}_var - {noise}) / greatest(1 - {r}_inv, 1e-6), 1e-6) - 1, 1.0)"
        rejected.append(f"({r} + {r}_mean * {strength}) / (n + {strength}) > {limit}")
        shrunk.append(f"count(*) filter ({test}) as {r}")
    return f"""
        with t as (select doc_id, source, coalesce(text, '') as t from documents),
        w as (select *, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') as w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) as l from t),
        grams as (select doc_id, i, array_to_string(w[i:i + {NGRAM - 1}], ' ') as g from w, unnest(range(1, len(w) - {NGRAM - 2})) r(i)),
        twice as (select doc_id, unnest(list(i)) as i from grams group by doc_id, g having count(*) > 1),
        covered as (select doc_id, count(distinct i + k) as n from twice, unnest(range({NGRAM})) r(k) group by 1),
        c as (select doc_id, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
                     (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, len(l) as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
                     coalesce(n, 0)::bigint as n_repeat_words from w left join covered using (doc_id)),
        hosts as (select source, count(*) as n, {", ".join(shrunk)} from c group by 1),
        prior as (select {", ".join(moments)} from hosts),
        verdicts as (select source, {" or ".join(rejected)} as rejected from hosts, prior),
        base as (select *, {RULES["few_words"][0]} or {RULES["repeated"][0]} as base_failed from c)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept
        from base join verdicts on base.source is not distinct from verdicts.source"""
