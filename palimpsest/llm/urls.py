"""URL filters: host rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A host rule fits its host and all subdomains where the url's path starts with the rule's path; the
longest fitting rule decides. Any other url is scanned once for all terms of the vocabulary. A term
counts only at boundaries: the characters beside it are no letters or digits (the url's words are split
by punctuation). One strict term rejects, and so do ``soft_limit`` distinct soft terms.

Host rules are DataFrame expressions. The automaton runs in an Arrow-batched function on the urls that
no rule decides; its size is that of the vocabulary, which ``vocabulary`` reads from a table of terms and
weights: a term of weight 1 or more is strict, a lighter one soft. Distinct urls aren't gathered: no shuffle at all.

Defined results: a null url, or one without ://, has empty host and path, and a null url is allowed;
repeated rows are judged each; a url of any length is scanned whole, once; of two rules of one length that fit, the
greater (host, path) decides; an empty vocabulary finds nothing; an empty table gives an empty table; columns of ``pages`` named like an added one are
replaced, and those whose names start with ``_uf_`` are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
HOST_RULES: tuple[tuple[str, str, str], ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

STRICT = (
    "adult", "bestiality", "casino", "cialis", "escort", "escorts", "hentai", "hardcore", "jackpot", "nude", "nudes",
    "pharma", "phishing", "pills", "poker", "porn", "porno", "roulette", "sex", "sexcam", "slots", "spam", "torrent",
    "viagra", "warez", "xanax", "xxx",
)
SOFT = (
    "ads", "bet", "bets", "betting", "bonus", "buy", "cheap", "click", "coupon", "crack", "deal", "deals", "discount",
    "farm", "free", "gamble", "loan", "loans", "lottery", "money", "offer", "prize", "promo", "replica", "tracker",
    "track", "win", "winner",
)
SOFT_LIMIT = 2
ADDED = ("host", "path", "rule", "verdict")


MOST_TERMS = 1_000_000  # of a vocabulary: the automaton is built in every task


def vocabulary(terms: DataFrame, term_col: str = "term", weight_col: str = "weight") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) terms of a table, lower-cased; null terms and weights of 0 or less are none. At most ``MOST_TERMS``."""
    rows = terms.where(F.length(term_col) > 0).groupBy(F.lower(term_col).alias("t")).agg(F.max(weight_col).alias("w")).where("w > 0").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    return tuple(sorted(r["t"] for r in rows if r["w"] >= 1)), tuple(sorted(r["t"] for r in rows if r["w"] < 1))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = HOST_RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule (host, then path, breaking ties), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def term_hits(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """struct(strict, soft): distinct strict and soft terms that a url holds between boundaries."""
    weights = {t: False for t in soft} | {t: True for t in strict}

    @F.pandas_udf("strict int, soft int")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, is_strict in weights.items():
            automaton.add_word(term, (term, is_strict))
        automaton.make_automaton()

        def count(url: str | None) -> tuple[int, int]:
            text = (url or "").lower() if weights else ""
            found = set()
            for end, (term, is_strict) in automaton.iter(text) if text else ():
                start = end - len(term) + 1
                if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                    found.add((term, is_strict))
            n = sum(is_strict for _, is_strict in found)
            return n, len(found) - n

        for urls in batches:
            yield pd.DataFrame([count(u) for u in urls], columns=["strict", "soft"]).astype("int32")

    return scan(url)


def judge(
    pages: DataFrame,
    *,
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (allow or block)."""
    url = F.col(url_col)
    pages = pages.drop(*[c for c in (*ADDED, *pages.columns) if c != url_col and (c in ADDED or c.startswith("_uf_"))])
    ruled = pages.withColumns({"_uf_host": host_of(url), "_uf_path": path_of(url)})
    ruled = ruled.withColumn("_uf_rule", host_rule(F.col("_uf_host"), F.col("_uf_path"), rules))
    undecided = F.when(F.col("_uf_rule").isNull(), url)
    hits = ruled.withColumn("_uf_hits", term_hits(undecided, strict, soft))
    bad = (F.col("_uf_hits.strict") >= 1) | (F.col("_uf_hits.soft") >= soft_limit)
    verdict = F.coalesce(F.col("_uf_rule.verdict"), F.when(bad, "block").otherwise("allow"))
    return hits.select(
        *pages.columns, F.col("_uf_host").alias("host"), F.col("_uf_path").alias("path"), F.col("_uf_rule.rule").alias("rule"), verdict.alias("verdict")
    )


def oracle() -> str:
    """The same in DuckDB's SQL: each term as a bounded regular expression."""
    count = lambda ts: " + ".join(f"(regexp_matches(lower(u), '(^|[^\\p{{L}}\\p{{N}}]){t}([^\\p{{L}}\\p{{N}}]|$)'))::int" for t in ts)
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    ordered = sorted(HOST_RULES, key=lambda r: (-len(r[0] + r[1]), r))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in ordered)
    return f"""
        with parts as (
            select page_id, coalesce(url, '') as u,
                   translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
            from pages)
        select page_id, host, path, case {rule} end as rule,
               case {verdict} when ({count(STRICT)}) >= 1 or ({count(SOFT)}) >= {SOFT_LIMIT} then 'block' else 'allow' end as verdict
        from parts"""
