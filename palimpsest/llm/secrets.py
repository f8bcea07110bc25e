"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over lower-cased trigrams is derived: any match
must hold all trigrams of at least one of the query's clauses. The index holds, for each distinct
text, which of the rules' trigrams occur in it; a posting is a (trigram, text) row. Clauses are joined
to the postings, a text that holds a whole clause is a candidate of its rule, and only candidates are
verified by the expression itself. A rule without mandatory trigrams is verified on every text.

Copies of a text share one index entry, combined before the shuffle, so a group of copies of any size
costs one entry. The index keeps only trigrams that some rule asks for.

Spans are code points, end exclusive. Defined results: null text counts as empty and has no spans;
an empty table gives an empty table; rows repeated are reported each; a text of any length is searched whole,
its matches are placed by running sums in blocks, so that a text of many matches takes time near its length;
spans of one start are ordered by their rule's number; a column of ``docs`` named ``found`` is replaced, and
those whose names start with ``_sc_`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import spool


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Python and Java. A match fails, though it consumes text, where
    ``group`` is shorter than ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules, in the order in which kinds are listed, then formats that issuers have published.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)

ADDED = ("found",)
SPAN = "struct<start:int,kind:int,end:int>"
#: Literals are multiplied out while there are at most so many, and while they are at most so long.
MOST_LITERALS, MOST_LETTERS = 64, 64
SMALL_CLASS = 8
BLOCK = 128  # of running sums and of pieces of text
OWN = "_sc_"
KEYS = (f"{OWN}k1", f"{OWN}k2")

Clauses = frozenset  # of clauses, each a frozenset of trigrams; the query holds if one clause does


def _either(a: Clauses | None, b: Clauses | None) -> Clauses | None:
    return None if a is None or b is None else a | b


def _both(a: Clauses | None, b: Clauses | None) -> Clauses | None:
    if a is None or b is None:
        return b if a is None else a
    joined = Clauses(x | y for x, y in product(a, b))
    return joined if len(joined) <= 4 * MOST_LITERALS else min(a, b, key=len)


def _asks(literals: set[str]) -> Clauses | None:
    """Clauses of "one of these strings occurs"; None (anything) if one is shorter than a trigram."""
    if not literals or min(map(len, literals)) < 3:
        return None
    return Clauses(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in literals)


#: An expression as it is read: ("one", characters or None for any), ("all", parts), ("any", parts), ("times", part, least, most).
Node = tuple


class _Reader:
    """Reads the expressions that rules are written in: literals, escapes, classes, groups, alternatives, repeats."""

    MANY = 1 << 20

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def _next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _sees(self, mark: str) -> bool:
        return self.text.startswith(mark, self.at)

    def either(self) -> Node:
        parts = [self._sequence()]
        while self._sees("|"):
            self.at += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("any", parts)

    def _sequence(self) -> Node:
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self._repeated(self._item()))
        return ("all", parts)

    def _repeated(self, part: Node) -> Node:
        while self.at < len(self.text) and self.text[self.at] in "?*+{":
            mark = self._next()
            if mark == "{":
                end = self.text.index("}", self.at)
                least, _, most = self.text[self.at : end].partition(",")
                bounds = int(least), int(most) if most else self.MANY if "," in self.text[self.at : end] else int(least)
                self.at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, self.MANY), "+": (1, self.MANY)}[mark]
            part = ("times", part, *bounds)
        return part

    def _item(self) -> Node:
        mark = self._next()
        if mark == "(":
            if self._sees("?"):
                self.at = self.text.index(":", self.at) + 1  # (?: or (?i:, which is the same to lower-cased trigrams
            inner = self.either()
            self.at += 1
            return inner
        if mark == "[":
            return self._class()
        if mark == "\\":
            return ("one", self._escaped())
        return ("one", None if mark == "." else {mark.lower()})

    def _escaped(self) -> set[str] | None:
        mark = self._next()
        if mark == "x":
            self.at += 2
            return {chr(int(self.text[self.at - 2 : self.at], 16)).lower()}
        return None if mark.isalnum() else {mark}

    def _class(self) -> Node:
        known: set[str] | None = set()
        if self._sees("^"):
            known = None
        first = True
        while first or not self._sees("]"):
            first = False
            mark = self._next()
            letters = self._escaped() if mark == "\\" else {mark}
            if letters and self._sees("-") and not self._sees("-]"):
                self.at += 1
                mark = self._next()
                last = min(self._escaped() or "") if mark == "\\" else mark
                span = range(ord(min(letters)), ord(last) + 1)
                letters = {chr(x) for x in span} if len(span) <= SMALL_CLASS else None
            known = None if known is None or letters is None else known | {x.lower() for x in letters}
        self.at += 1
        return ("one", known if known and len(known) <= SMALL_CLASS else None)


def trigram_query(pattern: str) -> Clauses | None:
    """Clauses of lower-case trigrams of which a match must hold one whole; None: scan fully."""

    def exact(node: Node) -> set[str] | None:
        """All lower-cased strings that the node can match, if they are few; else None."""
        kind, what = node[:2]
        if kind == "one":
            return what
        if kind == "all":
            return joined(what)
        if kind == "any":
            parts = [exact(x) for x in what]
            return None if any(p is None for p in parts) else set().union(*parts)
        least, most = node[2:]
        once = exact(what) if most <= 4 else None
        if once is None:
            return None
        out = {"".join(x) for n in range(least, most + 1) for x in product(once, repeat=n)}
        return out if len(out) <= MOST_LITERALS else None

    def joined(parts: Sequence[Node]) -> set[str] | None:
        out = {""}
        for part in parts:
            x = exact(part)
            if x is None or len(out) * len(x) > MOST_LITERALS:
                return None
            out = {a + b for a, b in product(out, x)}
        return out

    def query(node: Node) -> Clauses | None:
        kind, what = node[:2]
        if kind == "one":
            return None
        if kind == "any":
            found = [query(("all", [x])) for x in what]
            out = found[0]
            for x in found[1:]:
                out = _either(out, x)
            return out
        if kind == "times":
            return query(what) if node[2] >= 1 else None
        held, run = None, {""}
        for part in what:
            x = exact(part)
            if x is not None and len(run) * len(x) <= MOST_LITERALS and max(map(len, run)) < MOST_LETTERS:
                run = {a + b for a, b in product(run, x)}
                continue
            held, run = _both(held, _asks(run)), x or {""}
            if x is None:
                held = _both(held, query(part))
        return _both(held, _asks(run))

    found = query(("all", [_Reader(pattern).either()]))
    return found and Clauses(x for x in found if not any(y < x for y in found))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _vocabulary(rules: Sequence[Rule]) -> tuple[list[str], list[tuple[int, int, int, int]], list[int]]:
    """Trigrams asked for; (trigram, rule, clause, the clause's size) rows; rules that scan fully."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries if q for clause in q for g in clause})
    number = {g: i for i, g in enumerate(grams)}
    terms = [
        (number[g], r, k, len(clause))
        for r, q in enumerate(queries)
        if q
        for k, clause in enumerate(sorted(q, key=sorted))
        for g in sorted(clause)
    ]
    return grams, terms, [r for r, q in enumerate(queries) if q is None]


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text; texts that agree in both share an index entry, which
    holds the trigrams of either, so that nothing is missed."""
    return [F.xxhash64(text).alias(KEYS[0]), F.xxhash64(text, F.lit(1)).alias(KEYS[1])]


def trigram_index(texts: DataFrame, text: str, grams: Sequence[str]) -> DataFrame:
    """The key and the entry's trigrams as bit masks of 64, one row for each distinct text."""

    def mask(t: Column, part: Sequence[str]) -> Column:
        bits = F.transform(
            F.array(*[F.lit(g) for g in part]),
            lambda g, i: F.when(F.contains(t, g), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
        )
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    parts = [grams[i : i + 64] for i in range(0, len(grams), 64)]
    masks = let(F.lower(F.col(text)), lambda t: F.array(*[mask(t, p) for p in parts]))
    return (
        texts.where(F.col(text).isNotNull())
        .select(*text_key(F.col(text)), masks.alias("_masks"))
        .groupBy(*KEYS)
        .agg(*[F.bit_or(F.col("_masks")[i]).alias(f"_m{i}") for i in range(len(parts))])
    )


def candidates(index: DataFrame, grams: Sequence[str], terms: Sequence[tuple[int, int, int, int]]) -> DataFrame:
    """The key and _sc_rules: the rules of which a text holds all trigrams of some clause."""
    spark = index.sparkSession
    masks = F.array(*[F.col(x) for x in index.columns if x.startswith("_m")])
    held = F.filter(
        F.sequence(F.lit(0), F.lit(len(grams) - 1)),
        lambda i: F.get(masks, (i / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0,
    )
    postings = index.select(*KEYS, F.explode(held).alias("_gram"))
    # The rules' own terms: a few hundred rows at most, whatever the corpus.
    wanted = F.broadcast(spark.createDataFrame(list(terms), "_gram int, _rule int, _clause int, _need int"))
    return (
        postings.join(wanted, "_gram")
        .groupBy(*KEYS, "_rule", "_clause")
        .agg(F.count("*").alias("_held"), F.first("_need").alias("_need"))
        .where("_held = _need")
        .groupBy(*KEYS)
        .agg(F.collect_set("_rule").alias(f"{OWN}rules"))
    )


def running(numbers: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """Each number's combination with all before it, itself included, in blocks, whose own results are short arrays."""
    none = F.array().cast("array<int>")

    def within(values: Column) -> Column:
        zero = F.struct(F.lit(start).alias("at"), none.alias("out"))

        def grown(acc: Column, x: Column) -> Column:
            at = step(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(values, zero, grown, lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        return let(F.transform(at, lambda i: within(F.slice(xs, i * BLOCK + 1, BLOCK))), combined)

    def combined(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(start)), within(F.transform(parts, lambda x: F.element_at(x, -1))))
        return let(before, lambda b: F.flatten(F.zip_with(parts, b, lambda x, at: F.transform(F.coalesce(x, none), lambda y: step(at, y)))))

    return let(numbers, lambda xs: F.when(F.size(xs) > 0, blocks(xs)).otherwise(none))


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches that don't fail."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), group.alias("group")), lambda x: x["whole"].isNotNull())
    sizes = F.transform(
        zipped,
        lambda x: F.struct((F.length(x["gap"]) + F.length(x["whole"])).alias("all"), F.length(x["whole"]).alias("whole"), (F.length(x["group"]) >= rule.least).alias("kept")),
    )

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda x: x["all"]), 0, lambda a, x: a + x)
        spans = F.zip_with(found, ends, lambda x, end: F.struct((end - x["whole"]).alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["kept"].alias("kept")))
        return F.transform(F.filter(spans, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when(F.rlike(text, F.lit(rule.pattern)), let(sizes, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with ``found``: array of (start, kind, end), by start, then kind (its rule's number)."""
    docs = docs.drop(*ADDED, *[x for x in docs.columns if x.startswith(OWN)])
    grams, terms, full = _vocabulary(rules)
    keyed = docs.select("*", *text_key(F.col(text_col)))
    if terms:
        # Written out, so that the join reads plain rows on both sides and Spark may split a busy key.
        hits = spool(candidates(trigram_index(docs, text_col, grams), grams, terms), "secret-candidates")
        keyed = keyed.join(hits, list(KEYS), "left")
    else:
        keyed = keyed.withColumn(f"{OWN}rules", F.lit(None).cast("array<int>"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    spans = [
        rule_spans(text, r, i) if i in full else F.when(F.array_contains(f"{OWN}rules", i), rule_spans(text, r, i)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    return keyed.select(*docs.columns, F.array_sort(F.flatten(F.array(*spans))).alias("found"))


def written(found: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(found: Column, kind: str, rules: Sequence[Rule] = RULES) -> Column:
    number = [r.kind for r in rules].index(kind)
    return F.size(F.filter(found, lambda s: s["kind"] == number)).cast("long")


def base_only(found: Column, rules: Sequence[Rule] = RULES) -> Column:
    return F.filter(found, lambda s: s["kind"].isin([i for i, r in enumerate(rules) if r.base]))


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` in place of each stretch that spans cover; overlapping spans are one stretch.

    What stands before each stretch is cut from the text in blocks of pieces, then joined once."""
    text, found = F.col(text_col), F.col("found")

    def clean(ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        pieces = F.transform(found, lambda s, i: F.struct(before(i).alias("at"), s["start"].alias("to")))
        fresh = F.filter(pieces, lambda x: x["to"] >= x["at"])
        rest = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
        return F.concat(let(fresh, joined), rest)

    def joined(pieces: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda i: F.slice(pieces, i * BLOCK + 1, BLOCK))

        def of_block(part: Column) -> Column:
            base = F.get(part, F.lit(0))["at"]
            stretch = F.substring(text, base + 1, F.element_at(part, -1)["to"] - base)
            cut = lambda t: F.transform(part, lambda x: F.concat(F.substring(t, x["at"] - base + 1, x["to"] - x["at"]), F.lit(mark)))
            return F.array_join(let(stretch, cut), "")

        return F.array_join(F.transform(blocks, of_block), "")

    ends = running(F.transform(found, lambda s: s["end"]), 0, lambda a, x: F.greatest(a, x))
    return scanned.withColumn(text_col, F.when(F.size(found) > 0, let(ends, clean)).otherwise(text)).drop("found")


def oracle(rules: Sequence[Rule] = RULES) -> str:
    """The same in DuckDB's SQL, without an index: every rule on every text."""

    def spans(number: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""
            select doc_id, {number} as kind, '{r.kind}' as name, {r.base} as base, list_sum(list_transform(gaps[1:k], lambda x: length(x)))
                     + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as s, length(m[k]) as n, length(g[k]) as need, {r.least} as least
            from (select doc_id, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {r.group}) as g from docs), unnest(range(1, len(m) + 1)) u(k)"""

    every = " union all ".join(spans(i, r) for i, r in enumerate(rules))
    joined = "coalesce(string_agg(name || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, kind, n)"
    counts = ", ".join(f"count(*) filter (name = '{r.kind}') as n_{r.kind}" for r in rules if r.base)
    return f"""
        with docs as (select doc_id, coalesce(text, '') as t from documents), found as ({every}), kept as (select * from found where need >= least)
        select docs.doc_id, {counts}, sha256({joined} filter (base), '')) as base_sha256, {joined} filter (name is not null), '') as spans
        from docs left join kept using (doc_id) group by 1"""
