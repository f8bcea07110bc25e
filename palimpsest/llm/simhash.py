"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits; bit b is set if it is set in over half of its shingles' hashes.
Fingerprints within ``distance`` bits are linked. Documents with one fingerprint are one row from the
start, so a group of copies costs one row in all that follows.

Search: bits that vary together are grouped into partitions. Two fingerprints within distance t agree
to within T_i bits in some partition i for any thresholds T with sum(T) = t - partitions + 1 (a
threshold of -1 leaves a partition out). Which thresholds are cheapest is decided by dynamic programming
on estimated candidate counts, from the corpus's own counts of each partition's values, for each number
of partitions; the cheapest of all is taken. A skewed partition thus gets a low threshold or none.
Fingerprints are then indexed by partition value and probed with all values within T_i: an equi-join,
whose pairs are verified in the join itself. Correctness doesn't depend on any estimate.

Groups are the connected components of the links, found by alternating large-star and small-star steps
whose state is written to the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any other; fewer words
than a shingle: the whole sequence is the one shingle; repeated rows and null ids are rows of their
own, null ids never name a component unless all its ids are null; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import discard, spool, spooled

BITS = 64
SHINGLE = 5
DISTANCE = 2
#: Numbers of partitions that are considered.
PARTITIONS = (1, 2, 3, 4)


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, 42)], dtype="<u8")
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    view = memoryview(line)
    return np.array([digest(view[a : b - 1], 42) for a, b in zip(at, at[shingle:], strict=False)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, A-Z lower-cased, as an unsigned integer."""
    hashes = _hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 4096):  # bounded memory for texts of any length
        part = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all, if none are named) and the fingerprint as a signed long. Columns named as the
    result, or beginning with ``_sh_``, are left out."""
    carry = docs.columns if carry is None else carry
    carry = [c for c in carry if c != out and not c.startswith("_sh_")]
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), f"`{out}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("_sh_text"))
            fp = np.array([fingerprint(t.as_py(), shingle) for t in text], dtype=np.uint64).view(np.int64)
            kept = [batch.column(batch.schema.names.index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], names=[*carry, out])

    return docs.select(*carry, F.col(text_col).alias("_sh_text")).mapInArrow(run, fields)


# --- partitions and thresholds -------------------------------------------------------------------


def bit_moments(distinct: DataFrame, fp: str = "fp") -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set (64 x 64, summed by
    task in Spark and then once more: a fixed amount reaches the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            bits = ((values[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total += bits.T @ bits
            n += len(values)
        if n:
            row = pa.array(np.arange(BITS + 1, dtype=np.int32))
            sums = [list(map(int, r)) for r in total] + [[n] * BITS]
            yield pa.RecordBatch.from_arrays([row, pa.array(sums, pa.list_(pa.int64()))], names=["row", "sums"])

    sums = distinct.select(fp).mapInArrow(run, "row int, sums array<bigint>")
    rows = sums.groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(BITS)]).alias("sums")).collect()
    got = {r["row"]: r["sums"] for r in rows}
    if not got:
        return 0, np.zeros((BITS, BITS))
    return int(got[BITS][0]), np.array([got[i] for i in range(BITS)], dtype=float)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(left, key=lambda b: (corr[b, left].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            b = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a partition, of sum ``total`` and least summed cost; ``costs[i][e]`` is that of
    threshold e in partition i, and -1 costs nothing. Dynamic programming over partitions and sums."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for e in range(-1, len(row)):
                at, new = s + e, cost + (row[e] if e >= 0 else 0.0)
                if at not in step or new < step[at][0]:
                    step[at] = (new, [*chosen, e])
        best = step
    return best[total]


def plan_search(distinct: DataFrame, distance: int, fp: str = "fp", partitions: tuple[int, ...] = PARTITIONS) -> list[tuple[list[int], int]]:
    """(bits of a partition, its threshold) of the cheapest allocation; left-out partitions aren't named."""
    n, both = bit_moments(distinct, fp)
    if not n:
        return []
    p = np.diag(both) / n
    differ = np.clip(2 * p * (1 - p), 1e-3, 0.5)
    layouts = {m: group_bits(n, both, m) for m in partitions if m <= distance + 2}
    masks = [(m, i, _mask(bits)) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    # Pairs that share a partition's whole value: the sum of squared counts, over all fingerprints.
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col(fp).bitwiseAND(F.lit(m)).alias("v")) for k, (_, _, m) in enumerate(masks)])
    counts = distinct.select(F.explode(keys).alias("x")).groupBy("x.k", "x.v").count()
    same = {r["k"]: float(r["s"]) for r in counts.groupBy("k").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()}
    plans = []
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            odds = differ[bits] / (1 - differ[bits])
            symmetric = [1.0]  # elementary symmetric sums: pairs at exactly e differing bits, against none
            for o in odds:
                symmetric = [a + o * b for a, b in zip([*symmetric, 0.0], [0.0, *symmetric], strict=True)][: distance + 1]
            pairs = same[next(k for k, x in enumerate(masks) if x[:2] == (m, i))]
            row = []
            for e in range(distance + 1):
                probes = sum(comb(len(bits), d) for d in range(e + 1))
                row.append(pairs * sum(symmetric[: e + 1]) + n * (probes + 1))
            costs.append(row)
        cost, chosen = allocate(costs, distance - m + 1)
        plans.append((cost, m, [(bits, e) for bits, e in zip(groups, chosen, strict=True) if e >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


def links(
    distinct: DataFrame, distance: int = DISTANCE, fp: str = "fp", search: list[tuple[list[int], int]] | None = None, most: int | None = None
) -> DataFrame:
    """a, b: fingerprints a < b of ``distinct`` (unique) that differ in at most ``distance`` bits. Where ``most`` is given, a
    partition's value that more fingerprints hold is met at its least one only: for callers with another way for the rest."""
    search = plan_search(distinct, distance, fp) if search is None else search

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    def values(probe: bool) -> Column:
        keys = []
        for k, (bits, threshold) in enumerate(search):
            value = F.col(fp).bitwiseAND(F.lit(_mask(bits)))
            for d in range(threshold + 1 if probe else 1):
                for flipped in combinations(bits, d):
                    keys.append(F.struct(F.lit(k).alias("k"), value.bitwiseXOR(F.lit(signed(sum(1 << b for b in flipped))).cast("long")).alias("v")))
        return F.explode(F.array(*keys)).alias("x")

    if not search:
        return distinct.select(F.col(fp).alias("a"), F.col(fp).alias("b")).where("false")
    index = distinct.select(F.col(fp).alias("b"), values(False)).select("b", "x.k", "x.v")
    probes = distinct.select(F.col(fp).alias("a"), values(True)).select("a", "x.k", "x.v")
    if most is not None:
        hot = index.groupBy("k", "v").agg(F.count("*").alias("rows"), F.min("b").alias("least")).where(F.col("rows") > most)
        index = index.join(hot.select("k", "v", "least"), ["k", "v"], "left").where("least is null or b = least").select("b", "k", "v")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return probes.join(index, ["k", "v"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


# --- connected components ------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for every node of the edges (a, b) the least node of its component.

    Alternates large-star and small-star steps until nothing changes. Each node's least neighbour is an
    aggregate combined before the shuffle, and joined back to the edges, whose large groups Spark may
    split; no node's neighbours are gathered in one place.
    """
    state, path = spooled(edges.select("a", "b").where("a <> b"), "links")
    before = None
    for k in range(rounds):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()  # a > b from here on
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        past = path
        state, path = spooled(small, f"star-{k}")
        discard(edges.sparkSession, past)
        seen = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a", F.lit(1))).alias("y")).first()
        if seen == before or not seen["n"]:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def groups(docs: DataFrame, *, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id (the least id of the documents that links reach) for each row of ``docs``.

    Components are found among distinct fingerprints, so that their state has a row for each of those
    that has a link at all; the least id of each is then joined back by fingerprint.
    """
    marked = spool(with_fingerprints(docs, text_col=text_col, shingle=shingle, carry=[id_col]), "fingerprints")
    distinct = spool(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    found = spool(components(links(distinct, distance)), "components")
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spool(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), "named")
    return marked.join(named, F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

