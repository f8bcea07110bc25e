"""Vector code compression: codebooks for equal parts of vectors, fitted in rounds that keep bounds instead of distances.

A component x counts as the integer floor(1024 * x). A round assigns each part to its codebook's nearest entry, ties to the
lower index, and moves each entry to the componentwise floor of its parts' mean. Between rounds each part persists, in a
written table (``_state``):

* its ``b`` closest entries in order, the assigned one first,
* a lower bound of the distance to each of the others, ascending, and one outer bound for all entries that aren't listed.

When entries move, the bounds give way by as much (``_Part.step``). The distance to the assigned entry is computed anew; if
it is below all bounds, nothing else is looked at. Listed entries whose bounds don't exclude them are uncertain: their
exact integer distances decide, and their order and bounds are mended. Only where the outer bound fails too are all
entries compared and listed afresh. ``b`` adapts: after a round the rows are counted by how many bounds they needed, and
the lists are cut to what ``COVERED`` of them needed. Results don't depend on ``b``.

Distances are exact: in doubles where no sum can reach 2^53, else in 64-bit integers. Bounds are rounded down.

Scale: a row is a vector, each round is one pass over the written state and one sum of a row an entry and task; what the
driver gets are the codebooks and the counts of needs. No row is shuffled but by the sums of errors by label, which are
combined before; these are joined back by a broadcast if they were measured to be small, and else by a join whose large
partitions Spark splits.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do those whose
length isn't a multiple of the parts or differs from that of the first vector (least id, nulls last, then least
integers); integers beyond 2^26 in size count as 2^26, so that errors fit their type; rows of equal ids are rows of their
own, each a possible first entry in the order of its integers; of equal entries the lower index is used; null ids and
labels are values; an empty table gives empty codebooks and an empty table; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import discard, spool, spooled

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE, LIMIT = 1024, 1 << 26
BOUNDS, FEWEST = 16, 2  # of b, at first and at least
COVERED = 0.95
BROADCAST_BYTES = 16 << 20
BLOCK = 2048  # parts that are compared at once
UP = 1 + 1e-12


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component; null if the vector takes no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    return F.when((F.size(vector) > 0) & F.forall(vector, finite), F.transform(vector, whole))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of c, as integers."""
    top = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in c], axis=1)


class _Part:
    """One part position's codebook, and how its entries moved."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None):
        self.book = book
        if before is not None:
            self.moved = np.sqrt(((book - before) ** 2).sum(axis=1).astype(np.float64)) * UP
            self.most = self.moved.max()

    def afresh(self, x: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``b`` closest entries in order, and the bounds: those of all but the first, then the outer one."""
        near, low = np.empty((len(x), b), np.uint8), np.full((len(x), b), np.inf)
        k = min(b + 1, len(self.book))
        for at in range(0, len(x), BLOCK):
            d2 = squared(x[at : at + BLOCK], self.book)
            index = np.broadcast_to(np.arange(len(self.book)), d2.shape)
            if k < len(self.book) and d2.max(initial=0) < 1 << 54:  # a distance and its index in one number
                key = np.partition(d2 * 256 + index, k - 1, axis=1)[:, :k]
                key.sort(axis=1)
                order = key % 256
            else:
                order = np.lexsort((index, d2))[:, :k]
            near[at : at + BLOCK] = order[:, :b]
            far = np.sqrt(np.take_along_axis(d2, order, axis=1).astype(np.float64)) / UP
            low[at : at + BLOCK, : k - 1] = far[:, 1:]
        return near, low

    def step(self, x: np.ndarray, near: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries and bounds after the move, and how many bounds each part needed (all of them: compared with all entries)."""
        b = near.shape[1]
        assigned = self.book[near[:, 0]]
        reach = np.sqrt(((x - assigned) ** 2).sum(axis=1).astype(np.float64)) * UP
        low[:, : b - 1] -= self.moved[near[:, 1:]]
        low[:, b - 1] -= self.most
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        need = (low <= reach[:, None]).sum(axis=1)
        some = np.flatnonzero((need > 0) & (need < b))
        for at in range(0, len(some), BLOCK):
            rows = some[at : at + BLOCK]
            asked = near[rows]
            d2 = ((self.book[asked] - x[rows][:, None, :]) ** 2).sum(axis=2)
            later = np.arange(b) > need[rows][:, None]
            order = np.lexsort((asked, np.where(later, np.iinfo(np.int64).max - b + np.arange(b), d2)))
            near[rows] = np.take_along_axis(asked, order, axis=1)
            exact = np.sqrt(np.take_along_axis(d2, order, axis=1).astype(np.float64)) / UP
            mended = low[rows]
            mended[:, : b - 1] = np.where(later[:, 1:], mended[:, : b - 1], exact[:, 1:])
            low[rows] = np.minimum.accumulate(mended[:, ::-1], axis=1)[:, ::-1]
        every = np.flatnonzero(need >= b)
        if len(every):
            near[every], low[every] = self.afresh(x[every], b)
        return near, low, need


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Equally long binaries or lists as the rows of a matrix."""
    n = len(column)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _rows(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(matrix)], pa.binary())


STATE = "code binary, near binary, low binary, need int, error bigint"


def _state(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, b: int, kept: int) -> DataFrame:
    """id, label, ints, and per part the entries and bounds with these codebooks. ``kept``: b as it was written."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Part(books[p], None if before is None else before[p]) for p in range(parts)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(2), np.int64).reshape(n, parts, -1)
            if before is not None:
                near = _matrix(batch.column(3), np.uint8).reshape(n, parts, kept)[:, :, :b].copy()
                low = _matrix(batch.column(4), "<f4").reshape(n, parts, kept)[:, :, :b].astype(np.float64)
            else:
                near, low = np.empty((n, parts, b), np.uint8), np.empty((n, parts, b))
            need, error = np.full((n, parts), b), np.zeros(n, np.int64)
            for p, part in enumerate(held):
                mine = np.ascontiguousarray(x[:, p])
                if before is None:
                    near[:, p], low[:, p] = part.afresh(mine, b)
                else:
                    near[:, p], low[:, p], need[:, p] = part.step(mine, near[:, p], low[:, p])
                error += ((mine - part.book[near[:, p, 0]]) ** 2).sum(axis=1)
            low = np.nextafter(low.astype("<f4"), np.float32(-np.inf))  # rounded down
            made = [_rows(near[:, :, 0]), _rows(near.reshape(n, -1)), _rows(low.reshape(n, -1)), pa.array(need.max(axis=1), pa.int32()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=names)

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    names = ["id", "label", "ints", "code", "near", "low", "need", "error"]
    asked = rows.select("id", "label", "ints") if before is None else rows.select("id", "label", "ints", "near", "low")
    return asked.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, ints array<int>, {STATE}")


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry at the floor of its parts' mean. A task sums what it has read into a row an entry."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, wide), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), np.int64).reshape(-1, wide)
            cell = (_matrix(batch.column(1), np.uint8) + np.arange(parts) * entries).ravel()
            counts += np.bincount(cell, minlength=parts * entries)
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1))
            sums[cell[order][first]] += np.add.reduceat(x[order], first, axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cell", "n", "sums"])

    each = state.select("ints", "code").mapInArrow(run, "cell bigint, n bigint, sums array<bigint>")
    summed = each.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(wide)]).alias("sums"))
    new = books.copy()
    for cell, n, sums in summed.collect():  # a row an entry
        new[cell // entries, cell % entries] = [s // n for s in sums]
    return new


def _fewer(state: DataFrame, b: int) -> int:
    """b for the next round: what ``COVERED`` of the rows that weren't compared with all entries needed."""
    counts = dict(state.where(F.col("need") < b).groupBy("need").count().collect())
    rows = 0
    for need in sorted(counts):
        rows += counts[need]
        if rows >= COVERED * sum(counts.values()):
            return min(b, max(FEWEST, need + 1))
    return b


def fit(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bounds: int = BOUNDS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> tuple[np.ndarray, DataFrame]:
    """The final codebooks (parts x entries x components), and a written table of id, label, ``code`` (a byte a part) and ``error``."""
    if not 1 <= entries <= 256 or bounds < FEWEST:
        raise ValueError(f"entries are 1 to 256, bounds {FEWEST} or more")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), integers(F.col(vector_col)).alias("ints"))
    rows = rows.where(F.col("ints").isNotNull() & (F.size("ints") % parts == 0))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints").limit(1).collect()
    wide = len(first[0].ints) // parts if first else 0
    rows = rows.where(F.size("ints") == wide * parts)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()  # rows of bounded number
    books = np.array([r.ints for r in start], np.int64).reshape(len(start), parts, wide).swapaxes(0, 1)
    if not start:
        return books, rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    b = kept = min(bounds, len(start))
    state, path, before = rows, None, None
    for left in range(rounds, -1, -1):
        new, written = spooled(_state(state, books, before, b, kept), "codes")
        if path:
            discard(rows.sparkSession, path)
        state, path, kept = new, written, b
        if left:
            b = b if before is None else _fewer(state, b)
            before, books = books, _moved(state, books)
    return books, state.select("id", "label", "code", "error")


def compress(vectors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", **how) -> DataFrame:
    """id, ``code`` (two hexadecimal digits a part), ``error``, ``label_error`` (summed over equal labels), ``codebooks_sha256``."""
    books, coded = fit(vectors, id_col=id_col, label_col=label_col, **how)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = spool(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    size = sums.agg(F.sum(F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + 24)).first()[0] or 0
    joined = coded.join(F.broadcast(sums) if size <= BROADCAST_BYTES else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds spelled out for DuckDB, by all distances."""
    steps = [
        f"""
    v as materialized (select vec_id, label, [floor({SCALE} * x::double)::bigint for x in embedding] as ints from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as materialized (select vec_id, part, ints[part * (len(ints) // {parts}) + 1 : (part + 1) * (len(ints) // {parts})]::double[] as x
        from v, range({parts}) t(part)),
    b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c
        from p where vec_id in (select vec_id from v order by vec_id limit {entries}))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
    d{r} as materialized (select vec_id, part, x, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := entry)) as m
        from p join b{r} using (part) group by all)""")
        if r < rounds:
            steps.append(f"""
    s{r} as (select part, entry, list(floor(total / n) order by i) as c from (
        select part, m.e as entry, i, sum(x[i]) as total, count(*) as n from d{r}, range(1, 1 + len(x)) t(i) group by all) group by all),
    b{r + 1} as materialized (select part, entry, coalesce(s{r}.c, b{r}.c) as c from b{r} left join s{r} using (part, entry))""")
    return f"""
    with {",".join(steps)},
    coded as (select vec_id, string_agg(printf('%02x', m.e::int), '' order by part) as code, sum(m.d)::bigint as error from d{rounds} group by vec_id)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
        (select sha256(string_agg(array_to_string([x::bigint for x in c], ','), ',' order by part, entry)) from b{rounds}) as codebooks_sha256
    from coded join v using (vec_id)"""
