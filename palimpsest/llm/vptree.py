"""Nearest neighbours by largest inner product: vantage-point trees per shard.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero; then the
largest inner product is the smallest Euclidean distance, for which the triangle inequality holds.

The upper levels of the tree are vantage points and radii fitted to a bounded sample (``SAMPLE`` rows of least hash);
every row goes down them to its cell. A cell is a shard, or several pieces of a bounded size if it is large, as one of
equal vectors is. A query first searches its own cell. With the k-th best distance from there it goes down the upper
levels and is sent to just those other cells that ``factor`` times the triangle inequality's lower bound doesn't
exclude. Each shard builds its own tree once and takes its queries as a stream of blocks, a node at a time for all
queries of a block that still need the node. Factor 1 is exact search, larger factors skip more and may miss some. The
best of all shards are ranked at the end.

Leaves are compared by matrix products; what may be among the best is scored again one by one in double
precision on the original vectors, so equal vectors get equal scores wherever they lie.

Defined results: vectors null, empty, zero, or with null or non-finite components, and rows without an
id, take no part; only vectors of one length are compared; a row is no candidate of a query with its
own id; queries of one id are one, the least vector; ties go to the smaller id; fewer candidates than k: all of them;
an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import spool

SHARD_ROWS = 4096
CELLS = 16384  # at most, of one length of vectors: their vantage points are a few MB
SAMPLE = 65536  # rows at most to which the upper levels are fitted
LEAF = 64
SLACK = 1e-9  # of rounding, in squared distances and products of vectors of norm 1


def usable(vector: Column) -> Column:
    """Not null, zero or holding null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """A vantage-point tree over augmented rows; a node is (pivot, children), a leaf an index array.

    A child is (lowest and highest distance from the pivot, node).
    """

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows, self.leaf = rows, leaf
        self.root = self._build(np.arange(len(rows)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        pivot = self.rows[at[len(at) // 2]]
        far = np.sqrt(((self.rows[at] - pivot) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        at, far = at[order], far[order]
        half = len(at) // 2
        return pivot, [(far[0], far[half - 1], self._build(at[:half])), (far[half], far[-1], self._build(at[half:]))]


class Search:
    """The k nearest of a block of queries in one tree, of those that score ``floor`` or more."""

    def __init__(self, tree: Tree, products, distance2, queries: np.ndarray, k: int, factor: float, slack: float, floor: np.ndarray | None = None):
        self.tree, self.products, self.distance2 = tree, products, distance2
        self.queries, self.k, self.factor, self.slack = queries, k, factor, slack
        self.best = np.full((len(queries), k), -np.inf)
        if floor is not None:
            self.best[:] = floor[:, None]
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.nodes = self.compared = 0
        if len(tree.rows):
            self._visit(tree.root, np.arange(len(queries)))

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """Each query's distance to its k-th best so far."""
        return np.sqrt(np.maximum(self.distance2(q, self.best[q, 0]), 0) + self.slack)

    def _visit(self, node, q: np.ndarray) -> None:
        self.nodes += len(q)
        if isinstance(node, np.ndarray):
            self.compared += len(q) * len(node)
            s = self.products(q, node)
            near = s >= self.best[q, 0][:, None] - self.slack
            a, b = np.nonzero(near)
            self.found.append((q[a], node[b], s[a, b]))
            both = np.concatenate([self.best[q], s], axis=1)
            self.best[q] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k :], axis=1)
            return
        pivot, children = node
        d = np.sqrt(((self.queries[q] - pivot) ** 2).sum(axis=1))
        bounds = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi, _ in children]
        first = bounds[0] <= bounds[1]
        for turn in (0, 1):  # each query's nearer child first
            for c, (_, _, child) in enumerate(children):
                mine = first if (c == 0) == (turn == 0) else ~first
                go = mine & (self.factor * bounds[c] <= self._reach(q))
                if go.any():
                    self._visit(child, q[go])

    def results(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs among which the k best of each query are, rounding apart."""
        if not self.found:
            return np.empty(0, int), np.empty(0, int)
        q, row, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = s >= self.best[q, 0] - self.slack
        return q[keep], row[keep]


class Shard:
    """A shard's rows and their tree, built once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        norms2 = (vectors**2).sum(axis=1)
        self.top = float(norms2.max(initial=0.0))
        self.ids, self.vectors = ids, vectors
        self.tree = Tree(np.concatenate([vectors, np.sqrt(np.maximum(self.top - norms2, 0))[:, None]], axis=1), leaf)
        self.compared = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None):
        """query id, row id, score: each query's k best rows of the shard that score ``floor`` or more, ties to the smaller id."""
        ids, vectors = self.ids, self.vectors
        padded = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        q2 = (queries**2).sum(axis=1)
        own = {i: np.nonzero(query_ids == i)[0] for i in set(ids.tolist()) & set(query_ids.tolist())}
        column = np.array([i in own for i in ids.tolist()], dtype=bool)

        def products(q: np.ndarray, at: np.ndarray) -> np.ndarray:
            s = queries[q] @ vectors[at].T
            for c in np.nonzero(column[at])[0]:  # a row is no candidate of its own query
                s[np.isin(q, own[int(ids[at[c]])]), c] = -np.inf
            return s

        slack = SLACK * max(self.top, float(q2.max(initial=0.0)), 1e-300)
        found = Search(self.tree, products, lambda q, s: q2[q] + self.top - 2 * s, padded, k, factor, slack, floor)
        self.compared += found.compared
        q, row = found.results()
        apart = query_ids[q] != ids[row]
        q, row = q[apart], row[apart]
        score = np.zeros(len(q))
        for d in range(vectors.shape[1]):  # term by term, as the sum is written
            score += queries[q, d] * vectors[row, d]
        order = np.lexsort((ids[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top_k = rank < k
        return query_ids[q[top_k]], ids[row[top_k]], score[top_k]


class Upper:
    """The upper levels of the tree of one length of vectors: nodes (pivot, radius, inner, outer) or a cell's number."""

    def __init__(self, sample: np.ndarray, top: float, cells: int):
        self.top, self.cells = top, 0
        self.root = self._build(self._augmented(sample), cells)

    def _augmented(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors, np.sqrt(np.maximum(self.top - (vectors**2).sum(axis=1), 0))[:, None]], axis=1)

    def _build(self, rows: np.ndarray, cells: int):
        if cells > 1 and len(rows) > 1:
            # of a few rows as pivots, the one that sees the others at the most various distances
            tried = rows[:: max(1, len(rows) // 8)]
            far = np.sqrt(((rows[None, :256] - tried[:, None]) ** 2).sum(axis=2))
            pivot = tried[int(far.var(axis=1).argmax())]
            d = np.sqrt(((rows - pivot) ** 2).sum(axis=1))
            radius = float(np.median(d))
            inner = d <= radius
            if not inner.all():
                return pivot, radius, self._build(rows[inner], cells // 2), self._build(rows[~inner], cells - cells // 2)
        self.cells += 1
        return self.cells - 1

    def _down(self, node, points: np.ndarray, at: np.ndarray, reach: np.ndarray | None, factor: float, out: list) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            out.append((at, node))
            return
        pivot, radius, inner, outer = node
        d = np.sqrt(((points[at] - pivot) ** 2).sum(axis=1))
        if reach is None:
            sides = d <= radius, d > radius
        else:
            sides = factor * (d - radius) <= reach[at], factor * (radius - d) <= reach[at]
        for side, child in zip(sides, (inner, outer), strict=True):
            self._down(child, points, at[side], reach, factor, out)

    def cell_of(self, vectors: np.ndarray, rows: bool) -> np.ndarray:
        """The cell of each row (or query)."""
        out: list[tuple[np.ndarray, int]] = []
        self._down(self.root, self._augmented(vectors) if rows else np.pad(vectors, ((0, 0), (0, 1))), np.arange(len(vectors)), None, 1.0, out)
        found = np.zeros(len(vectors), dtype=np.int32)
        for at, cell in out:
            found[at] = cell
        return found

    def cells_near(self, queries: np.ndarray, floor: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) pairs: where rows that score more than ``floor`` may be."""
        q2 = (queries**2).sum(axis=1)
        slack = SLACK * max(self.top, float(q2.max(initial=0.0)), 1e-300)
        reach = np.sqrt(np.maximum(q2 + self.top - 2 * floor, 0) + slack)
        out: list[tuple[np.ndarray, int]] = []
        self._down(self.root, np.pad(queries, ((0, 0), (0, 1))), np.arange(len(queries)), reach, factor, out)
        if not out:
            return np.empty(0, int), np.empty(0, np.int32)
        return np.concatenate([at for at, _ in out]), np.concatenate([np.full(len(at), cell, np.int32) for at, cell in out])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def upper_levels(rows: DataFrame, shard_rows: int) -> dict[int, Upper]:
    """For each length of vectors its upper levels. What reaches the driver: a row a length, and the sample."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = {r["dim"]: (r["n"], r["top"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm2).alias("top")).collect()}
    total = sum(n for n, _ in sizes.values())
    cutoff = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * SAMPLE // max(total, 1))
    drawn = rows.withColumn("h", F.xxhash64("id", "v")).where(F.col("h") <= F.lit(cutoff))
    sample: dict[int, list] = {}
    for r in drawn.orderBy("h", "id").limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    none = lambda dim: np.empty((0, dim))
    return {dim: Upper(np.array(sample[dim]) if dim in sample else none(dim), top, min(CELLS, ceil(n / shard_rows))) for dim, (n, top) in sizes.items()}


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.asarray(batch.column(batch.schema.names.index("dim")))
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each of ``queries`` against all of ``vectors``.

    Rows are written once, with their cell, and shuffled once for each of the two searches; a query is shuffled once for
    each shard that it needs.
    """

    def narrow(df: DataFrame) -> DataFrame:
        return df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("dim")
        )

    levels = upper_levels(narrow(vectors), shard_rows)

    def to_cells(df: DataFrame, rows: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, part in _by_dim(batch):
                    if dim in levels:
                        cell = pa.array(levels[dim].cell_of(_matrix(part.column(1)), rows), pa.int32())
                        yield pa.RecordBatch.from_arrays([*part.columns, cell], names=["id", "v", "dim", "cell"])

        return df.mapInArrow(run, "id bigint, v array<double>, dim int, cell int")

    rows = spool(to_cells(narrow(vectors), True), "cells")
    least = narrow(queries).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.v", "x.dim")
    asked = spool(to_cells(least, False), "queries")
    pieces = spool(rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("pieces")), "pieces")
    dealt = rows.join(pieces, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id", "v"), "pieces").cast("int").alias("piece"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("floor"))

    def searched(sent: DataFrame) -> DataFrame:
        """Of (id, v, dim, cell, floor) queries the best of the pieces of those cells."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, shard = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.stack([np.asarray(batch.column(c)) for c in range(4)], axis=1)
                cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    part = batch.slice(i, j - i)
                    if (group := tuple(keys[i, :3].tolist())) != at:
                        at, held, shard = group, [], None
                    if keys[i, 3] == 0:
                        held.append((np.asarray(part.column(4)), _matrix(part.column(5))))
                    elif held:
                        if shard is None:
                            shard = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)))
                        found = shard.search(np.asarray(part.column(4)), _matrix(part.column(5)), k, factor, np.asarray(part.column(6)))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

        queries_of = sent.join(pieces, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("kind"), "id", "v", "floor")
        keys = ("dim", "cell", "piece")
        needed = dealt.join(queries_of.select(*keys).distinct(), list(keys), "left_semi").select(*queries_of.columns)
        return needed.unionByName(queries_of).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "query_id bigint, vec_id bigint, score double")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    home = spool(ranked(searched(asked.withColumn("floor", F.lit(float("-inf"))))), "home-cells")
    if all(u.cells < 2 for u in levels.values()):
        return home.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    kth = home.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    bounded = asked.join(kth, "id", "left").select("id", "v", "dim", "cell", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                q, cell = levels[dim].cells_near(_matrix(part.column(1)), np.asarray(part.column(4)), factor)
                q, cell = (x[cell != np.asarray(part.column(3))[q]] for x in (q, cell))
                for i in range(0, len(q), 4096):  # a query's vector is copied for each cell
                    some = part.take(pa.array(q[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in range(3)), pa.array(cell[i : i + 4096], pa.int32()), some.column(4)], names=["id", "v", "dim", "cell", "floor"])

    others = searched(bounded.mapInArrow(away, "id bigint, v array<double>, dim int, cell int, floor double"))
    return ranked(home.drop("rank").unionByName(others)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def oracle(k: int = 20, every: int = 20) -> str:
    """Exact search in DuckDB's SQL: all candidates of each query, ranked."""
    return f"""
        with v as (select vec_id, embedding::double[] as v from embeddings where len(embedding) > 0
                   and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % {every} = 0)
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
        from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= {k}"""
