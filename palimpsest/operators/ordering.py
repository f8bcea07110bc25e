"""Ordered operators: first wins, top-k, budgets, pages, titles, transcripts.

Order is always an explicit column: Spark's rows have none of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import spool


MOST_HELD = 100_000  # rows that a task of ``least_rows`` holds


def first_wins(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key. A least-row aggregate, combined before the shuffle, where Spark can order
    whole rows; hot keys then cost one row a task."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    columns = df.columns
    rank = F.struct(*[b.alias(f"_o{k}") for k, b in enumerate(by)])
    least = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("_row"))
    return least.select(*[F.col("_row")[c].alias(c) for c in columns])


def latest_wins(df: DataFrame, keys: Sequence[str], updated: str) -> DataFrame:
    """The last row of each key."""
    row = F.max_by(F.struct(*df.columns), F.col(updated)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[F.col("_row")[c].alias(c) for c in df.columns])


def checked(query: str, k: int, stores: Sequence[str], max_chars: int = 4000, max_k: int = 20, max_stores: int = 2) -> tuple[str, list[str]]:
    """A search's arguments, stripped; at most ``max_stores`` stores take part."""
    query = str(query or "").strip()
    if not query:
        raise ValueError("the query is empty")
    if len(query) > max_chars:
        raise ValueError(f"the query is longer than {max_chars} characters")
    if not 1 <= k <= max_k:
        raise ValueError(f"k must be from 1 to {max_k}")
    named = [s.strip() for s in stores if s.strip()][:max_stores]
    if not named:
        raise ValueError("no store is named")
    return query, named


def least_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, place: str = "place") -> DataFrame:
    """The k least rows of each key, with their ``place`` from 1, and ``rows``, how many the key has.

    Mergeable: a task keeps the k least rows of each key that it has seen and hands on only these, so a key that holds
    nearly all rows costs k rows a task, wherever they lie; a task that has seen very many keys hands on what it has and
    begins anew. What is left is sorted by key, and the first k are taken as they come by. No group is ever held.

    Keys and order columns are of plain types (text, numbers, dates, booleans). Null keys are a key, nulls in the order
    come last; rows that the order doesn't tell apart are interchangeable; ``df`` has no columns named as the new ones.
    """
    columns = [*df.columns, "rows"]
    ids, by = [f"_k{i}" for i in range(len(keys))], [(f"_o{i}", "ascending") for i in range(len(order))]

    def numbered(held: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """Rows in order, each row's key as a number, and its place within its key."""
        held = held.take(pa.compute.sort_indices(held, [*((c, "ascending") for c in ids), *by]))
        new = np.zeros(held.num_rows, bool)
        new[:1] = True
        for c in ids:
            column = held[c].combine_chunks()
            differs = pa.compute.not_equal(column[1:], column[:-1])
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= differs.fill_null(False).to_numpy(zero_copy_only=False) | (nulls[1:] != nulls[:-1])
        group = np.cumsum(new) - 1
        return held, group, np.arange(held.num_rows) - np.flatnonzero(new)[group]

    def least(held: pa.Table) -> pa.Table:
        held, group, at = numbered(held)
        total = np.bincount(group, held["rows"].to_numpy())[group].astype(np.int64)  # a key's rows stand with its first
        i = held.schema.get_field_index("rows")
        # The field stays as it came, null or not, so that what is held fits the batches still to come.
        return held.set_column(i, held.schema.field(i), pa.array(np.where(at == 0, total, 0))).filter(pa.array(at < k))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = least(new if held is None else pa.concat_tables([held, new]))
            if held.num_rows > MOST_HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    import pyarrow.compute  # noqa: F401  (used as pa.compute)

    plain = [F.col(c).alias(n) for c, n in zip([*keys, *order], [*ids, *(o for o, _ in by)], strict=True)]
    made = df.select("*", F.lit(1).cast("long").alias("rows"), *plain)
    schema = made.schema
    some = spool(made.mapInArrow(combine, schema), "least-rows")
    counts = some.groupBy(*ids).agg(F.sum("rows").alias("rows"))
    dealt = (some.repartition(*ids) if ids else some.coalesce(1)).sortWithinPartitions(*ids, *[F.col(o).asc_nulls_last() for o, _ in by])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            key = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ids], strict=True)) if ids else [()] * batch.num_rows
            at = np.empty(batch.num_rows, np.int64)
            for i, x in enumerate(key):
                seen = seen + 1 if x == last and last is not None else 1
                last = x
                at[i] = seen
            out = pa.Table.from_batches([batch]).append_column(place, pa.array(at)).filter(pa.array(at <= k))
            yield from out.to_batches()

    from pyspark.sql.types import LongType, StructType

    taken = dealt.mapInArrow(first, StructType([*schema.fields]).add(place, LongType())).drop("rows", *[o for o, _ in by])
    counts = counts.withColumnsRenamed({c: f"{c}r" for c in ids})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}r")) for c in ids], F.lit(True))
    return taken.join(counts, same).select(*columns[:-1], place, "rows")


def merged_stores(stores: Sequence[str], load: Callable[[str], DataFrame]) -> DataFrame:
    """Hits of all stores that answer; a store that fails is left out, all failing is an error.

    A store may fail when it is read rather than named, so its hits are written once, here; what they are asked for is
    meant to be hits, not the store. Failures are Spark's own and the network's; a programming error is none.
    """
    found = []
    for k, store in enumerate(stores):
        try:
            found.append(spool(load(store).withColumn("store_ord", F.lit(k)), f"hits-{k}"))
        except (PySparkException, Py4JJavaError, OSError):
            continue
    if not found:
        raise RuntimeError("no store answered")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def search_topk(hits: DataFrame, k: int, *, score: str = "score", key: Sequence[str] = ("file_id", "text"), order: Sequence[str] = ("store_ord", "ord")) -> DataFrame:
    """The k best hits, each key once by its best score; equal scores in the given order. Hits without text
    don't count."""
    usable = hits.where((F.col("text").isNotNull()) & (F.col("text") != "")).withColumn(score, F.coalesce(score, F.lit(0.0)))
    by = [F.desc(score), *[F.asc(o) for o in order]]
    best = first_wins(usable, key, -F.col(score), *order)
    return best.orderBy(*by).limit(k)


# --- running values of keys of any size --------------------------------------------------------------


def dealt(df: DataFrame, key: Sequence[str], *order: str | Column) -> DataFrame:
    """``df`` in ranges of key and order, written, with ``_range``, the range's number.

    A key that holds many rows lies in many ranges, one after the other in its order, and no task gets more than a range.
    Rows equal in key and order share one.
    """
    return spool(df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def with_earlier(parts: DataFrame, key: Sequence[str], of_range: Column, together: Callable[[str], Column], out: str) -> DataFrame:
    """``parts`` of ``dealt`` with ``out``: ``of_range``, an aggregate, of the key's earlier ranges, put ``together``.

    A running value is then that of the row's own range, by a window over range and key, after ``out``. Only the first
    key of a range has earlier ones, so what is broadcast is at most a row a range; other rows have null.
    """
    ends = parts.groupBy("_range", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(of_range.alias("_end"))
    names = [f"_k{i}" for i in range(len(key))]
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.withColumn(out, together("_end").over(before)).where(F.col(out).isNotNull()).drop("_end").withColumnRenamed("_range", "_r")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names, strict=True)], F.col("_range") == F.col("_r"))
    return parts.join(F.broadcast(earlier), same, "left").drop("_r", *names)


def with_count(df: DataFrame, key: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``: how many rows its key has. Counted before the shuffle; a hot key's rows stay where they are or
    are split by the adaptive join."""
    names = [f"_n{i}" for i in range(len(key))]
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)]).agg(F.count("*").alias(out))
    if not key:
        return df.crossJoin(F.broadcast(counts))  # one row
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names, strict=True)])
    return df.join(counts, same).drop(*names)


def char_budget(df: DataFrame, text: str, budget: int, newest: Sequence[str | Column], group: Sequence[str] = (), out: str = "kept_text", mark: str = "") -> DataFrame:
    """Rows in order while their texts fit into ``budget`` characters; the last is cut to what remains. Null and empty
    texts are left out; a group of any size, or the whole table without one, is summed by ranges."""
    parts = dealt(df.where(F.length(text) > 0), group, *newest)
    here = Window.partitionBy("_range", *group).orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1)
    summed = with_earlier(parts, group, F.sum(F.length(text)), F.sum, "_earlier")
    used = F.coalesce(F.sum(F.length(text)).over(here), F.lit(0)) + F.coalesce("_earlier", F.lit(0))
    left = F.col("_left")
    cut = F.when(F.length(text) > left, F.concat(F.left(F.col(text), left.cast("int")), F.lit(mark))).otherwise(F.col(text))
    return summed.withColumn("_left", F.lit(budget) - used).where("_left > 0").withColumn(out, cut).drop("_left", "_range", "_earlier")


def shared_budget(df: DataFrame, text: str, budget: int, order: Sequence[str | Column], group: Sequence[str] = (), least: int = 500) -> DataFrame:
    """Each row gets an equal share of the budget, ``least`` at least, then the total holds."""
    share = F.greatest(F.lit(least), F.floor(F.lit(budget) / F.col("_n"))).cast("int")
    cut = with_count(df, group, "_n").withColumn("_cut", F.left(F.col(text), share))
    return char_budget(cut, "_cut", budget, order, group).drop("_cut", "_n")


def pages(df: DataFrame, key: Sequence[str], items: str, size: int) -> DataFrame:
    """Items of an array by pages of ``size``: page (from 1), total_pages, page_text."""
    total = F.greatest(F.ceil(F.size(items) / F.lit(size)), F.lit(1)).cast("int")
    page = F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page")
    numbered = df.select(*key, items, total.alias("total_pages")).select(*key, items, "total_pages", page)
    text = F.array_join(F.slice(items, (F.col("page") - 1) * size + 1, F.lit(size)), "\n\n")
    return numbered.select(*key, "page", "total_pages", text.alias("page_text"))


def clamp_page(page: Column, total: Column) -> Column:
    return F.least(F.greatest(page, F.lit(1)), total)


def default_title(messages: DataFrame, key: str, order: str, role: str, text: str, most: int = 50) -> DataFrame:
    """key, title: the first message of the user, cut with an ellipsis."""
    first = F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(order))).alias("_t")
    title = F.when(F.length("_t") > most, F.concat(F.rtrim(F.left("_t", F.lit(most))), F.lit("..."))).otherwise(F.col("_t"))
    return messages.groupBy(key).agg(first).select(key, F.coalesce(title, F.lit("")).alias("title"))


def transcript(messages: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """key, transcript: non-empty messages in order, each under its role."""
    said = messages.where((F.col(text).isNotNull()) & (F.trim(text) != ""))
    line = F.struct(F.col(order).alias("o"), F.concat(F.col(role), F.lit(": "), F.trim(text)).alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n")
    return said.groupBy(key).agg(joined.alias("transcript"), F.count("*").alias("messages"))


def numbered(df: DataFrame, order: str | Column | Sequence[str | Column], out: str, key: Sequence[str] = ()) -> DataFrame:
    """``df`` with a long ``out``: each row's place by ``order``, from 1, within its key or, without one, in the table.

    Neither a table nor a key is gathered: see ``dealt``. Rows equal in ``order`` are numbered in any order.
    """
    by = [order] if isinstance(order, (str, Column)) else list(order)
    counted = with_earlier(dealt(df, key, *by), key, F.count("*"), F.sum, "_earlier")
    place = F.row_number().over(Window.partitionBy("_range", *key).orderBy(*by))
    return counted.withColumn(out, place + F.coalesce("_earlier", F.lit(0)).cast("long")).drop("_range", "_earlier")


def remaining_steps(versions: DataFrame, order: str, key: Sequence[str] = ()) -> DataFrame:
    """How many versions are left from each on, at least one; of each ``key`` apart, if there is one."""
    placed = with_count(numbered(versions, order, "_at", key), key, "_n")
    return placed.withColumn("remaining", F.greatest(F.lit(1), F.col("_n") - F.col("_at") + 1).cast("int")).drop("_at", "_n")


def by_priority(df: DataFrame, key: str, ranks: dict[str, int], default: int = 999) -> DataFrame:
    """Rows with ``priority``: a key's rank, a default where it has none."""
    rank = F.lit(default)
    for k, n in ranks.items():
        rank = F.when(F.col(key) == k, n).otherwise(rank)
    return df.withColumn("priority", rank)


def numbered_pool(slots: DataFrame, pool: DataFrame, slot_order: str, pool_order: str) -> DataFrame:
    """The i-th slot with the i-th item of a pool; slots beyond the pool have none."""
    items = numbered(pool, pool_order, "_i").drop(pool_order)
    return numbered(slots, slot_order, "_i").join(items, "_i", "left").drop("_i")


def forward_fill(df: DataFrame, value: str, key: Sequence[str], order: str) -> DataFrame:
    """``value`` of the last row that has one, up to each row of its key; null before the first. Nulls in the order come
    first; of rows equal in it any may be the last."""
    last_here = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(order)))
    filled = with_earlier(dealt(df, key, order), key, last_here, partial(F.last, ignorenulls=True), "_earlier")
    here = F.last(value, ignorenulls=True).over(Window.partitionBy("_range", *key).orderBy(order))
    return filled.withColumn(value, F.coalesce(here, "_earlier")).drop("_range", "_earlier")
