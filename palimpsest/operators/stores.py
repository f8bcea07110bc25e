"""Stores of records: upserts, merges, deletions, lookups."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ordering import dealt, with_earlier


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """New rows replace old ones of the same key; ``kept`` columns keep the old value where there is one."""
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    present = n.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(present, on=same, how="full_outer")
    fresh = F.coalesce(F.col("n._new"), F.lit(False))
    out = []
    for c in old.columns:
        if c in keys or c in kept:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def delete(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the keys that were there to be deleted."""
    return df.join(gone, list(keys), "left_anti"), gone.join(df, list(keys), "left_semi").select(*keys).distinct()


def merge_maps(old: Column, new: Column, replace_keys: Sequence[str] = ()) -> Column:
    """One level: the new map's keys win, the old map's others stay, but for ``replace_keys``."""
    old = F.coalesce(old, F.create_map().cast("map<string,string>"))
    new = F.coalesce(new, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k) & ~k.isin(*replace_keys))
    return F.map_concat(rest, new)


def _merge(target: dict, patch: dict, whole: frozenset[str]) -> dict:
    out = dict(target)
    for k, v in patch.items():
        nested = isinstance(v, dict) and isinstance(out.get(k), dict) and k not in whole
        out[k] = _merge(out[k], v, whole) if nested else v
    return out


def deep_merge(target: Column, patch: Column, protected: Sequence[str] = (), replace_keys: Sequence[str] = ()) -> Column:
    """JSON objects merged to any depth: objects key by key, all else replaced; top-level ``protected`` keys
    stay, objects under ``replace_keys`` are replaced whole."""
    whole = frozenset(replace_keys)

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                old, new = json.loads(x or "{}"), json.loads(y or "{}")
            except ValueError:
                return x
            if not isinstance(old, dict) or not isinstance(new, dict):
                return x
            new = {k: v for k, v in new.items() if k not in protected}
            return json.dumps(_merge(old, new, whole), ensure_ascii=False)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(target, patch)


def safe_user(name: str | Column) -> Column:
    """A user's name as part of a path."""
    clean = F.regexp_replace(F.trim(F.col(name) if isinstance(name, str) else name), "[^A-Za-z0-9_-]", "_")
    return F.when(F.coalesce(clean, F.lit("")) == "", "ukendt").otherwise(clean)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def valid_as_of(rows: DataFrame, asked: DataFrame, key: str, at: str, valid_from: str) -> DataFrame:
    """Each asked (key, date) with the latest row that was valid then; none: nulls.

    Both are put in one order and the last valid row is carried forward, so no pairs are made; a key with many rows is
    carried through range by range. Null dates of rows come before all others; of rows of one key and date any counts.
    """
    carried = [c for c in rows.columns if c not in (key,)]
    a = rows.select(key, F.col(valid_from).alias("_t"), F.lit(0).alias("_k"), F.struct(*carried).alias("_row"), F.lit(None).cast(asked.schema[at].dataType).alias(at))
    b = asked.select(key, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), at)
    parts = dealt(a.unionByName(b), [key], "_t", "_k")
    last_here = F.max_by("_row", F.when(F.col("_k") == 0, F.struct("_t")))
    filled = with_earlier(parts, [key], last_here, partial(F.last, ignorenulls=True), "_earlier")
    here = F.last("_row", ignorenulls=True).over(Window.partitionBy("_range", key).orderBy("_t", "_k"))
    both = filled.withColumn("_row", F.coalesce(here, "_earlier"))
    return both.where("_k = 1").select(key, at, *[F.col("_row")[c].alias(c) for c in carried])
