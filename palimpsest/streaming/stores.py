"""Streams: sessions' latest records, replay state, and windowed counts.

Batch and stream use the same functions: the batch fold and the streaming fold give equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.ordering import latest_wins
from palimpsest.operators.stores import upsert
from palimpsest.plans.replay import KEY, fold_group
from palimpsest.session import discard, paths_like, spool


def start_upserts(
    stream: DataFrame, folder: str, checkpoint: str, key: str, updated: str, kept: tuple[str, ...] = (), trigger: dict | None = None, buckets: int = 64
):
    """Keep a table of each key's latest record. Keys are dealt to buckets; a micro-batch rewrites just the buckets that it
    has keys of, as their next version, so a batch that runs again gives the same version. Of a bucket the version before
    the newest is kept for that, older ones are removed."""
    spark = stream.sparkSession
    _same_buckets(spark, folder, buckets)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        new = spool(latest_wins(batch, [key], updated), "micro-batch")
        touched = {r[0] for r in new.select(bucket).distinct().collect()}
        if not touched:
            return
        before = _newest(spark, folder, number - 1)
        old = _read(spark, [before[b] for b in touched if b in before], batch)
        upsert(old, new, [key], kept).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={number}")
        for v, b, path in _versions(spark, folder):
            if b in touched and b in before and v < before[b][0]:
                discard(spark, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _same_buckets(spark: SparkSession, folder: str, buckets: int) -> None:
    """The number of buckets is kept beside the table; another number would look for keys where they aren't."""
    if not paths_like(spark, f"{folder}/_buckets/_SUCCESS"):
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/_buckets")
    if (held := spark.read.parquet(f"{folder}/_buckets").first()[0]) != buckets:
        raise ValueError(f"{folder} has {held} buckets, not {buckets}")


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, int, str]]:
    """(version, bucket, path) of what is in the folder: at most a few versions of a fixed number of buckets."""
    paths = paths_like(spark, f"{folder}/v=*/bucket=*")
    return [(int(v.split("=")[1]), int(b.split("=")[1]), p) for p in paths for v, b in [p.rsplit("/", 2)[1:]]]


def _newest(spark: SparkSession, folder: str, number: int) -> dict[int, tuple[int, str]]:
    """Each bucket's newest version up to ``number``."""
    out: dict[int, tuple[int, str]] = {}
    for v, b, path in sorted(_versions(spark, folder)):
        if v <= number:
            out[b] = (v, path)
    return out


def _read(spark: SparkSession, parts: list[tuple[int, str]], like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(*[p for _, p in parts]) if parts else spark.createDataFrame([], like.schema)


def read_version(spark: SparkSession, folder: str, number: int, like: DataFrame) -> DataFrame:
    """The table after batch ``number``, the last or the one before it; before the first it's empty."""
    return _read(spark, list(_newest(spark, folder, number).values()), like)


def replay_stream(ops: DataFrame) -> DataFrame:
    """Operations as they arrive, folded into their unit's sentences, which are the state.

    ``ops``: key columns, seq, ord, op_type, old_text, new_part, count_, numbers, sentences (the unit's text
    before any). Rows of one key within a micro-batch are put in order; later batches follow earlier ones.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["seq", "ord"], kind="stable").reset_index(drop=True)
        before = list(state.get[0]) if state.exists else list(pdf["sentences"].iloc[0])
        after, results = fold_group(before, pdf)
        state.update((after,))
        out = pdf[["unit", "seq", "ord"]].copy()
        out["status"], out["note"] = zip(*results, strict=True)
        out["text"] = " ".join(after)
        yield out

    keyed = ops.withColumn("unit", F.to_json(F.struct(*KEY)))
    return keyed.groupBy("unit").applyInPandasWithState(
        step, "unit string, seq int, ord int, status string, note string, text string", "sentences array<string>", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by time window and key; in a stream, events later than ``late`` are left out."""
    kind = events.schema[ts].dataType
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    counts = timed.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("w.start").cast(kind).alias("window_start"), key, "n", "total")
