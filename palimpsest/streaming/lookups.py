"""Stateful lookups that expire, and replay, in arbitrary state with time to live, on the RocksDB store.

``answered`` keeps each key's last known fact for a limited time. A stream carries facts and questions; a question is
answered from the state while its key's fact is alive, and else is a miss, to be looked up and sent back as a fact.
Expiry is the store's: an expired value isn't there any more, whether or not anything arrives for its key.

``replayed`` folds operations into their unit's sentences as ``stores.replay_stream`` does. Both survive a restart from
their checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.plans.replay import KEY, fold_group

#: How long a law's newest version counts as known: a fixed value of the service.
NEWEST_SECONDS = 6 * 60 * 60


def on_rocksdb(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB, which state with time to live needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Known(StatefulProcessor):
    """A key's fact, for ``seconds``, and how often it was asked for since."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        alive = int(self.seconds * 1000)
        self.fact = handle.getValueState("fact", "fact string", alive)
        self.asked = handle.getMapState("asked", "day string", "times long", alive)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values("ord", kind="stable")
        out = []
        for row in pdf.itertuples(index=False):
            if isinstance(row.fact, str):
                self.fact.update((row.fact,))
                continue
            known = self.fact.get()[0] if self.fact.exists() else None
            times = 1 + (self.asked.getValue(("all",))[0] if self.asked.containsKey(("all",)) else 0)
            self.asked.updateValue(("all",), (times,))
            out.append((key[0], int(row.ord), known, known is not None, times))
        yield pd.DataFrame(out, columns=["key", "ord", "fact", "hit", "times"])

    def close(self) -> None:
        pass


def answered(rows: DataFrame, seconds: float = NEWEST_SECONDS) -> DataFrame:
    """key, ord, fact, hit, times of each question of a stream (key, ord, fact): rows with a fact set it, rows without ask.

    Within a micro-batch a key's rows count in the order of ``ord``; null keys are a key; ``times`` counts a key's questions.
    """
    keyed = rows.select("key", F.col("ord").cast("long").alias("ord"), F.col("fact").cast("string").alias("fact")).groupBy("key")
    kind = rows.schema["key"].dataType.simpleString()
    return keyed.transformWithStateInPandas(_Known(seconds), f"key {kind}, ord long, fact string, hit boolean, times long", "Append", "ProcessingTime")


class _Unit(StatefulProcessor):
    """A unit's sentences."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sentences = handle.getValueState("sentences", "sentences array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["seq", "ord"], kind="stable").reset_index(drop=True)
        before = list(self.sentences.get()[0]) if self.sentences.exists() else list(pdf["sentences"].iloc[0])
        after, results = fold_group(before, pdf)
        self.sentences.update((after,))
        out = pdf[["unit", "seq", "ord"]].copy()
        out["status"], out["note"] = zip(*results, strict=True)
        out["text"] = " ".join(after)
        yield out

    def close(self) -> None:
        pass


def replayed(ops: DataFrame) -> DataFrame:
    """Operations as they arrive, folded into their unit's sentences; columns as of ``stores.replay_stream``."""
    keyed = ops.withColumn("unit", F.to_json(F.struct(*KEY)))
    return keyed.groupBy("unit").transformWithStateInPandas(_Unit(), "unit string, seq int, ord int, status string, note string, text string", "Append", "None")
