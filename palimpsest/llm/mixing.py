"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source; a source's target is its weight's share of all words, stopping at
``max_repeat`` times its own words, the excess going to the others by weight. A document is taken
floor(rate) times, rate being target over own words, plus one hash-seeded Bernoulli copy whose
probability is the fraction. Few long documents make independent draws miss a target by far, so the
draw's threshold is calibrated per source: it is the point of the source's own hash distribution,
weighed by words, below which the fraction of its words lies. The words taken then miss the target by
no more than about one document.

The threshold is found without sorting a source: words are summed per hash bin (a fixed number of bins
a source, combined before the shuffle), and only the bin where the fraction is crossed is looked into.

Defined results: null text has size 0 and is taken floor(rate) or one more time all the same; a null
source is a source, ordered last; rows equal in id and text are drawn alike; a source without words
has target 0; of two draws that miss the need alike the lesser is taken; a text of any length is one count; an empty
table gives an empty table. Columns of ``docs`` named like an added one are replaced, and those whose names start
with ``_mx_`` are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import spool

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEAT = 3
SEED = 20240601
#: A draw is a whole number below 2**53; its leading 12 bits are the bin.
DRAW_BITS, BIN_BITS = 53, 12
LOW_BITS = DRAW_BITS - BIN_BITS

ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str | Column) -> Column:
    """Words of a text as a long; 0 if null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*keys: str, seed: int = SEED) -> Column:
    """A row's uniform draw, a long in [0, 2**53), fixed by its keys and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), 64 - DRAW_BITS)


def source_targets(sizes: DataFrame, source: str, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """source, source_size -> also weight and target (double). One row a source, so one small window.

    Sources ordered by the cap in units of weight: those that stop at it are a prefix, each checked
    against the level that the rest would get.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(max_repeat)
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), F.col(source).asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(
        by_cap.rowsBetween(0, Window.unboundedFollowing)
    )
    return (
        sizes.select(source, "source_size", w.alias("weight"), cap.alias("_cap"))
        .withColumn("_all", F.sum("source_size").over(all_rows))
        .withColumn("_level", level)
        .withColumn("_capped", F.col("_cap") <= F.col("_level") * F.col("weight"))
        .withColumn("_share", F.max(F.when(~F.col("_capped"), F.col("_level"))).over(all_rows))
        .select(
            source,
            "source_size",
            "weight",
            F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_share") * F.col("weight")).alias("target"),
        )
    )


def mixing_plan(
    drawn: DataFrame, source: str = "source", weights: Sequence[float] = (1, 2, 3), max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """From rows of (source, size, draw): source, source_size, target, whole, threshold.

    A row is taken ``whole`` times, and once more if its draw is at most ``threshold``.
    """
    bins = drawn.groupBy(source, F.shiftright("draw", LOW_BITS).alias("bin")).agg(F.sum("size").alias("words"))
    sizes = bins.groupBy(source).agg(F.sum("words").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = (
        source_targets(sizes, source, weights, max_repeat)
        .withColumn("_rate", rate)
        .withColumn("whole", F.floor("_rate").cast("int"))
        .withColumn("_need", (F.col("_rate") - F.col("whole")) * F.col("source_size"))
    )
    up_to = Window.partitionBy(source).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    t = targets.select(F.col(source).alias("_source"), "source_size", "target", "whole", "_need")
    crossed = (
        bins.withColumn("_upto", F.sum("words").over(up_to))
        .join(t, F.col(source).eqNullSafe(F.col("_source")))
        .where((F.col("_upto") - F.col("words") <= F.col("_need")) & (F.col("_upto") > F.col("_need")))
        .select("_source", F.col("bin").alias("_bin"), (F.col("_upto") - F.col("words")).alias("_below"), "_need")
    )
    # In the crossed bin: where between two draws are the words taken nearest to the need?
    by_draw = Window.partitionBy("_source").orderBy("draw").rangeBetween(Window.unboundedPreceding, 0)
    inside = (
        drawn.withColumn("_at", F.shiftright("draw", LOW_BITS))
        .join(crossed, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_bin")))
        .withColumn("_miss", F.abs(F.col("_below") + F.sum("size").over(by_draw) - F.col("_need")))
        .where(F.col("_miss") < F.abs(F.col("_below") - F.col("_need")))
        .groupBy("_source")
        .agg(F.min_by("draw", F.struct("_miss", "draw")).alias("_best"))
        .select(F.col("_source").alias("_s"), "_best")
    )
    at = crossed.select(F.col("_source").alias("_c"), "_bin")
    return (
        targets.join(at, F.col(source).eqNullSafe(F.col("_c")), "left")
        .join(inside, F.col(source).eqNullSafe(F.col("_s")), "left")
        .select(
            source,
            "source_size",
            "target",
            "whole",
            F.coalesce(
                F.when(F.col("_need") <= 0, F.lit(-1).cast("long")),
                F.col("_best"),
                F.shiftleft("_bin", LOW_BITS) - 1,
                F.lit(-1).cast("long"),
            ).alias("threshold"),
        )
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    *,
    max_repeat: int = MAX_REPEAT,
    source: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    output: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` (or its ``output`` columns) with size, source_size, target, copies and taken.

    The narrow table of sizes and draws is written to the shared folder once; the plan by source is
    written too, so that Spark knows how small it is and broadcasts it only then.
    """
    keep = [c for c in (docs.columns if output is None else output) if c not in ADDED and not c.startswith("_mx_")]
    own = {
        "_mx_source": F.col(source), "_mx_size": word_count(text_col), "_mx_draw": draw(id_col, text_col, seed=seed),
    }
    wide = text_col in keep
    rows = docs.select(*([] if wide else keep), *[v.alias(k) for k, v in own.items()])
    narrow = spool(rows, "mix-sizes")
    drawn = narrow.select(F.col("_mx_source").alias(source), F.col("_mx_size").alias("size"), F.col("_mx_draw").alias("draw"))
    plan = spool(mixing_plan(drawn, source, weights, max_repeat), "mix-plan")
    plan = plan.select(F.col(source).alias("_mx_s"), "source_size", "target", F.col("whole").alias("_mx_whole"), F.col("threshold").alias("_mx_threshold"))
    rows = docs.select(*keep, *[v.alias(k) for k, v in own.items()]) if wide else narrow
    copies = (F.col("_mx_whole") + (F.col("_mx_draw") <= F.col("_mx_threshold")).cast("int")).alias("copies")
    return (
        rows.join(plan, F.col("_mx_source").eqNullSafe(F.col("_mx_s")))
        .select(*keep, F.col("_mx_size").alias("size"), "source_size", "target", copies)
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each document as often as ``copies`` says."""
    columns = [c for c in columns if not c.startswith("_mx_")]
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_mx_copy")).drop("_mx_copy")
