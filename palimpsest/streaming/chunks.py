"""Event streams that arrive in chunks cut anywhere: lines put together again, and their events.

A chunk is its first piece, whole lines, and an open rest; two chunks side by side are again that, so putting together
is associative, and a line's number is the count of line ends before it. These counts are sums of sums: within blocks
of ``BLOCK`` chunks, then over the blocks, so a stream that holds most chunks is no single task's work. Only the
pieces at a chunk's ends are shuffled; whole lines within a chunk stay where they are.

Defined results: a last line without an end is a line; null and empty chunks hold nothing; carriage returns before a
line's end aren't part of it; chunks of one stream and number count once, the least text; an empty table has no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096

#: What a line of an event begins with, and the one that ends a stream.
MARK, DONE = "data: ", "[DONE]"


def lines(chunks: DataFrame, stream: str, seq: str, text: str) -> DataFrame:
    """stream, line (from 0), text of each line of each stream. ``seq`` orders a stream's chunks, from 0 or anywhere."""
    once = chunks.groupBy(stream, seq).agg(F.min(F.coalesce(text, F.lit(""))).alias("_t"))
    cut = once.select(stream, F.col(seq).alias("_seq"), F.floor(F.col(seq) / BLOCK).alias("_block"), F.split("_t", "\n", -1).alias("_p"))
    cut = cut.withColumn("_ends", (F.size("_p") - 1).cast("long"))
    within = Window.partitionBy(stream, "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(stream, "_block").agg(F.sum("_ends").alias("_n"))
    before = Window.partitionBy(stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.select(F.col(stream).alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = cut.withColumn("_in", F.coalesce(F.sum("_ends").over(within), F.lit(0)))
    placed = placed.join(blocks, F.col(stream).eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    pieces = placed.select(stream, "_seq", "_ends", (F.col("_in") + F.col("_before")).alias("_first"), F.posexplode("_p").alias("_at", "_piece"))
    pieces = pieces.withColumn("line", F.col("_first") + F.col("_at"))
    inner = (F.col("_at") > 0) & (F.col("_at") < F.col("_ends"))
    whole = pieces.where(inner).select(stream, "line", F.col("_piece").alias("text"))
    ends = pieces.where(~inner & (F.col("_piece") != "")).groupBy(stream, "line")
    joined = ends.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_at", "_piece"))), lambda x: x["_piece"]), "").alias("text"))  # a line's pieces
    return whole.where("text <> ''").unionByName(joined).withColumn("text", F.regexp_replace("text", r"\r\z", "")).where("text <> ''")


def events(found: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """Lines that carry an event, with ``event`` (a struct of ``schema``) or, where the JSON is bad, ``corrupt``: its text."""
    said = found.where(F.startswith(F.col(text), F.lit(MARK))).withColumn("_raw", F.substring(text, len(MARK) + 1, 2**31 - 1)).where(~F.col("_raw").isin(DONE, ""))
    good = F.try_parse_json("_raw").isNotNull()
    return said.withColumns({"event": F.when(good, F.from_json("_raw", schema)), "corrupt": F.when(~good, F.col("_raw"))}).drop("_raw", text)
