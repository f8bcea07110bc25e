"""Long lookups that tell how far they are: a walk along version chains, emitted step by step by a stream.

The stream feeds itself: its source is the folder of frontiers, and each micro-batch writes what it has reached
(``found/n=<batch>``) and the next step's frontier, which later batches read. ``files`` limits how much a batch takes, so a reader
sees a first answer after one small step, however large the lookup is; the steps' rows put together are the batch
walk's. Files of a batch are replaced when it runs again, so a lookup that was stopped goes on from its checkpoint with
nothing told twice.

Defined results: those of ``graph.walk``: of several edges of a node the least target counts, null starts and targets are
none, starts that repeat are one, a walk ends at a node that it has been at or after ``max_steps`` nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palimpsest.session import paths_like, spool

MAX_STEPS = 8


def prepare(edges: DataFrame, starts: DataFrame, folder: str) -> DataFrame:
    """The first frontier in ``folder``, and the edges (src, dst) that a walk takes, written once."""
    at = F.col(starts.columns[0])
    first = starts.select(at.alias("start")).where("start is not null").distinct()
    first.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path")).write.mode("overwrite").parquet(f"{folder}/frontier/n=start")
    known = edges.select("src", "dst").where("src is not null and dst is not null")
    return spool(known.groupBy("src").agg(F.min("dst").alias("dst")), "walk-edges")


def start(spark: SparkSession, edges: DataFrame, folder: str, max_steps: int = MAX_STEPS, files: int = 8) -> StreamingQuery:
    """The stream that walks on from the frontiers in ``folder``; ``processAllAvailable`` waits for its end."""
    kind = edges.schema["dst"].dataType.simpleString()
    schema = f"start {kind}, node {kind}, depth int, path array<{kind}>"

    def step(batch: DataFrame, number: int) -> None:
        batch.select("start", "node", "depth").write.mode("overwrite").parquet(f"{folder}/found/n={number}")
        onward = batch.join(edges, F.col("node") == F.col("src")).where((F.col("depth") + 1 < max_steps) & ~F.array_contains("path", F.col("dst")))
        onward = onward.select("start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        reached = spool(onward, "frontier")
        if not reached.isEmpty():
            reached.write.mode("overwrite").parquet(f"{folder}/frontier/n={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/frontier/*")
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds").start()


def increments(spark: SparkSession, folder: str) -> DataFrame:
    """step, start, node, depth: what each step of the stream has told so far."""
    if not paths_like(spark, f"{folder}/found/n=*/_SUCCESS"):
        raise LookupError(f"{folder}: nothing found yet")
    return spark.read.option("basePath", f"{folder}/found").parquet(f"{folder}/found/n=*").withColumnRenamed("n", "step")


def messages(query: StreamingQuery) -> list[str]:
    """A line for each step of late, of the stream's own metrics."""
    return [f"trin {p.batchId}: {p.numInputRows} udgaver" for p in query.recentProgress if p.numInputRows]


def told(edges: DataFrame, starts: DataFrame, folder: str, max_steps: int = MAX_STEPS, files: int = 8) -> DataFrame:
    """The whole walk by steps: ``increments`` once the stream has nothing more to do."""
    spark = edges.sparkSession
    query = start(spark, prepare(edges, starts, folder), folder, max_steps, files)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return increments(spark, folder)
