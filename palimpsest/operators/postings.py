"""An inverted index as a stored table: terms to the places in documents that touch them, kept up to date by deltas.

A folder holds segments and a log:

* ``segments/<name>/postings``: (bucket, term, doc, and what the caller keeps of a posting), a folder a bucket of terms,
  sorted by term within it, so that a lookup reads its terms' buckets and of these the row groups that hold them.
* ``segments/<name>/documents``: the documents for which the segment speaks, with their postings or with none.
* ``log/<version>``: one row, the segments that count, oldest first, and the number of buckets.

A delta is a new segment. It replaces all earlier postings of its documents; documents without postings in it are
withdrawn. A segment counts once a log version names it, and a version can be written only once, so a reader sees a
delta whole or not at all, a writer that was overtaken by another fails with nothing changed, and what a lost job left
behind isn't named by any version. ``merge`` rewrites what is live as one segment; readers of older versions are served
until ``vacuum`` removes what the newest version doesn't name.

Which postings are live is a comparison of two small columns: a posting counts if its document is in no later segment.

Defined results: a null term is none; a null document is a document like others; repeated postings stay; an empty delta
adds an empty segment; an index without a log is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import discard, paths_like

BUCKETS = 64
MOST_SEGMENTS = 8


class Index:
    """The index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, term: str = "term", doc: str = "doc"):
        self.spark, self.folder, self.term, self.doc = spark, folder.rstrip("/"), term, doc

    def _log(self) -> tuple[int, list[str], int | None]:
        """The newest version, its segments, and the number of buckets."""
        done = [int(p.rsplit("/", 2)[1]) for p in paths_like(self.spark, f"{self.folder}/log/*/_SUCCESS")]
        if not done:
            return 0, [], None
        row = self.spark.read.parquet(f"{self.folder}/log/{max(done)}").first()
        return max(done), list(row["segments"]), row["buckets"]

    def _commit(self, version: int, segments: list[str], buckets: int) -> None:
        row = self.spark.createDataFrame([(segments, buckets)], "segments array<string>, buckets int")
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/log/{version}")

    def _write(self, postings: DataFrame, documents: DataFrame, buckets: int) -> str:
        name = uuid.uuid4().hex
        dealt = postings.where(F.col(self.term).isNotNull()).withColumn("bucket", self._bucket(F.col(self.term), buckets))
        # A bucket with a hot term is split by document as well, so no task writes more than its share.
        dealt = dealt.repartition("bucket", F.pmod(F.xxhash64(self.doc), F.lit(16))).sortWithinPartitions("bucket", self.term, self.doc)
        dealt.write.partitionBy("bucket").parquet(f"{self.folder}/segments/{name}/postings")
        documents.select(self.doc).distinct().write.parquet(f"{self.folder}/segments/{name}/documents")
        return name

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    def update(self, postings: DataFrame, documents: DataFrame, buckets: int = BUCKETS) -> None:
        """Add a delta. ``documents``: those it speaks for, among them all of its postings' and what it withdraws.

        The number of buckets is the first delta's. When there are many segments they are merged.
        """
        version, segments, known = self._log()
        name = self._write(postings, documents, known or buckets)
        self._commit(version + 1, [*segments, name], known or buckets)
        if len(segments) >= MOST_SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """Make one segment of what is live."""
        version, segments, buckets = self._log()
        if buckets is None:
            return
        live = self._live(segments)
        name = self._write(live, live, buckets)
        self._commit(version + 1, [name], buckets)

    def vacuum(self) -> None:
        """Remove segments and versions that the newest version doesn't name; for when nobody reads older ones."""
        version, segments, _ = self._log()
        for path in paths_like(self.spark, f"{self.folder}/segments/*"):
            if path.rsplit("/", 1)[1] not in segments:
                discard(self.spark, path)
        for path in paths_like(self.spark, f"{self.folder}/log/*"):
            if int(path.rsplit("/", 1)[1]) < version:
                discard(self.spark, path)

    def _documents(self, segments: list[str]) -> DataFrame:
        """Each document with its newest segment's number."""
        read = [self.spark.read.parquet(f"{self.folder}/segments/{s}/documents").select(F.col(self.doc).alias("_doc"), F.lit(k).alias("_newest")) for k, s in enumerate(segments)]
        return reduce(DataFrame.unionByName, read).groupBy("_doc").agg(F.max("_newest").alias("_newest"))

    def _live(self, segments: list[str], wanted: Column | None = None) -> DataFrame:
        read = []
        for k, s in enumerate(segments):
            if not paths_like(self.spark, f"{self.folder}/segments/{s}/postings/bucket=*"):
                continue  # withdrawals only
            one = self.spark.read.parquet(f"{self.folder}/segments/{s}/postings")
            read.append((one if wanted is None else one.where(wanted)).drop("bucket").withColumn("_segment", F.lit(k)))
        if not read:
            raise LookupError(f"{self.folder}: no postings")
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)
        if len(segments) == 1:
            return every.drop("_segment")
        newest = self._documents(segments)
        # Only documents of later segments can overrule a posting, so the first segment's needn't be asked for.
        newer = newest.where("_newest > 0")
        joined = every.join(newer, F.col(self.doc).eqNullSafe(F.col("_doc")), "left")
        return joined.where(F.coalesce("_newest", F.lit(0)) == F.col("_segment")).select(*[c for c in every.columns if c != "_segment"])

    def postings(self, terms: Sequence | None = None) -> DataFrame:
        """All live postings, or those of some terms, of which only their buckets are read."""
        _, segments, buckets = self._log()
        if buckets is None:
            raise LookupError(f"{self.folder}: no index")
        if terms is None:
            return self._live(segments)
        known = self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t"), buckets)).distinct().collect()
        return self._live(segments, F.col("bucket").isin([r[0] for r in known]) & F.col(self.term).isin(list(terms)))

    def documents(self) -> DataFrame:
        """The documents of which any segment speaks, withdrawn ones and ones without postings too."""
        return self._documents(self._log()[1]).select(F.col("_doc").alias(self.doc))
