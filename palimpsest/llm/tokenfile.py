"""Token-id files: documents' ids, each compressed on its own with one shared zstandard dictionary.

A token folder holds three Parquet tables that Spark itself writes and reads, so that its committer
copes with lost tasks and any store will do:

* ``dictionary``: one row, (dict_hash, dictionary): the trained dictionary, of bounded size.
* ``blocks``: rows of (part, block, dict_hash, min_id, max_id, doc_ids, offsets, lengths, tokens, payload),
  ascending by id within and across parts. ``payload`` is the concatenation of the documents' frames;
  ``offsets`` and ``lengths`` find a single document's frame without touching the others, ``min_id`` and
  ``max_id`` (null ids apart) let Parquet skip the blocks that can't hold it.
* ``index``: (part, part_tokens): the ids in each part, from which starts are summed.

A frame is the zstandard compression of a document's ids as little-endian unsigned 32-bit integers. The
dictionary is trained on a bounded sample of serialised documents, ``DICTIONARY_DOCS`` of least hash, of
which rows beyond a cutoff are left out before anything is shuffled; it changes sizes only. Everything
else covers every document.

Order is by a range shuffle of the raw rows on (id, hash of the text); a document is encoded and
compressed once, in the task that writes it.

Defined results: null text is an empty document, just the end id; ids that are null come first; rows of
one id follow each other by the hash of their texts; a text of any length is one frame, made and read in
one piece; other columns, whatever their names, are ignored; an empty table gives empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tokens import encoder
from palimpsest.session import spool

DICTIONARY_DOCS = 2000
DICTIONARY_BYTES = 64 << 10
SAMPLE_CHARS = 16 << 20
LEVEL = 3
BLOCK_BYTES = 1 << 20
PART_BYTES = 64 << 20  # of raw text in a range of ids, whatever the session's number of partitions


@dataclass(frozen=True)
class Coding:
    """How texts become ids."""

    vocabulary: str
    spaced: bool
    end_id: int

    def ids(self, text: str | None) -> bytes:
        return encoder(self.vocabulary, self.spaced).encode(text) + self.end_id.to_bytes(4, "little")


def train_dictionary(docs: DataFrame, coding: Coding, id_col: str = "doc_id", text_col: str = "text") -> tuple[bytes, int]:
    """A zstandard dictionary for serialised ids, from the ``DICTIONARY_DOCS`` rows of least hash, and the bytes of all texts.

    The bound: so many rows, of which those are left out with which the texts before and up to them
    exceed ``SAMPLE_CHARS`` in all. Too little to train on: an empty dictionary. One pass over the texts
    sums their sizes and keeps the rows below a cutoff of hashes that twice as many are expected to reach;
    the number of rows is in the files' footers. Rows of one hash (equal in id and text) are one.
    """
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([coding.ids(t.as_py()) for t in batch.column(0)], pa.binary())], names=["ids"])

    cutoff = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * DICTIONARY_DOCS // max(docs.count(), 1))
    seen = Observation()
    hashed = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t"))
    low = hashed.observe(seen, F.sum(F.octet_length("t")).alias("size")).where(F.col("h") <= F.lit(cutoff))
    low = low.where(F.coalesce(F.length("t"), F.lit(0)) <= SAMPLE_CHARS).groupBy("h").agg(F.first("t").alias("t"))
    sample = spool(low, "dictionary-sample").orderBy("h").limit(DICTIONARY_DOCS)
    so_far = F.sum(F.coalesce(F.length("t"), F.lit(0))).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    bounded = sample.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_CHARS)
    parts = [bytes(r[0]) for r in bounded.select("t").mapInArrow(run, "ids binary").collect()]
    size = seen.get["size"] or 0
    if len(parts) < 8 or sum(map(len, parts)) < DICTIONARY_BYTES:
        return b"", size
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, parts)) // 8), parts).as_bytes(), size
    except zstandard.ZstdError:
        return b"", size


def dictionary_hash(dictionary: bytes) -> int:
    return zlib.crc32(dictionary)


def write(docs: DataFrame, folder: str, coding: Coding, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> None:
    """Write ``docs`` as a token folder in ascending order of ids."""
    import zstandard

    spark = docs.sparkSession
    dictionary, size = train_dictionary(docs, coding, id_col, text_col)
    digest = dictionary_hash(dictionary)
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash bigint, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=True).compress
        part, block, keys, frames, tokens, held, kind = 0, 0, [], [], [], 0, pa.int64()

        def flush() -> pa.RecordBatch:
            sizes = [len(f) for f in frames]
            starts = np.cumsum([0, *sizes[:-1]])
            known = [k for k in (keys[0], keys[-1]) if k is not None]  # nulls come first
            least = next((k for k in keys if k is not None), None)
            row = [
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([digest], pa.int64()),
                pa.array([least], kind), pa.array([known[-1] if known else None], kind), pa.array([keys], pa.list_(kind)),
                pa.array([starts.tolist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([tokens], pa.list_(pa.int64())),
                pa.array([b"".join(frames)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, names=["part", "block", "dict_hash", "min_id", "max_id", "doc_ids", "offsets", "lengths", "tokens", "payload"])

        for batch in batches:
            kind = batch.schema.field("key").type
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coding.ids(text.as_py())
                frame = compress(ids)
                keys.append(key)
                frames.append(frame)
                tokens.append(len(ids) // 4)
                held += len(frame)
                if held >= block_bytes:
                    yield flush()
                    block, keys, frames, tokens, held = block + 1, [], [], [], 0
        if keys:
            yield flush()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange(n, F.col("key").asc_nulls_first(), "h").sortWithinPartitions(F.col("key").asc_nulls_first(), "h")
    schema = f"part int, block int, dict_hash bigint, min_id {id_type}, max_id {id_type}, doc_ids array<{id_type}>, offsets array<bigint>, lengths array<bigint>, tokens array<bigint>, payload binary"
    blocks = ordered.select("key", "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    written = spark.read.parquet(f"{folder}/blocks")
    written.groupBy("part").agg(F.sum(total).alias("part_tokens")).coalesce(1).write.parquet(f"{folder}/index")


def read_dictionary(spark: SparkSession, folder: str) -> tuple[int, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    digest, dictionary = row["dict_hash"], bytes(row["dictionary"])
    if dictionary_hash(dictionary) != digest:
        raise ValueError(f"{folder}: the dictionary isn't the one that was written")
    return digest, dictionary


def _frames(spark: SparkSession, folder: str, blocks: DataFrame, digest_only: bool, id_type: str) -> DataFrame:
    import zstandard

    digest, dictionary = read_dictionary(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        expand = zstandard.ZstdDecompressor(dict_data=shared).decompress
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                if row["dict_hash"].as_py() != digest:
                    raise ValueError(f"{folder}: a block was written with another dictionary")
                payload = memoryview(row["payload"].as_buffer())
                keys = row["doc_ids"].values
                offsets, lengths, tokens = (np.asarray(row[c].values) for c in ("offsets", "lengths", "tokens"))
                starts = row["start"].as_py() + np.cumsum(tokens) - tokens
                for a in range(0, len(tokens), 4096):
                    cut = slice(a, a + 4096)
                    raw = [expand(payload[o : o + n]) for o, n in zip(offsets[cut], lengths[cut], strict=True)]
                    size = pa.array([len(x) // 4 for x in raw], pa.int64())
                    if digest_only:
                        last = pa.array([zlib.crc32(x) for x in raw], pa.int64())
                    else:
                        ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                        last = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                    yield pa.RecordBatch.from_arrays([keys[cut], pa.array(starts[cut], pa.int64()), size, last], names=["key", "start", "n_tokens", "last"])

    kind = "bigint" if digest_only else "array<int>"
    return blocks.mapInArrow(run, f"key {id_type}, start bigint, n_tokens bigint, last {kind}")


def read(spark: SparkSession, folder: str, *, digest_only: bool = False, id_col: str = "doc_id", only: list | None = None) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, and ``ids`` or, with ``digest_only``, the
    unsigned CRC-32 of their bytes as ``ids_crc32``. ``only``: read just the blocks that hold these ids.

    Starts: the parts' sums run over one row a part; blocks are summed within their part.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    parts = spark.read.parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    sizes = blocks.select("part", "block", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("block_start")).join(parts, "part")
    starts = starts.select("part", "block", (F.col("part_start") + F.col("block_start")).alias("start"))
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    wanted = blocks
    if only is not None:  # ranges that Parquet prunes by, then the ids themselves
        known = [k for k in only if k is not None]
        near = F.lit(False)
        if known:
            near = (F.col("min_id") <= max(known)) & (F.col("max_id") >= min(known))
        wanted = blocks.where(near & F.arrays_overlap("doc_ids", F.lit(known).cast(f"array<{id_type}>")))
    rows = _frames(spark, folder, wanted.join(starts, ["part", "block"]), digest_only, id_type)
    out = rows.select(F.col("key").alias(id_col), "start", "n_tokens", F.col("last").alias("ids_crc32" if digest_only else "ids"))
    return out if only is None else out.where(F.col(id_col).isin(list(only)))
