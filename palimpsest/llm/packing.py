"""Packing: bounded-space best-fit packing of token ids into training windows.

Each partition keeps a fixed number of open windows. A document first fills whole windows of its own;
its remainder goes to the open window it fits best. When it fits none, the fullest open window is
topped up with the document's next ids and emitted, and the rest is placed again, so emitted windows
carry no padding. At the partition's end the open windows are merged fullest first; at most one window
of a partition stays short. No row ever leaves its partition: no shuffle, and memory is bounded by
``open_windows * window`` ids.

Defined results: null text is an empty document (one id, the end id); empty tables give no pieces;
repeated rows and null ids are packed row by row; other columns are ignored unless named as the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import encoder

WINDOW = 1024
OPEN_WINDOWS = 64
END_ID = 0

Piece = tuple[int | None, int, np.ndarray, int]  # id, start in its document, ids, the document's ids


class OpenWindows:
    """Bounded-space best-fit bins; ``put`` and ``finish`` yield windows, each a list of pieces."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.bins: list[list[Piece]] = []
        self.room: list[int] = []

    def _best(self, n: int) -> int:
        """The fullest open window with room for ``n`` more ids, or -1."""
        found, least = -1, self.window + 1
        for k, free in enumerate(self.room):
            if n <= free < least:
                found, least = k, free
        return found

    def _close(self, k: int) -> list[Piece]:
        done = self.bins[k]
        self.bins[k], self.room[k] = self.bins[-1], self.room[-1]
        self.bins.pop()
        self.room.pop()
        return done

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        key, start, ids, total = piece
        while len(ids) >= self.window:
            yield [(key, start, ids[: self.window], total)]
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            k = self._best(len(ids))
            if k >= 0:
                self.bins[k].append((key, start, ids, total))
                self.room[k] -= len(ids)
                if not self.room[k]:
                    yield self._close(k)
                return
            if len(self.bins) < self.limit:
                self.bins.append([(key, start, ids, total)])
                self.room.append(self.window - len(ids))
                return
            k = min(range(len(self.room)), key=self.room.__getitem__)
            cut = self.room[k]
            self.bins[k].append((key, start, ids[:cut], total))
            yield self._close(k)
            start, ids = start + cut, ids[cut:]

    def finish(self) -> Iterator[list[Piece]]:
        """Merge what is open, fullest first, cutting a piece where a window ends."""
        merged: list[Piece] = []
        room = self.window
        for k in sorted(range(len(self.bins)), key=lambda k: (self.room[k], k)):
            for key, start, ids, total in self.bins[k]:
                while len(ids):
                    cut = min(room, len(ids))
                    merged.append((key, start, ids[:cut], total))
                    start, ids, room = start + cut, ids[cut:], room - cut
                    if not room:
                        yield merged
                        merged, room = [], self.window
        self.bins, self.room = [], []
        if merged:
            yield merged


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    spaced: bool = True,
    end_id: int = END_ID,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, ids, doc_tokens, sequence_id, offset (see the module).

    ``ids`` are the piece's token ids; a window's pieces share ``sequence_id`` and are gapless from
    offset 0. ``sequence_id`` joins the partition's number and a running number, as
    ``monotonically_increasing_id`` does, so a task that runs again gives the same numbers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, start bigint, ids array<int>, doc_tokens bigint, sequence_id bigint, offset bigint"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, spaced).encode
        windows = OpenWindows(window, open_windows)
        at, number, rows, held, kind = None, 0, [], 0, pa.int64()

        def flush() -> pa.RecordBatch:
            keys, starts, ids, totals, numbers, offsets = zip(*rows, strict=True)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, kind),
                    pa.array(starts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), values),
                    pa.array(totals, pa.int64()),
                    pa.array(numbers, pa.int64()),
                    pa.array(offsets, pa.int64()),
                ],
                names=[id_col, "start", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        def add(done: list[Piece]) -> None:
            nonlocal number, held
            offset = 0
            for key, start, ids, total in done:
                rows.append((key, start, ids, total, at + number, offset))
                offset += len(ids)
            held += offset
            number += 1

        for batch in batches:
            kind = batch.schema.field("key").type
            if batch.num_rows and at is None:
                at = batch.column("part")[0].as_py() << 33
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(encode(text.as_py()) + end, dtype="<u4")
                for done in windows.put((key, 0, ids, len(ids))):
                    add(done)
                if held > 1 << 18:
                    yield flush()
                    rows, held = [], 0
        for done in windows.finish():
            add(done)
        if rows:
            yield flush()

    narrow = docs.select(
        F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part")
    )
    return narrow.mapInArrow(run, schema)


def ids_crc32(pieces: DataFrame, ids_col: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """Replace an array of ids by the unsigned CRC-32 of its little-endian unsigned 32-bit form."""
    import zlib

    kept = [c for c in pieces.columns if c != ids_col]
    fields = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids_col))
            values = np.asarray(lists.values).astype("<u4", copy=False)
            bounds = np.asarray(lists.offsets)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            size = np.diff(bounds)
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=[*kept, "length", out]
            )

    return pieces.mapInArrow(run, f"{fields}, length bigint, {out} bigint")
