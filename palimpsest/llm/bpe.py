"""Byte-level BPE by ranks, as a tree of joins: texts to ids and back.

Encoding is a map from spans of a text into a monoid. A span of up to ``LEAF_CHARS`` characters is encoded by the library in
one go; a longer one by its halves, which are then joined at the border (``Encoder.ids``):

* A window around the border is encoded anew and grows until it begins and ends at a place where the pattern must cut,
  whatever stands elsewhere: where a letter or digit is followed by something else, as no alternative of the pattern
  goes on there. The pattern reads ahead, never back, so the tokens left and right of such a window are final.
* Where no such place is near, the stretch between the nearest two is taken for itself, without the library: it is cut
  into the pattern's matches, and a match of more than ``LEAF_BYTES`` bytes is halved in turn (``Encoder.merged``). Where
  the halves' tokens meet, some tokens of either side are merged anew. If the first and the last of them come out as they
  were, all beyond are final; else the window grows. That is because merging (the pair of least rank first, the
  leftmost of equals) gives a sequence of tokens if and only if it gives each two neighbours of the sequence, merged
  alone, back: until a merge crosses a border, what happens beside that border doesn't depend on what lies beyond.

A whole match that is a vocabulary entry becomes that entry even where merging wouldn't reach it, as the library has it;
parts of a match don't.

Decoding cuts the ids into spans, looks their bytes up, and concatenates neighbours up the tree.

Rows are independent: no shuffle, a lost task is just run again, and memory follows the longest texts of a batch. A text
costs time in proportion to its length (n log n where it is one match), unless windows of tokens have to grow.

Defined results: null and empty texts have no ids, and no ids decode to no bytes; null ids of documents and equal rows are
rows like others; an empty table gives an empty table; other columns, whatever their names, are ignored unless they are
asked for by ``carry``; token ids that the vocabulary doesn't have, or null ones, raise.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS = 4096
LEAF_BYTES = 64
LEAF_IDS = 4096
WINDOW_CHARS, WINDOW_IDS = 32, 4  # on either side of a border, at first
ROWS = 512  # of a batch that a task hands back

#: A letter or digit, then a character that surely is neither.
_SURE = re.compile(r"(?<=[^\W_])[\x00-/:-@\[-`{-\x7f、。，]")


class Encoder:
    """ids of texts by ``ranks`` (bytes -> id, all single bytes among them), each match of ``pattern`` on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        if any(bytes([b]) not in ranks for b in range(256)) or len(set(ranks.values())) != len(ranks):
            raise ValueError("not byte-level ranks: a byte is missing or an id is there twice")
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.entries = dict(zip(ranks.values(), ranks, strict=True))
        self.matches = regex.compile(pattern).findall
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def ids(self, text: str, lo: int, hi: int) -> np.ndarray:
        """ids of text[lo:hi] as a text of its own."""
        if hi - lo <= LEAF_CHARS:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        a, b = self._window(text, lo, mid, hi)
        if b - a > LEAF_CHARS:
            long = [self._match(m) for m in self.matches(text, a, b)]
            sides = [self.ids(text, x, y) for x, y in ((lo, a), (b, hi))]
            return np.concatenate([sides[0], np.array([i for ids in long for i in ids], np.uint32), sides[1]])
        left, right = self.ids(text, lo, mid), self.ids(text, mid, hi)
        old_left, old_right = len(self.leaf(text[a:mid])), len(self.leaf(text[mid:b]))
        return np.concatenate([left[: len(left) - old_left], self.leaf(text[a:b]), right[old_right:]])

    def _window(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """The nearest sure cuts on both sides of ``mid`` that both halves have as well; else their ends."""
        wide, a = WINDOW_CHARS, lo
        while mid - wide // 2 > lo:  # a cut is looked for in stretches further and further away
            near = [m.start() for m in _SURE.finditer(text, max(lo + 1, mid - wide), max(lo + 1, mid - max(wide // 2, 1) - 2))]
            if near:
                a = near[-1]
                break
            wide *= 2
        cut = _SURE.search(text, mid + 1, hi)
        return a, cut.start() if cut else hi

    def _match(self, match: str) -> list[int]:
        raw = match.encode()
        if len(raw) <= self.longest and raw in self.ranks:
            return [self.ranks[raw]]
        return self.merged(raw)

    def merged(self, raw: bytes) -> list[int]:
        """Bytes by the merge rule alone: halves first."""
        if len(raw) <= LEAF_BYTES:
            return self._at_once(raw)
        half = len(raw) // 2
        return self.joined(self.merged(raw[:half]), self.merged(raw[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """What merging makes of both sides' bytes together, from what it made of each."""
        wide = WINDOW_IDS
        while True:
            a, b = left[-wide:], right[:wide]
            again = self._at_once(b"".join([self.entries[i] for i in a + b]))
            if (len(a) == len(left) or again[0] == a[0]) and (len(b) == len(right) or again[-1] == b[-1]):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            wide *= 2

    def _at_once(self, raw: bytes) -> list[int]:
        """Merges from a heap of pairs, over parts linked to their neighbours."""
        n, rank = len(raw), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is raw[k:after[k]]; of merged ones the first k stays
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank(raw[k : k + 2])) is not None]
        heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, k, end = heappop(heap)
            if gone[k] or after[k] == n or after[after[k]] != end:
                continue  # one of the pair has been merged since
            gone[after[k]] = 1
            after[k] = end
            if end < n:
                before[end] = k
                if (r := rank(raw[k : after[end]])) is not None:
                    heappush(heap, (r, k, after[end]))
            if (p := before[k]) >= 0 and (r := rank(raw[p:end])) is not None:
                heappush(heap, (r, p, end))
        return [self.ranks[raw[k : after[k]]] for k in range(n) if not gone[k]]

    def encode(self, text: str | None) -> np.ndarray:
        """ids of a whole text."""
        return self.ids(text or "", 0, len(text or ""))

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids, halves first."""
        if len(ids) <= LEAF_IDS:
            return b"".join([self.entries[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for this file of ranks, kept between tasks."""
    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path, pattern] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
    return _ENCODERS[path, pattern]


def _mapped(rows: DataFrame, carry: Sequence[str], source, name: str, kind: str, make) -> DataFrame:
    """The columns ``carry``, and ``make`` of the column ``source`` for a slice of rows at a time as ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], make(batch.column(batch.num_columns - 1))], names=names)

    if name in carry:
        raise ValueError(f"a carried column can't be named {name}")
    names = [*(f"c{k}" for k in range(len(carry))), "made"]
    schema = ", ".join([*(f"c{k} {rows.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)), f"made {kind}"])
    found = rows.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)], source.alias("source")).mapInArrow(run, schema)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], F.col("made").alias(name))


def encode(docs: DataFrame, path: str, pattern: str, *, carry: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``carry``, and ``ids`` of each whole text (array<int>)."""

    def make(texts: pa.Array) -> pa.Array:
        coding = encoder(path, pattern)
        ids = [coding.encode(t.as_py()) for t in texts]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))

    return _mapped(docs, carry, F.col(text_col), "ids", "array<int>", make)


def decode(rows: DataFrame, path: str, pattern: str, *, carry: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The columns ``carry``, and the bytes of each row's ids as ``decoded``."""

    def make(ids: pa.Array) -> pa.Array:
        coding = encoder(path, pattern)
        flat, ends = ids.values, ids.offsets.to_numpy()
        return pa.array([coding.decode(flat[a:b].to_pylist()) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())

    return _mapped(rows, carry, F.coalesce(F.col(ids_col), F.array().cast("array<int>")), "decoded", "binary", make)
