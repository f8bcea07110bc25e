"""Runs of repeated words: maximal stretches with a period, found in the suffix trees of a text and of its reversal.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a length of at least
``max(shortest, times * q)`` that no neighbouring word extends keeping the period. Every run holds a Lyndon word of
length q that is the longest Lyndon word at its place, for the order of the words or for the opposite one (the runs
theorem). So the candidates are two a place: a longest Lyndon word ends where the next smaller suffix begins, and the
suffixes' ranks are the order of the leaves of the suffix tree. A candidate is extended to the right by the longest
common extension of its two ends, the depth of the lowest common ancestor of two leaves, and to the left by the same in
the reversal's tree. Trees are built by Ukkonen's algorithm; ancestors come from the minima of an Euler tour, in
constant time each by tables of doubled lengths, of which one is held at a time.

Trees are built only over stretches that can hold a run: a run's words but for its first q begin triples that were
there a period before, so with L triples in a row that recur at a distance of at most (L + 2) / (times - 1) there may
be a run and elsewhere there can be none. A test holds this and the trees against brute force.

A document is a row, so that rows are independent: no shuffle, and a lost task is just run again. Memory follows the
longest text of a batch. A text of n words takes time in proportion to n log n, hostile ones too.

Defined results: null and empty texts have no runs and collapse to an empty text; white space around words is not kept;
equal rows give equal results; null ids are rows like others; an empty table gives an empty table; other columns,
whatever their names, are ignored unless they are asked for by ``carry``; these can't be named as the result's columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST, TIMES = 6, 4
ROWS = 512  # of a batch that a task hands back

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixTree:
    """The suffix tree of positive numbers, to which a last 0, smaller than all, is added; built by Ukkonen's algorithm."""

    def __init__(self, word: Sequence[int]):
        self.word = [*word, 0]
        self.size = max(self.word) + 1
        self.start, self.end = [0], [0]
        self.child: dict[int, int] = {}  # node * size + first symbol -> node
        self._build()
        self.keys = np.fromiter(self.child, np.int64, len(self.child))
        self.nodes = np.fromiter(self.child.values(), np.int64, len(self.child))
        del self.child

    def _build(self) -> None:
        word, size, start, end, child, n = self.word, self.size, self.start, self.end, self.child, len(self.word)
        link = [0]
        node = edge = length = left = 0
        for i, symbol in enumerate(word):
            left += 1
            made = 0  # the inner node that still has no suffix link
            while left:
                if not length:
                    edge = i
                key = node * size + word[edge]
                to = child.get(key)
                if to is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if made:
                        link[made] = node
                    made = 0
                else:
                    a = start[to]
                    along = min(end[to], i + 1) - a
                    if length >= along:
                        node, edge, length = to, edge + along, length - along
                        continue
                    if word[a + length] == symbol:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    inner = len(start)
                    start += (a, i)
                    end += (a + length, n)
                    link += (0, 0)
                    child[key] = inner
                    child[inner * size + word[a + length]] = to
                    child[inner * size + symbol] = inner + 1
                    start[to] = a + length
                    if made:
                        link[made] = inner
                    made = inner
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1

    def _walk(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The Euler tour's depths in symbols, the suffixes in the order of their leaves, and these leaves' places in the tour."""
        order = np.argsort(keys)
        of, n = keys[order] // self.size, len(self.word)
        first = np.searchsorted(of, np.arange(len(self.start) + 1)).tolist()
        nodes, start, end = self.nodes[order].tolist(), self.start, self.end
        tour, suffixes, places = [0], [], []
        stack, depths, turn = [0], [0], first[:-1]
        while stack:
            node = stack[-1]
            at = turn[node]
            if at < first[node + 1]:
                turn[node] = at + 1
                to = nodes[at]
                depth = depths[-1] + end[to] - start[to]
                if first[to] == first[to + 1]:
                    suffixes.append(n - depth)
                    places.append(len(tour))
                    tour += (depth, depths[-1])
                else:
                    stack.append(to)
                    depths.append(depth)
                    tour.append(depth)
            else:
                stack.pop()
                depths.pop()
                if depths:
                    tour.append(depths[-1])
        return np.array(tour), np.array(suffixes), np.array(places)

    def prepare(self) -> "SuffixTree":
        """The tour, and ``ranks`` of the suffixes in the order of symbols; of these the last is the added one's."""
        self.tour, suffixes, places = self._walk(self.keys)
        self.place = np.empty(len(self.word), np.int64)
        self.place[suffixes] = places
        self.ranks = self._ranks(suffixes)
        return self

    def opposite_ranks(self) -> np.ndarray:
        """The suffixes' ranks if larger symbols come first, the added one still before all."""
        symbol = self.keys % self.size
        return self._ranks(self._walk(self.keys - symbol + np.where(symbol, self.size - symbol, 0))[1])

    def _ranks(self, suffixes: np.ndarray) -> np.ndarray:
        ranks = np.empty(len(suffixes), np.int64)
        ranks[suffixes] = np.arange(len(suffixes))
        return ranks

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and at j, other ones, have in common."""
        a, b = self.place[i], self.place[j]
        low, wide = np.minimum(a, b), np.abs(a - b) + 1
        level = np.frexp(wide)[1] - 1
        out, least = np.zeros(len(i), np.int64), self.tour
        for k in range(int(level.max(initial=-1)) + 1):
            mine = np.flatnonzero(level == k)
            out[mine] = np.minimum(least[low[mine]], least[low[mine] + wide[mine] - (1 << k)])
            least = np.minimum(least[: -(1 << k)], least[1 << k :]) if len(least) > 1 << k else least
        return out


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each suffix but the last, added one, where the next smaller one begins: there its longest Lyndon word ends."""
    n = len(ranks) - 1
    out, stack = np.empty(n, np.int64), [n]
    values = ranks.tolist()
    for i in range(n - 1, -1, -1):
        while values[stack[-1]] > values[i]:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return out


def runs_in(word: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of the runs of positive numbers, by start, then period."""
    n = len(word)
    forward, backward = SuffixTree(word.tolist()).prepare(), SuffixTree(word[::-1].tolist()).prepare()
    ends = [next_smaller(forward.ranks), next_smaller(forward.opposite_ranks())]
    i, j = np.tile(np.arange(n), 2), np.concatenate(ends)
    fits = times * (j - i) <= n
    i, j = i[fits], j[fits]
    right = forward.extension(i, j)
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = backward.extension(n - i[inner], n - j[inner])  # the reversal's suffixes that begin before i and j
    found = np.stack([i - left, j + right - (i - left), j - i], axis=1)
    return np.unique(found[found[:, 1] >= np.maximum(shortest, times * found[:, 2])], axis=0)


def stretches(word: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int]]:
    """Disjoint [from, to) outside of which no run has a word."""
    n = len(word)
    if n < shortest:
        return []
    code = (word[:-2] * (int(word.max()) + 1) + word[1:-1]) * (int(word.max()) + 1) + word[2:]  # if it overflows, equal triples still have equal codes
    order = np.argsort(code, kind="stable")
    again = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    back = np.full(len(code), n)  # how far before the triple was last
    back[order[again + 1]] = order[again + 1] - order[again]
    at = np.flatnonzero(back < n)
    while len(at):
        edges = np.flatnonzero(np.diff(at, prepend=-2, append=n + 2) != 1)
        first, count = at[edges[:-1]], np.diff(edges)
        reach = np.repeat((count + 2) // (times - 1), count)
        near = back[at] <= reach
        if near.all():
            break
        at = at[near]
    else:
        return []
    out: list[tuple[int, int]] = []
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        lo, hi = max(0, a - (c + 2) // (times - 1)), a + c + 2
        if out and lo < out[-1][1]:
            lo, hi = min(lo, out[-1][0]), max(hi, out.pop()[1])
            while out and lo < out[-1][1]:
                lo = min(lo, out.pop()[0])
        out.append((lo, hi))
    return [(lo, hi) for lo, hi in out if hi - lo >= shortest]


def find_runs(words: Sequence[bytes], shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of the runs of words, by start, then period. ``times`` is 2 or more, ``shortest`` 5 or more."""
    numbers: dict[bytes, int] = {}
    word = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found = []
    for lo, hi in stretches(word, shortest, times):
        runs = runs_in(np.unique(word[lo:hi], return_inverse=True)[1] + 1, shortest, times)
        found.append(runs + [lo, 0, 0])
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def collapse(words: Sequence[bytes], runs: np.ndarray) -> bytes:
    """The words joined by single spaces, without those that lie in a run after its first period."""
    if not len(runs):
        return b" ".join(words)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(covered[:-1]) == 0)])


def detect(docs: DataFrame, *, shortest: int = SHORTEST, times: int = TIMES, carry: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``carry``, ``runs`` (start, length, period in words, by start, then period), and ``collapsed``, the text
    with only the first period of each run. Words are ``[^\\x20\\x09-\\x0D]+``."""
    if shortest < 5 or times < 2:
        raise ValueError("a run has 5 words and 2 periods at least")
    if {"runs", "collapsed"} & set(carry):
        raise ValueError("carried columns can't be named runs or collapsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                per_doc, texts = [], []
                for raw in batch.column(batch.num_columns - 1):
                    words = (raw.as_py() or b"").split()  # bytes are split at ASCII white space only
                    per_doc.append(find_runs(words, shortest, times))
                    texts.append(collapse(words, per_doc[-1]))
                flat = np.concatenate(per_doc)
                fields = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
                ends = np.cumsum([0, *map(len, per_doc)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                done = [*batch.columns[:-1], lists, pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(done, names=[*(f"c{k}" for k in range(len(carry))), "runs", "collapsed"])

    kept = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    schema = ", ".join([*(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)), f"runs {RUN}", "collapsed string"])
    found = docs.select(*kept, F.col(text_col).cast("binary").alias("words")).mapInArrow(run, schema)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], "runs", "collapsed")
