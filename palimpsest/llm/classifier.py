"""Quality classifier: random Fourier features, ridge scores by normal equations, isotonic calibration.

Whole texts become a few dozen statistics (no label, language, source or id among them). They are
standardised by the training rows' moments, and cosines of random projections approximate a Gaussian
kernel. Each partition sums its part of the normal equations; the parts are summed by Spark, and a
matrix of fixed size reaches the driver, which solves for the ridge weights. Scores of the training
rows are counted in a fixed number of bins, and pool-adjacent-violators over the bins maps scores to
rates of label 1. All labelled training rows take part.

Defined results: null and empty texts have all statistics of the empty text and get a score too; labels
without a quality are left out, of several for an id each counts; rows repeated are scored each; without
any labelled row every score is 0.5; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import spool

FEATURES = 256
RIDGE = 1e-3
SEED = 11
BINS = 512
CLIP = 6.0

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_dev", "upper", "digits", "spaces", "punctuation", "symbols", "exclaims", "bars",
    "other_letters", "distinct_words", "top_word", "same_as_before", "repeated_pairs", "log_lines", "dup_lines", "words_per_line", "short_lines",
    "symbol_words", "upper_words", "squeezed", "stops",
)


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, all finite."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(len(raw), 1)
    count = np.bincount(raw, minlength=256)
    between = lambda a, b: int(count[ord(a) : ord(b) + 1].sum())
    of = lambda chars: int(sum(count[ord(c)] for c in chars))
    words = text.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), dtype=np.int64, count=len(words))
    top = int(np.bincount(ids).max()) if words else 0
    same = int((ids[1:] == ids[:-1]).sum()) if len(ids) > 1 else 0
    pairs = len(np.unique(ids[1:] * (len(number) + 1) + ids[:-1])) if len(ids) > 1 else 0
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    upper, lower = between("A", "Z"), between("a", "z")
    ends = [x[-1] for x in words]
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        upper / n,
        between("0", "9") / n,
        of(" \t\n\r") / n,
        of(".,;:?'\"()-") / n,
        of("#%&$*<>~^_=+@\\/") / n,
        of("!") / n,
        of("|{}[]") / n,
        int(count[128:].sum()) / n,
        len(number) / w,
        top / w,
        same / w,
        1 - pairs / max(len(ids) - 1, 1),
        np.log1p(len(lines)),
        1 - len(set(lines)) / k,
        len(words) / k,
        sum(len(x) < 20 for x in lines) / k,
        sum(c in "#%&$*|" for c in ends) / w,
        sum(x.isupper() for x in words) / w if upper else 0.0,
        len(zlib.compress(raw, 1)) / n,
        sum(c in ".!?" for c in ends) / w,
    ]


def with_statistics(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The ``carry`` columns and ``x``, the statistics as an array of doubles."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            x = [statistics(t.as_py()) for t in batch.column(names.index("_text"))]
            kept = [batch.column(names.index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(x, pa.list_(pa.float64()))], names=[*carry, "x"])

    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(run, f"{fields}, x array<double>")


@dataclass(frozen=True)
class Model:
    """Standardisation, random features, ridge weights and the calibrated steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    rates: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        random = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([np.ones((len(x), 1)), random], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.edges, self.rates)


def draw_features(dims: int, features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases of a Gaussian kernel whose width is the square root of the dimensions."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dims, features)) / np.sqrt(dims), rng.uniform(0, 2 * np.pi, features)


def sum_rows(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Rows of (row int, sums array<double>) summed by ``row`` in Spark; as many rows as a matrix has."""
    summed = parts.groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    return {r["row"]: np.array(r["sums"]) for r in summed.collect()}


def _emit(rows: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"row": np.arange(len(rows), dtype=np.int32), "sums": list(rows)})


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit: pool adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            total = w1 + w2
            blocks.append([(v1 * w1 + v2 * w2) / total, total, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.empty(0)


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """From rows of (x array<double>, y double in 0..1)."""
    dims = len(STATISTICS)
    directions, phases = draw_features(dims, features, seed)
    empty = np.empty(0)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, dims + 1))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                total += np.c_[[[len(x)], [len(x)]], [x.sum(axis=0), (x**2).sum(axis=0)]]
        yield _emit(total)

    got = sum_rows(rows.select("x").mapInPandas(moments, "row int, sums array<double>"), dims + 1)
    if not got or not got[0][0]:
        return Model(np.zeros(dims), np.ones(dims), directions, phases, empty, empty, empty)
    n = got[0][0]
    mean = got[0][1:] / n
    scale = np.sqrt(np.maximum(got[1][1:] / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    bare = Model(mean, scale, directions, phases, empty, empty, empty)

    def normal_equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for pdf in batches:
            if len(pdf):
                f = bare.features(np.stack(pdf["x"].to_numpy()))
                total += np.c_[f.T @ f, f.T @ pdf["y"].to_numpy()]
        yield _emit(total)

    got = sum_rows(rows.select("x", "y").mapInPandas(normal_equations, "row int, sums array<double>"), features + 2)
    both = np.array([got[i] for i in range(features + 1)])
    penalty = ridge * n * np.eye(features + 1) / features
    penalty[0, 0] = 0
    weights = np.linalg.solve(both[:, :-1] + penalty, both[:, -1])
    linear = Model(mean, scale, directions, phases, weights, empty, empty)
    lowest, highest = -0.5, 1.5

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, BINS))
        for pdf in batches:
            if len(pdf):
                s = np.clip(linear.raw(np.stack(pdf["x"].to_numpy())), lowest, highest)
                k = np.minimum(((s - lowest) / (highest - lowest) * BINS).astype(int), BINS - 1)
                total += [np.bincount(k, weights=v, minlength=BINS) for v in (np.ones(len(s)), pdf["y"].to_numpy(), s)]
        yield _emit(total)

    count, ones, scores = (sum_rows(rows.select("x", "y").mapInPandas(bins, "row int, sums array<double>"), BINS)[i] for i in range(3))
    held = count > 0
    rates = np.clip(isotonic(ones[held] / count[held], count[held]), 0, 1)
    return Model(mean, scale, directions, phases, weights, scores[held] / count[held], rates)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``x`` replaced by ``score``."""

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.empty(0))

    return rows.select(*[c for c in rows.columns if c != "x"], scored("x").alias("score"))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, score and predicted for each row of ``docs``.

    The statistics are written to the shared folder once; the passes of the fit and the scoring read
    those few numbers a document.
    """
    rows = spool(with_statistics(docs, [id_col], text_col), "statistics")
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y"))
    training = rows.where(~held_out(F.col(id_col))).join(known, F.col(id_col) == F.col("_id")).select("x", "y")
    model = fit(spool(training, "training"))
    out = score(rows, model)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
