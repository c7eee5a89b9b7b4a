"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its ASCII-lowered UTF-8 bytes, white space
taken as one space, hashed into a fixed table. Each is scaled by the log ratio of its smoothed
document counts in toxic and other training texts, and a logistic regression with L2 penalty
is fitted on the scaled features, all of them. Whole texts are scored, in one pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, let_go, stored, tuned, utf8

BITS, ORDERS, CHUNK = 18, (4, 5, 6), 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def _spread(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(2654435769)) >> np.uint32(32 - BITS)


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Sorted feature numbers of ``text``; ``seen`` is an all-false scratch table, left so."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    top = max(ORDERS)
    for at in range(0, max(1, len(raw) - top + 1), CHUNK):  # very long texts in overlapping pieces
        b = _FOLD[raw[at : at + CHUNK + top - 1]].astype(np.uint32)
        h = b
        for k in range(2, top + 1):
            if len(b) < k:
                break
            h = h[:-1] * np.uint32(16777619) + b[k - 1 :]
            if k in ORDERS:
                seen[_spread(h + np.uint32(k))] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    """Weight of each feature (scale and coefficient in one) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: bytes, seen: np.ndarray) -> float:
        z = float(self.weights[features(text, seen)].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


#: A training row of more features than this is kept as a bitmap, so that no row takes more than 32 KB.
DENSE, PIECE = (1 << BITS) // 32, 1 << 21


def _row(found: np.ndarray) -> bytes:
    """A row's features: their numbers, or a bitmap if that is smaller."""
    if len(found) <= DENSE:
        return found.astype(np.uint32).tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[found] = True
    return b"b" + np.packbits(bits).tobytes()


def _found(row: bytes) -> np.ndarray:
    if len(row) % 4:
        return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8, offset=1)))
    return np.frombuffer(row, np.uint32)


def _pieces(rows: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, features, row starts) for some rows at a time; a row without features has one of weight 0 behind the table."""
    none = np.array([1 << BITS])
    first, held, size = 0, [], 0
    for k, r in enumerate(rows, 1):
        f = _found(r)
        held.append(f if len(f) else none)
        size += len(held[-1])
        if size >= PIECE or k == len(rows):
            yield first, k, np.concatenate(held).astype(np.int64), np.cumsum([0, *map(len, held[:-1])])
            first, held, size = k, [], 0


def log_count_ratios(rows: list[bytes], y: np.ndarray, alpha: float) -> np.ndarray:
    """Log ratio of each feature's smoothed document frequencies in class 1 and class 0; 0 for features of no row."""
    n = np.zeros((2, (1 << BITS) + 1))
    for first, end, found, starts in _pieces(rows):
        one = np.repeat(y[first:end], np.diff([*starts, len(found)]))
        n[1] += np.bincount(found, one, (1 << BITS) + 1)
        n[0] += np.bincount(found, 1 - one, (1 << BITS) + 1)
    of = [len(y) - y.sum(), y.sum()]
    ratio = np.log((n[1] + alpha) / (of[1] + 2 * alpha) * (of[0] + 2 * alpha) / (n[0] + alpha))
    ratio[n.sum(0) == 0] = 0
    ratio[-1] = 0
    return ratio


def fit(rows: list[bytes], y: np.ndarray, *, alpha: float = 1.0, l2: float = 1e-5, rounds: int = 100, near: float = 1e-5) -> Model:
    """Logistic regression on the log-count ratios of every n-gram seen, by limited-memory BFGS, until no slope is over ``near``.

    The mean log loss plus l2 / 2 times the squared coefficients is made least, the ratios scaled so
    that rows have length 1 on average. Rows are gone through piece by piece.
    """
    y = np.asarray(y, float)
    n, d = len(y), (1 << BITS) + 1
    if not n or y.min() == y.max():
        prior = (y.sum() + 0.5) / (n + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    ratio = log_count_ratios(rows, y, alpha)
    length = sum(np.add.reduceat((ratio * ratio)[found], starts).sum() for _, _, found, starts in _pieces(rows)) / n
    ratio /= np.sqrt(max(length, 1e-300))

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope, by, pull = l2 / 2 * float(w[:-1] @ w[:-1]), np.zeros(d), w[:-1] * ratio, 0.0
        for first, end, found, starts in _pieces(rows):
            z, own = np.add.reduceat(by[found], starts) + w[-1], y[first:end]
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - own) / n
            loss += float((np.logaddexp(0, z) - own * z).sum()) / n
            slope += np.bincount(found, np.repeat(g, np.diff([*starts, len(found)])), d)
            pull += g.sum()
        return loss, np.append(slope * ratio + l2 * w[:-1], pull)

    w = np.zeros(d + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    now, slope = at(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max() <= near:
            break
        way, factors = slope.copy(), []
        for s, t in reversed(moves):
            factors.append(s @ way / (s @ t))
            way -= factors[-1] * t
        way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else min(1.0, 1 / np.abs(slope).sum())
        for (s, t), f in zip(moves, reversed(factors)):
            way += s * (f - t @ way / (s @ t))
        step = 1.0
        while True:
            new = w - step * way
            then, bent = at(new)
            if then <= now - 1e-4 * step * (slope @ way) or step < 1e-6:
                break
            step /= 2
        if (new - w) @ (bent - slope) > 1e-12:
            moves = [*moves[-7:], (new - w, bent - slope)]
        w, now, slope = new, then, bent
    return Model((w[:-2] * ratio[:-1]).astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, **options: float) -> Model:
    """Fit on at most ``max_rows`` labelled rows, drawn by a hash of the id; every n-gram of them has a weight.

    The bound is on the sample the model is fitted on, nothing else. Labels without a document, rows
    without id, label or text and repeated ids (one row is kept, with label 1 if any says so) don't take
    a place in it; no rows, or one class only, give a constant score. The fit is one task over at most
    ``max_rows`` rows of at most 32 KB.
    """
    spark = tuned(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).dropna()
    sample = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = sample.join(texts.select("_id"), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = texts.join(F.broadcast(sample), "_id")  # at most max_rows small rows

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_row(features(t, seen)) for t in utf8(b.column(2))], pa.binary())], names=["_id", "_y", "_f"])

    table = rows.select("_id", "_y", "_text").mapInArrow(featurise, "_id long, _y int, _f binary")
    table = stored(table.groupBy("_id").agg(F.min(F.struct("_y", "_f")).alias("r")).select("_id", "r._y", "r._f"), "toxicity-sample")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        got = sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([f for _, _, f in got], np.array([float(y == 1) for _, y, _ in got]), **options))], pa.binary())], names=["model"])

    return pickle.loads(bytes(table.select("_id", "_y", "_f").coalesce(1).mapInArrow(solve, "model binary").first()[0]))


def score(df: DataFrame, model: Model, *, text_col: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """``df`` with the toxicity score of each row's whole text in a new column.

    Null text counts as empty and gets the score of a text without n-grams seen in training. The
    text column can be left out of the result.
    """
    spark = tuned(df.sparkSession)
    out = free_name(df.columns, out)
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    text = free_name(df.columns, "_scored")
    rows = df.select(*(F.col(f"`{f.name}`") for f in kept), *([] if keep_text else [F.col(f"`{text_col}`").alias(text)]))
    at = [f.name for f in kept].index(text_col) if keep_text else len(kept)
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = pickle.loads(shared.value), np.zeros(1 << BITS, bool)
        for b in batches:
            scores = pa.array([own.score(t, seen) for t in utf8(b.column(at))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], scores], names=schema.names)
        let_go()

    return rows.mapInArrow(run, schema)


def in_fold(id_col: str, folds: int, fold: int):
    """True where crc32 of the id as text leaves ``fold`` on division; a null id is text 'null'."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).cast("binary")) % folds == fold


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 4, fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; learns outside the fold."""
    model = train(docs, labels.where(~in_fold("doc_id", folds, fold)))
    rows = score(docs.select("doc_id", "text"), model, keep_text=False)
    return rows.select("doc_id", in_fold("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns; every label of a document trains."""
    model = train(docs, labels)
    rows = score(docs, model)
    return rows.where(F.col(rows.columns[-1]) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
