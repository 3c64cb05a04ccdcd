"""A quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams (1 to 3) of the whole UTF-8 text, 3-grams in 2^18 buckets. Each indicator is
scaled by the log ratio of its class counts (naive Bayes), the vector is brought to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent. A logistic curve, fitted to out-of-fold margins, turns
margins into scores.

The fit reads at most SAMPLE labelled documents (the first by the hash of doc_id), never held-out ones; scoring runs
over all documents with the fitted weights, an array of fixed size.

Cases: a null or empty text has the constant feature alone and is scored like any other; where the labels are
missing or of one class, every score is that class's share (0.5 without labels); repeated rows each come back; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.llm.common import held_out, labelled_sample

SAMPLE, FOLDS, EPOCHS, COST, SMOOTH = 6000, 3, 12, 1.0, 1.0
BUCKETS = 1 << 18
SIZE = 256 + 65536 + BUCKETS


def features(text: str | None) -> np.ndarray:
    """The distinct byte n-grams of a text, as ascending feature numbers."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    if not len(b):
        return b
    two = b[:-1] << 8 | b[1:]
    three = (two[:-1] << 8 | b[2:]) * 0x9E3779B1 >> 8 & BUCKETS - 1
    seen = np.concatenate([b, 256 + two, 256 + 65536 + three])
    order = np.arange(len(seen))
    mark = _MARK
    mark[seen] = order  # the last place of each n-gram
    return np.sort(seen[mark[seen] == order])


_MARK = np.zeros(SIZE, np.int64)


def hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Weights (and a bias at the end) of a linear model with hinge loss, by dual coordinate descent."""
    w, alpha = np.zeros(SIZE + 1), np.zeros(len(rows))
    values = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            gradient = y[k] * (w[rows[k]] @ values[k] + w[SIZE]) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), COST)
            if new != alpha[k]:
                move = (new - alpha[k]) * y[k]
                w[rows[k]] += move * values[k]
                w[SIZE] += move
                alpha[k] = new
    return np.append(w[:SIZE] * ratio, w[SIZE])


def log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The naive Bayes log ratio of each indicator's share among the classes' counts."""
    counts = [np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == c] or [np.zeros(0, np.int64)]), minlength=SIZE) + SMOOTH for c in (1, -1)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def margin(row: np.ndarray, w: np.ndarray) -> float:
    return float(w[row].sum() / np.sqrt(max(len(row), 1)) + w[SIZE])


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a m + b))), by Newton's method, with Platt's softened targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-9]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    """The model: weights, and the curve from margins to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x).astype("<i4").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(label), pa.array(found, pa.binary())], names=["doc_id", "y", "found"])

    chosen = labelled_sample(docs, labels, label, sample).select("doc_id", "text", F.col(label).cast("int").alias(label))
    got = chosen.mapInArrow(run, "doc_id long, y int, found binary").toArrow()  # at most `sample` documents' n-grams
    order = np.lexsort((got.column("found").combine_chunks().to_numpy(zero_copy_only=False), got.column("doc_id").to_numpy())) if got.num_rows else []
    found, y = got.column("found").to_pylist(), np.where(got.column("y").to_numpy() > 0, 1, -1)
    rows = [np.frombuffer(found[k], "<i4").astype(np.int64) for k in order]
    y = y[order] if len(order) else y
    share = float((y > 0).mean()) if len(y) else 0.5
    if len(y) < 2 * FOLDS or share in (0.0, 1.0):
        return {"w": None, "a": 0.0, "b": share}
    outside = np.zeros(len(y))
    for k in range(FOLDS):
        own = np.arange(len(y)) % FOLDS == k
        train = [r for r, o in zip(rows, own, strict=True) if not o]
        w = hinge(train, y[~own], log_ratio(train, y[~own]))
        outside[own] = [margin(r, w) for r, o in zip(rows, own, strict=True) if o]
    a, b = logistic(outside, y)
    return {"w": hinge(rows, y, log_ratio(rows, y)).astype(np.float32), "a": a, "b": b}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every document: the model's arrays have a fixed size, so each task gets a copy."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if m["w"] is None:
                out = np.full(len(texts), m["b"])
            else:
                z = m["a"] * np.array([margin(features(x), m["w"]) for x in texts]) + m["b"]
                out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs predicted to be of quality; every row is scored where it stands, without a join."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if m["w"] is None:
                good = np.full(len(texts), m["b"] >= 0.5)
            else:
                good = m["a"] * np.array([margin(features(x), m["w"]) for x in texts]) + m["b"] >= 0
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
