"""Toxicity by a classifier chain.

Three categories are predicted one after the other: insults, contempt, and toxicity as a whole. Each has a logistic
model over indicators of the words and word beginnings that tell it best (chi-squared, at most WORDS), and the later models also read the
earlier categories' probabilities. For fitting they read out-of-fold ones, as a model's probabilities for its own
training rows would be too sure. A label marks a document as toxic; its categories are those of CATEGORIES whose
terms a toxic document holds, so that the first links learn from part of the toxic documents each.

The fit reads at most SAMPLE labelled documents (the first by the hash of doc_id), never those whose crc32 mod 3 is
1, which stay for testing; every whole text is scored. Words are runs of letters, digits and underscores, lower-cased.

Cases: a null or empty text has no words and is scored by the biases; a category that no sampled document has, or
all have, gets its share as a constant; without labels nothing is toxic; repeated rows each come back; other columns
are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.llm.common import labelled_sample, solved

SAMPLE, FOLDS, WORDS, ROUNDS, RIDGE = 8000, 3, 192, 15, 0.5
#: Terms that give a toxic document its category (fixed values).
CATEGORIES = {
    "insult": ("clown", "fool", "idiot", "loser", "moron", "stupid"),
    "contempt": ("disgusting", "garbage", "pathetic", "scum", "trash", "worthless"),
}
CHAIN = (*CATEGORIES, "toxic")
WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that count as features.
STEMS = (5, 7)


def words(text: str | None) -> set[str]:
    """The distinct words of a text, and the beginnings of longer ones (marked by a star), which inflected terms share."""
    own = set(WORD.findall((text or "").lower()))
    return own.union(*([w[:k] + "*" for w in own if len(w) >= k] for k in STEMS))


def telling(docs: list[set[str]], y: np.ndarray) -> list[str]:
    """The words whose presence depends most on y (chi-squared), best first."""
    inside = Counter(w for d, t in zip(docs, y, strict=True) if t for w in d)
    total = Counter(w for d in docs for w in d)
    n, n1 = len(docs), int(y.sum())
    kept = [w for w in total if total[w] >= 3]
    a = np.array([inside[w] for w in kept], float)
    t = np.array([total[w] for w in kept], float)
    strength = n * (a * (n - n1) - (t - a) * n1) ** 2 / np.maximum(n1 * (n - n1) * t * (n - t), 1e-9)
    return [kept[k] for k in sorted(range(len(kept)), key=lambda k: (-strength[k], kept[k]))[:WORDS]]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = solved((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def indicators(docs: list[set[str]], vocabulary: list[str]) -> np.ndarray:
    place = {w: k for k, w in enumerate(vocabulary)}
    x = np.zeros((len(docs), len(vocabulary)), np.float32)
    for k, d in enumerate(docs):
        x[k, [place[w] for w in d & place.keys()]] = 1
    return x


def link(docs: list[set[str]], earlier: np.ndarray, y: np.ndarray) -> dict:
    """One model of the chain; earlier: the probabilities of the categories before."""
    if not 0 < y.sum() < len(y):
        return {"words": {}, "earlier": [0.0] * earlier.shape[1], "bias": 0.0, "constant": float(y.mean()) if len(y) else 0.0}
    vocabulary = telling(docs, y)
    w = logistic(np.hstack([indicators(docs, vocabulary), earlier]).astype(np.float64), y)
    at = len(vocabulary)
    return {"words": dict(zip(vocabulary, w[:at].tolist(), strict=True)), "earlier": w[at:-1].tolist(), "bias": float(w[-1]), "constant": None}


def probability(model: dict, own: set[str], earlier: list[float]) -> float:
    if model["constant"] is not None:
        return model["constant"]
    weight = model["words"]
    z = model["bias"] + sum(weight[w] for w in sorted(own & weight.keys())) + sum(a * b for a, b in zip(model["earlier"], earlier, strict=True))
    return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def fit_chain(docs: list[set[str]], targets: dict[str, np.ndarray]) -> list[dict]:
    """The chain's models. Each later one is fitted with the out-of-fold probabilities of those before."""
    outside, chain = np.zeros((len(docs), 0)), []
    for name in CHAIN:
        y = targets[name].astype(float)
        chain.append(link(docs, outside, y))
        p = np.zeros(len(docs))
        for k in range(FOLDS):
            own = np.arange(len(docs)) % FOLDS == k
            part = link([d for d, o in zip(docs, own, strict=True) if not o], outside[~own], y[~own])
            p[own] = [probability(part, docs[i], outside[i].tolist()) for i in np.flatnonzero(own)]
        outside = np.hstack([outside, p[:, None]])
    return chain


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[dict]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ["\n".join(sorted(words(x))) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.string())], names=["doc_id", "y", "words"])

    chosen = labelled_sample(docs, labels, "toxic", sample).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    got = chosen.mapInArrow(run, "doc_id long, y int, words string").toArrow()  # at most `sample` documents' words
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("words").to_pylist(), got.column("y").to_pylist(), strict=True))
    sets = [set(w.split("\n")) - {""} for _, w, _ in rows]
    toxic = np.array([y for _, _, y in rows], bool)
    targets = {c: toxic & np.array([not d.isdisjoint(terms) for d in sets], bool) for c, terms in CATEGORIES.items()} | {"toxic": toxic}
    return fit_chain(sets, targets)


def score(docs: DataFrame, chain: list[dict]) -> DataFrame:
    """doc_id, the probability of each category and toxic (its probability is 0.5 or more) of every document.

    A chain has WORDS weights a category at most, so each task gets a copy.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *(f"p_{c}" for c in CHAIN)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        for batch in batches:
            columns: list[list[float]] = [[] for _ in CHAIN]
            for text in batch.column(1).to_pylist():
                own, earlier = words(text), []
                for model, column in zip(models, columns, strict=True):
                    earlier.append(probability(model, own, earlier))
                    column.append(earlier[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], names=names)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names[1:]))
    return made.withColumn("toxic", F.col("p_toxic") >= 0.5)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
