"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words in every contract of this package.
SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetseries-"))
        place = spark.sparkContext.getCheckpointDir()
    return place


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fleetseries/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, <label>) of at most `most` labelled documents of docs; never those whose crc32 mod 3 is 1.

    Labels that are null, or that contradict each other for one doc_id, are left out; so are null texts' labels
    (a null text is the empty text). Of rows that share a doc_id the least text stands for it, so the sample has a row
    an id. The sampled ids number `most` at most, so sending them to every task is safe.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).alias(label), F.max(label).alias("__top"))
        .where(F.col(label) == F.col("__top"))
        .drop("__top")
    )
    chosen = (
        known.where(F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", label)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves 1 when divided by 3; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """matrix^-1 right by elimination with row exchanges, for a few hundred unknowns.

    A threaded LAPACK call can hang in a driver, a process that runs a JVM beside numpy; this calls none.
    """
    n = len(matrix)
    both = np.hstack([matrix.astype(float), right.reshape(n, -1).astype(float)])
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k, k:] /= both[k, k]
        rows = np.flatnonzero(both[k + 1 :, k]) + k + 1
        both[rows, k:] -= both[rows, k, None] * both[k, k:]
    for k in range(n - 1, 0, -1):
        both[:k, n:] -= both[:k, k, None] * both[k, n:]
    return both[:, n:].reshape(right.shape)
