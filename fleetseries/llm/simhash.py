"""SimHash near-duplicates found through the binary Golay code.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in two bits or
fewer agree wholly in one segment at least (pigeonhole), and differ in two bits or fewer in each other one. The
[23, 12] Golay code is perfect with radius 3, so two words at distance 2 or less share a codeword within distance 4
of both: the one nearest to the word between them. A word has one codeword that near, or six. A key is thus one
whole segment with one such codeword index of the next segment: three to eighteen keys a fingerprint, and every
link shares a key.

Equal fingerprints are merged before anything else. Keys of up to SMALL fingerprints are joined pair by pair and
verified. The fingerprints of larger keys are linked exactly without pairs: each is sent to itself and to its 64
neighbours at one bit; whatever meets at such a point (65 at most) is within two bits of the rest there, and two
fingerprints within two bits always meet at one.

Cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; texts
of one or two words are one shingle; repeated rows each come back; null doc_ids are linked, but are never the
smallest; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.llm.common import cut

SHINGLE_WORDS, SEED, WITHIN = 3, 42, 2
#: Keys with more fingerprints than this are linked through points instead of pairs.
SMALL = 16
SEGMENTS = (22, 21, 21)
ROW = "__row"
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: bit set where more than half of the shingles' XXH64 have it set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII alone
    n = len(words) - SHINGLE_WORDS + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at + SHINGLE_WORDS - 1 :], strict=False)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, *more, fp): the fingerprint of every whole text, as a signed long, and more columns of longs."""
    names = ["doc_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps)], names=[*names, "fp"])

    return docs.select(*(F.col(c).cast("long").alias(c) for c in names), "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of weight up to 3; those of weight 4 (five of them, or none: zeros); and whether there are five."""
    of_bit = []
    for k in range(23):
        v = 1 << k
        for b in range(22, 10, -1):
            if v >> b & 1:
                v ^= GENERATOR << (b - 11)
        of_bit.append(v)
    near, far, found = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= of_bit[b]
            error = sum(1 << b for b in bits)
            if weight < 4:
                near[s] = error
            else:
                far[s, found[s]] = error
                found[s] += 1
    return near, far, found == 5


def syndrome(v: np.ndarray) -> np.ndarray:
    """v modulo the generator, as polynomials over two elements."""
    v = v.copy()
    for b in range(22, 10, -1):
        v ^= np.where(v >> b & 1, GENERATOR << (b - 11), 0)
    return v


def codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices (12 bits) of all codewords within distance 4 of each 23-bit word: (which word, index)."""
    near, far, many = golay()
    s = syndrome(v)
    more = np.flatnonzero(many[s])
    which = np.concatenate([np.arange(len(v)), np.repeat(more, 5)])
    return which, np.concatenate([(v ^ near[s]) >> 11, ((v[more, None] ^ far[s[more]]) >> 11).ravel()])


def keys(fps: DataFrame) -> DataFrame:
    """(key, fp): the Golay keys of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(SEGMENTS)[:-1]])
            parts = [fp >> int(a) & ((1 << n) - 1) for a, n in zip(at, SEGMENTS, strict=True)]
            for k in range(3):
                which, index = codewords(parts[(k + 1) % 3])
                key = np.int64(k) << 34 | parts[k][which] << 12 | index
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[which])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) with a > b: links among distinct fingerprints, enough of them to join all that are linked at all."""
    keyed = cut(keys(distinct), "golay-keys")
    sizes = cut(keyed.groupBy("key").count().where("count > 1"), "golay-sizes")
    met = keyed.join(sizes, "key")
    small = met.where(F.col("count") <= SMALL).select("key", "fp")
    pairs = (
        small.withColumnRenamed("fp", "a")
        .join(small.withColumnRenamed("fp", "b"), "key")
        .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= WITHIN))
        .select("a", "b")
    )
    one_bit = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    points = (
        met.where(F.col("count") > SMALL)
        .select("fp")
        .distinct()
        .select("fp", F.explode(one_bit).alias("bit"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    )
    stars = (
        points.groupBy("point")
        .agg(F.collect_set("fp").alias("fps"))  # 65 at most lie within one bit of a point
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
        .where("a > b")
        .select("a", "b")
    )
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that can be reached.

    Alternating large and small stars: each round hangs every node on a smaller neighbour's neighbour, and a
    number of rounds logarithmic in the size of the component is enough. Each step is a written table; the joins
    have an exchange on both sides, so that a hub's rows can be split.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-star-roots")
        edges = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "small-star-roots")
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def classes(distinct: DataFrame) -> DataFrame:
    """distinct (one row a fp, with a column first) and least: the smallest first of all fingerprints that links reach."""
    roots = cut(components(links(distinct)), "roots")
    smallest = roots.join(distinct, roots["node"] == distinct["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(cut(smallest, "smallest"), "root").select(F.col("node").alias("fp"), "least")
    return cut(distinct.join(linked, "fp", "left").withColumn("least", F.coalesce("least", "first")), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id among all documents that links reach."""
    prints = cut(fingerprints(docs), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    return prints.join(classes(distinct), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint in hexadecimal, and component_id, of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs from each component: that of the smallest doc_id, null last; of those that share it, the first row.

    Rows are told apart by a number that is written with them, so that equal or null doc_ids bind nothing together.
    """
    numbered = cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    prints = cut(fingerprints(numbered, ROW), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)
    distinct = cut(prints.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    more = classes(distinct).where((F.col("n") > 1) | (F.col(f"first.{ROW}") != F.col(f"least.{ROW}")))  # all but rows alone
    gone = prints.join(more, "fp").where(F.col(ROW) != F.col(f"least.{ROW}")).select(ROW)
    return numbered.join(cut(gone, "gone"), ROW, "left_anti").select(*docs.columns)
