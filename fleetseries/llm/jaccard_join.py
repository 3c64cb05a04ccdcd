"""Similarity join of word n-gram sets by T-occurrence search (DivideSkip).

A document is the set of its distinct word shingles, each a 64-bit hash; equal sets are one class (told apart by 128
bits). Two sets x and y whose Jaccard similarity reaches the threshold share at least T(x, y) shingles, and T(x) of
any partner's. All sets are ordered alike: by the level (logarithm) of a shingle's frequency, taken from counters of a
fixed size over all documents, then by hash. Of x the first |x| - T(x) + 1 shingles are looked up in inverted lists;
the others, the most frequent, are L lists set aside, as DivideSkip does.

- Short lists (SHORT classes at most) are merged with a heap, per x; a class is retained if it comes up often enough
  that the lists set aside, and x's long lists among those looked up, could fill it up to T(x, y).
- What is retained is verified: the other side's sorted shingles are probed by binary search for those of x.
- Pairs that meet in long lists alone are never written out for a whole list. Each member is compared with the
  CENTRES members that hold the list's shingle earliest, that is with the fewest rarer shingles. That links the bulk
  of a group of near copies. Then only pairs in different components, whose places in the list still allow T(x, y),
  are compared: no link between different components is lost, and no more are needed for components.

The documents are read three times (counters, look-ups, sets of those that have candidates): hashing again costs less
than to keep eight bytes for each word. The counters are COUNTERS bytes wherever they are sent.

Cases: null and empty texts, and texts without words, have no shingles and are linked with nothing, so their
component is their own doc_id; a text with fewer words than a shingle is one shingle; texts of any length are read
piece by piece; repeated rows each come back; null doc_ids are linked, but are never the smallest; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseries.llm.common import cut
from fleetseries.llm.simhash import components

#: Lists of more classes than this are long.
SHORT = 32
#: Members of a long list that all the others are compared with first.
CENTRES = 4
COUNTERS_BITS, CHUNK_BITS = 22, 16
#: Shingles of a set, about, in one part of it.
PART = 2048
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 17
SPACE = re.compile(rb"[ \t-\r]")
FACTOR, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def tables(size: int) -> tuple[np.ndarray, ...]:
    """By byte: whether it parts words, and a 64-bit number; by place: the power of FACTOR, and its inverse modulo 2^64."""
    parts, numbers = np.zeros(256, bool), (np.arange(256, dtype=np.uint64) + np.uint64(1)) * FINISH
    parts[[9, 10, 11, 12, 13, 32]] = True
    numbers = (numbers ^ numbers >> np.uint64(31)) * FACTOR
    powers = np.cumprod(np.r_[np.uint64(1), np.full(size, FACTOR)], dtype=np.uint64)
    inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(pow(int(FACTOR), -1, 1 << 64)))], dtype=np.uint64)
    return parts, numbers ^ numbers >> np.uint64(29), powers, inverses


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: its bytes' numbers weighted by powers, a difference of running sums taken back to place 0."""
    parts, numbers, powers, inverses = tables(2 * PIECE) if len(raw) <= 2 * PIECE else tables.__wrapped__(len(raw))
    code = np.frombuffer(raw, np.uint8)
    inside = np.r_[False, ~parts[code], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    sums = np.r_[np.uint64(0), np.cumsum(numbers[code] * powers[: len(code)], dtype=np.uint64)]
    starts, ends = edges[::2], edges[1::2]
    h = (sums[ends] - sums[starts]) * inverses[starts]
    h = (h ^ h >> np.uint64(32)) * FINISH
    return h ^ h >> np.uint64(29)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: lower() knows ASCII alone
    parts, at = [], 0
    while at < len(raw):
        space = SPACE.search(raw, at + PIECE)
        end = space.start() if space else len(raw)
        parts.append(word_hashes(raw[at:end]))
        at = end
    hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(hashes):
        return hashes
    n = max(len(hashes) - words + 1, 1)
    out = np.full(n, min(len(hashes), words), np.uint64)  # so a text of two words is no shingle of three
    for k in range(min(len(hashes), words)):
        out = out * FACTOR + hashes[k : k + n]
    out = (out ^ out >> np.uint64(32)) * FINISH
    out = np.sort(out ^ out >> np.uint64(29))
    return out[np.r_[True, out[1:] != out[:-1]]]


def least_overlap(n: Column | int, m: Column | int, percent: int):
    """T(x, y) for sets of n and m shingles: 100 * i >= percent * (n + m - i), rounded up."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def least_any(n: int, percent: int) -> int:
    """T(x): the least overlap of a set of n shingles with any partner."""
    return -(-percent * n // 100)


def tallied(places: DataFrame) -> DataFrame:
    """(chunk, held) rows added up by chunk: first a few dozen rows of each chunk at a time, then those sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(held.as_py()), np.uint32)
                kept = sums.get(chunk)
                sums[chunk] = part.copy() if kept is None else kept + np.minimum(part, ~kept)
        yield from packed(sums.items())

    for salt in ([F.spark_partition_id() % 32], []):
        places = places.repartition("chunk", *salt).mapInArrow(run, "chunk int, held binary")
    return places


def packed(rows) -> Iterator[pa.RecordBatch]:
    for chunk, counts in rows:
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)])], names=["chunk", "held"])


def counters(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> bytes:
    """For each value of the top bits of the hashes in all rows, the bit length of how many rows have it: COUNTERS bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS_BITS, np.uint32)
        for batch in batches:
            for sorted_hashes in hashes(batch):
                at = place(sorted_hashes)
                counts[at[np.flatnonzero(np.diff(at, prepend=-1))]] += 1
        yield from packed(enumerate(counts.reshape(-1, 1 << CHUNK_BITS)))

    out = np.zeros((1 << COUNTERS_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint8)
    for row in tallied(df.mapInArrow(run, "chunk int, held binary")).toLocalIterator():
        out[row["chunk"]] = np.frexp(np.frombuffer(zlib.decompress(row["held"]), np.uint32))[1]
    return out.tobytes()


def place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64)


def looked_up(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, x, d, tokens): size, 64 and 128 bits of each document's set, and its first shingles in the order of all."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in batch.column("text"):
            yield shingles(text.as_py(), words)

    levels = docs.sparkSession.sparkContext.broadcast(counters(texts.select("text"), sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            rows = []
            for found in sets(batch):
                first = found[np.argsort(level[place(found)], kind="stable")[: len(found) - least_any(len(found), percent) + 1]]
                digest = xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None
                rows.append((len(found), digest and int(digest[:16], 16) - (1 << 63), digest, first.view(np.int64)))
            n, x, d, tokens = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(d, pa.string()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["doc_id", "n", "x", "d", "tokens"],
            )

    return texts.mapInArrow(run, "doc_id long, n long, x long, d string, tokens array<long>")


def merged(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, n) from (x, n, long_lists, lists): those that the heap merge of x's short lists retains; n is the larger size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            own = zip(*(batch.column(c).to_pylist() for c in ("x", "n", "long_lists")), batch.column("lists"), strict=True)
            for x, n, spare, found in own:
                flat = found.values.flatten()
                ends = found.values.offsets.to_numpy() - found.values.offsets[0].as_py()
                others, sizes, spares = (flat.field(k).to_numpy().tolist() for k in range(3))
                heads = [zip(others[a:b], sizes[a:b], spares[a:b], strict=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                for (other, m, theirs), times in groupby(merge(*heads)):
                    if other > x and 100 * min(m, n) >= percent * max(m, n):
                        aside = max(least_any(m, percent), least_any(n, percent)) - 1 + min(theirs, spare)
                        if sum(1 for _ in times) + aside >= least_overlap(n, m, percent):
                            out.append((x, other, max(n, m)))
            a, b, most = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, most)], names=["a", "b", "n"])

    return lists.mapInArrow(run, "a long, b long, n long")


def split_bits(n: Column | int):
    """Into 2^this ranges of the hash a set of n shingles is cut, PART or so each."""
    if isinstance(n, int):
        return ((n - 1) // PART).bit_length()
    q = F.floor((n - 1) / PART)
    return F.when(q <= 0, F.lit(0)).otherwise(F.length(F.bin(q))).cast("int")


def sets_of(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(x, d, n, bits, part, held): the sets of the classes in nodes(x), in parts by range of the hash, so that no row is large.

    A set that may link with one of more ranges is there in those too. Other classes are dropped before the shuffle
    where counters of x tell them apart.
    """

    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for x in batch.column(0).to_numpy(zero_copy_only=False):
            yield np.array([int(x) + (1 << 63)], np.uint64)

    asked = docs.sparkSession.sparkContext.broadcast(counters(nodes.select("x"), of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.frombuffer(asked.value, np.uint8), set()
        for batch in batches:
            for text in batch.column("text"):
                found = shingles(text.as_py(), words)
                digest, n = xxhash.xxh3_128_hexdigest(found.tobytes()), len(found)
                x = int(digest[:16], 16)
                if n and wanted[x >> 64 - COUNTERS_BITS] and digest not in seen:
                    seen.add(digest)
                    for bits in sorted({split_bits(n), split_bits(100 * n // percent)}):
                        ends = np.searchsorted(found, np.array([k << 64 - bits for k in range(1, 1 << bits)], np.uint64)).tolist() if bits else []
                        parts = [(k, found[a:b].tobytes()) for k, (a, b) in enumerate(zip([0, *ends], [*ends, n], strict=True)) if b > a]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x - (1 << 63)] * len(parts)), pa.array([digest] * len(parts)), pa.array([n] * len(parts), pa.int64()), pa.array([bits] * len(parts), pa.int32()),
                             pa.array([k for k, _ in parts], pa.int64()), pa.array([h for _, h in parts], pa.binary())],
                            names=["x", "d", "n", "bits", "part", "held"],
                        )

    made = docs.select("text").mapInArrow(run, "x long, d string, n long, bits int, part long, held binary")
    return cut(made.join(nodes.select("x"), "x", "left_semi").dropDuplicates(["d", "bits", "part"]), "jaccard-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes, by 128 bits, whose sets are as similar as asked. pairs: a, b, n (the larger size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for one, two in zip(batch.column("held_a"), batch.column("held_b"), strict=True):
                p, q = sorted((np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)), key=len)
                at = np.searchsorted(q, p)
                both.append(int((q[np.minimum(at, len(q) - 1)] == p).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(both, pa.int64())], names=["a", "b", "n_a", "n_b", "both"])

    sides = [sets.select(F.col("x").alias(f"x{s}"), "bits", "part", F.col("d").alias(s), F.col("n").alias(f"n_{s}"), F.col("held").alias(f"held_{s}")) for s in ("a", "b")]
    asked = pairs.select(F.col("a").alias("xa"), F.col("b").alias("xb"), split_bits(F.col("n")).alias("bits"))
    parts = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.col("bits")).cast("long") - 1)))
    met = parts.join(sides[0], ["xa", "bits", "part"]).join(sides[1], ["xb", "bits", "part"])
    probed = met.select("a", "b", "n_a", "n_b", "held_a", "held_b").mapInArrow(run, "a string, b string, n_a long, n_b long, both long")
    sums = probed.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    return sums.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def could_link(percent: int, n: str, m: str) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): pairs of one component among classes(x, n, tokens), enough of them to join all that are linked at all."""
    postings = classes.select("x", "n", F.posexplode("tokens").alias("pos", "token"))
    sizes = cut(postings.groupBy("token").count().where("count > 1"), "jaccard-sizes")
    met = cut(postings.join(sizes, "token"), "jaccard-postings")
    counted = met.groupBy("x").agg(F.count_if(F.col("count") > SHORT).alias("long_lists"))
    short = met.where(F.col("count") <= SHORT).join(counted, "x")
    lists = short.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("x", "n", "long_lists"))).alias("list"))
    of_x = short.select("token", "x", "n", "long_lists").join(lists, "token").groupBy("x", "n", "long_lists").agg(F.collect_list("list").alias("lists"))
    pairs = merged(of_x, percent)

    long = met.where(F.col("count") > SHORT).select("token", "x", "n", "pos")
    stars = (
        long.join(earliest(long), "token")
        .select("x", "n", F.explode("centres").alias("c"))
        .where((F.col("x") != F.col("c.x")) & could_link(percent, "n", "c.n"))
        .select(F.least("x", "c.x").alias("a"), F.greatest("x", "c.x").alias("b"), F.greatest("n", "c.n").alias("n"))
    )
    pairs = cut(pairs.unionByName(stars.distinct()).distinct(), "jaccard-candidates")
    nodes = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).unionByName(long.select("x")).distinct()
    sets = sets_of(docs, nodes, words, percent)
    first = cut(verified(pairs, sets, percent), "jaccard-links")

    roots = cut(components(first), "jaccard-first-roots")
    known = sets.select("x", "d").distinct().join(roots, F.col("d") == F.col("node"), "left").select("x", F.coalesce("root", "d").alias("root"))
    placed = cut(long.join(known, "x"), "jaccard-long")
    bulk = placed.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("bulk"))
    apart = placed.join(bulk, "token").where(F.col("root") != F.col("bulk"))
    other = placed.select("token", *(F.col(c).alias(f"{c}2") for c in ("x", "n", "pos", "root")))
    room = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    rest = (
        apart.join(other, "token")
        .where((F.col("root") != F.col("root2")) & could_link(percent, "n", "n2"))
        .where(room * (100 + percent) >= percent * (F.col("n") + F.col("n2")))
        .select(F.least("x", "x2").alias("a"), F.greatest("x", "x2").alias("b"), F.greatest("n", "n2").alias("n"))
        .distinct()
    )
    stars_of_roots = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stars_of_roots.unionByName(verified(rest, sets, percent))


def earliest(long: DataFrame) -> DataFrame:
    """(token, centres): the CENTRES members of each long list that hold its token earliest; a task hands on that many of a list."""
    rank = F.row_number().over(Window.partitionBy("token").orderBy("pos", "x"))
    first = long.withColumn("rank", rank).where(F.col("rank") <= CENTRES)
    return first.groupBy("token").agg(F.collect_list(F.struct("x", "n")).alias("centres"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links reach.

    Documents link when the Jaccard similarity of their sets of `words` consecutive words is percent / 100 or more.
    """
    sets = cut(looked_up(docs, words, percent), "jaccard-prints")
    some = sets.where("n > 0")
    classes = some.select("d", "x", "n", "tokens").dropDuplicates(["d"])
    roots = cut(components(links(docs, classes, words, percent)), "jaccard-roots")
    firsts = cut(some.groupBy("d").agg(F.min("doc_id").alias("first")), "jaccard-firsts")
    placed = firsts.join(roots, F.col("d") == F.col("node"), "left").select("d", "first", F.coalesce("root", "d").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = cut(placed.join(least, "root").select("d", "component_id"), "jaccard-components")
    return sets.select("doc_id", F.col("n").alias("n_shingles"), "d").join(known, "d", "left").select(
        "doc_id", "n_shingles", F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u AS a JOIN u AS b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON both_ways.a = reach.doc_id)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, m.component_id
FROM g JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) AS m ON g.doc_id = m.doc_id
"""
