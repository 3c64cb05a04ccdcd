"""Spelling variants of one edit, found through Bloom-guided neighbourhoods.

The vocabulary (words with their counts) is a table. Two words are near if one inserted, deleted or replaced code
point parts them. Nearness is symmetric, so each pair is sought from one side: the longer word by its deletions, and
of two words of one length the one with the smaller code point by its replacements. These edits are never written
out: a word's hash is a sum over its places, an edit's hash differs from it by a few terms, and the hash is probed in
Bloom filters. Only edits that a filter holds are spelt out, and an exact join with the vocabulary removes those that
it holds wrongly.

The filters: one for each word length, in blocks of 64 bits with five bits a word, about BITS bits a word. Tasks make
pieces of them; together they are FILTER_BYTES at most. A larger vocabulary is probed in as many passes as that takes,
each with the filters of the words whose hashes fall to it, so what is broadcast never grows beyond that.

A word's form is its near word with the largest count if that is FACTOR times its own; roots follow forms, doubling
the step each round (counts rise by FACTOR a step, so chains are short).

Cases: null and empty texts have no words; a null doc_id counts as empty where it makes part of a hash; words of any
length are probed, one place after the other; repeated rows count each time; ties go to the word that is
smallest in code-point order; an empty vocabulary gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.llm.common import cut

LEAST_LENGTH, LEAST_COUNT, FACTOR, SLIP = 7, 2, 10, 31
BITS, FILTER_BYTES = 24, 64 << 20
#: 64-bit blocks in one piece of a filter, words that a task counts at once, and code points of words of one length that it probes at once.
PIECE, HELD, GROUP_LETTERS = 1 << 17, 1 << 18, 1 << 16
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
LOWER = {c: c + 32 for c in range(65, 91)}
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): letter runs of all texts, in lower case, of LEAST_LENGTH code points that occur LEAST_COUNT times.

    Where SLIP divides the checksum of "<doc_id>:<run>", one code point of that run is left out. Shorter runs stay
    shorter, so they are not looked for. A task adds up what it has seen, up to HELD words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                start = crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                for found in RUN.finditer(text.as_py() or ""):
                    word = found[0].translate(LOWER) if not found[0].islower() else found[0]
                    h = crc32(word.encode(), start)
                    if h % SLIP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    counts[word] += 1
                    if len(counts) >= HELD:
                        yield counted(counts)
                        counts.clear()
        yield counted(counts)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def multipliers(start: int, stop: int) -> np.ndarray:
    """Odd 64-bit factors of the places start..stop-1 of a word."""
    x = (np.arange(start, stop, dtype=np.uint64) + np.uint64(1)) * MIX_A
    x = (x ^ x >> np.uint64(30)) * MIX_B
    return (x ^ x >> np.uint64(27)) | np.uint64(1)


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * MIX_B
    h ^= h >> np.uint64(29)
    return h


def bits(h: np.ndarray) -> np.ndarray:
    """The five bits of a block that stand for a hash."""
    out = np.uint64(1) << (h & np.uint64(63))
    for k in range(1, 5):
        out |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return out


class Filters:
    """Where each length's filter starts, how many blocks it has, and which hashes fall to this pass."""

    def __init__(self, sizes: dict[int, int], turn: int, passes: int) -> None:
        self.turn, self.passes, self.start, self.blocks, at = np.uint64(turn), np.uint64(passes), {}, {}, 0
        for length, n in sorted(sizes.items()):
            self.start[length], self.blocks[length] = np.uint64(at), np.uint64(n * BITS // (64 * passes) + 1)
            at += int(self.blocks[length])
        self.total = at

    def mine(self, h: np.ndarray) -> np.ndarray:
        return h % self.passes == self.turn

    def block(self, h: np.ndarray, length: int) -> np.ndarray:
        return (self.start[length] + ((h >> np.uint64(32)) * self.blocks[length] >> np.uint64(32))).astype(np.int64)

    def holds(self, made: np.ndarray, raw: np.ndarray, asked: np.ndarray, length: int) -> np.ndarray:
        """Where (flat) a hash that is asked about may be that of a word. The first bit alone rules out most."""
        if length not in self.start:
            return np.empty(0, np.int64)
        at = np.flatnonzero(asked)
        h = finished(raw.ravel()[at])
        if self.passes > 1:
            own = self.mine(h)
            at, h = at[own], h[own]
        block = made[self.block(h, length)]
        first = np.flatnonzero(block >> (h & np.uint64(63)) & np.uint64(1))
        at, h, block = at[first], h[first], block[first]
        want = bits(h)
        return at[(block & want) == want]


def letters_of(words: list[str]) -> np.ndarray:
    return np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
    """Words of one length each time, with their counts, GROUP_LETTERS code points or one word at a time."""
    held: dict[int, tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            words, counts = held[len(word)]
            words.append(word)
            counts.append(n)
            if len(words) * len(word) >= GROUP_LETTERS:
                yield held.pop(len(word))
    yield from held.values()


def hashed(letters: np.ndarray) -> np.ndarray:
    return (letters * multipliers(0, letters.shape[1])).sum(1, dtype=np.uint64)


def built(words: DataFrame, filters: Filters) -> np.ndarray:
    """The filters of this pass: tasks set the bits of their blocks, and the driver gets FILTER_BYTES at most, piece by piece."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in by_length(batches):
            h = finished(hashed(letters_of(found).astype(np.uint64)))
            h = h[filters.mine(h)]
            at = filters.block(h, len(found[0]))
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE), pa.array(at % PIECE), pa.array(bits(h).view(np.int64))], names=["piece", "at", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(PIECE, np.uint64))
        for batch in batches:
            piece, at, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p in np.unique(piece).tolist():
                own = piece == p
                np.bitwise_or.at(pieces[p], at[own], value[own].view(np.uint64))
        for p, held in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([held.tobytes()])], names=["piece", "held"])

    out = np.zeros(-(-filters.total // PIECE) * PIECE, np.uint64)
    dealt = words.mapInArrow(placed, "piece long, at long, bits long").repartition("piece")
    for row in dealt.mapInArrow(joined, "piece long, held binary").toLocalIterator():
        out[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] |= np.frombuffer(row["held"], np.uint64)
    return out


def edits(words: list[str], alphabet: np.ndarray, filters: Filters, made: np.ndarray) -> Iterator[tuple[int, str]]:
    """(which word, edit) for the deletions and the rising replacements that the filters hold."""
    letters = letters_of(words)
    wide, length = letters.astype(np.uint64), letters.shape[1]
    whole, factor = hashed(wide), multipliers(0, length)
    for i in range(length):
        more = alphabet[None, :] > letters[:, i : i + 1]
        raw = whole[:, None] + (alphabet.astype(np.uint64)[None, :] - wide[:, i : i + 1]) * factor[i]
        for at in filters.holds(made, raw, more, length).tolist():
            k, c = divmod(at, len(alphabet))
            yield k, words[k][:i] + chr(alphabet[c]) + words[k][i + 1 :]
    if length - 1 in filters.start:
        left = np.zeros(len(words), np.uint64)
        moved = (wide[:, 1:] * factor[:-1]).sum(1, dtype=np.uint64)  # what follows the deleted place, one place earlier
        for i in range(length):
            last = letters[:, i] != letters[:, i + 1] if i + 1 < length else np.ones(len(words), bool)  # of equal letters in a row, the last
            for k in filters.holds(made, left + moved, last, length - 1).tolist():
                yield k, words[k][:i] + words[k][i + 1 :]
            left += wide[:, i] * factor[i]
            if i + 1 < length:
                moved -= wide[:, i + 1] * factor[i]


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of near words of words(word, n)."""
    spark: SparkSession = words.sparkSession
    sizes = {row[0]: row[1] for row in words.groupBy(F.length("word")).count().collect()}  # as many rows as there are lengths
    alphabet = np.array(sorted(ord(row[0]) for row in words.select(F.explode(F.split("word", ""))).distinct().collect() if row[0]), np.uint32)
    passes = max(1, -(-sum(sizes.values()) * BITS // (8 * FILTER_BYTES)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for turn in range(passes):
        filters = Filters(sizes, turn, passes)
        sent = spark.sparkContext.broadcast(built(words, filters))

        def probe(batches: Iterator[pa.RecordBatch], filters=filters, sent=sent) -> Iterator[pa.RecordBatch]:
            for group, counts in by_length(batches):
                rows = list(edits(group, alphabet, filters, sent.value))
                which = [k for k, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e for _, e in rows], pa.string()), pa.array([group[k] for k in which], pa.string()), pa.array([counts[k] for k in which], pa.int64())],
                    names=["edit", "word", "n"],
                )

        found.append(cut(words.repartition(parts, "word").mapInArrow(probe, "edit string, word string, n long"), "spelling-edits"))
        sent.destroy()
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    exact = positives.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    both = F.explode(
        F.array(
            F.struct("word", "n", F.col("edit").alias("other"), F.col("edit_n").alias("other_n")),
            F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
        )
    )
    return exact.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): forms followed to the last one."""
    state = cut(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ahead = cut(state.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if not ahead.where("moved").limit(1).count():
            return state
        state = ahead.select("word", "root")


def group(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of words(word, n), whose words are distinct."""
    words = cut(words, "spelling-words")
    named = cut(near(words), "spelling-pairs")
    top = named.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min_by("other", F.struct(-F.col("other_n"), F.col("other"))).alias("top"), F.max("other_n").alias("top_n")
    )
    judged = words.join(top, "word", "left").withColumn("has", F.coalesce(F.col("top_n") >= FACTOR * F.col("n"), F.lit(False)))
    out = cut(
        judged.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("has"), F.col("top")).alias("form"), F.when(F.col("has"), F.col("top_n")).alias("form_n"),
        ),
        "spelling-judged",
    )
    return out.join(roots(out.where("form IS NOT NULL")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """The groups of the vocabulary of all texts."""
    return group(vocabulary(docs))
