"""Packing by cutting-stock column generation.

Every document's ids, with one more at its end, are cut into full sequences and a rest. The rests' lengths, in steps
of UNIT ids rounded up, make a histogram. A linear program over patterns (how many rests of each length share a
sequence) is solved by column generation: a revised simplex method keeps the basis, and a knapsack dynamic program
over the dual prices finds the next patterns. Patterns are used as often as the rounded solution says, what is left is
filled by best fit, the whole is never more than best fit alone would take, and the rests of each length, ranked over
the whole table, take the patterns' places in turn. Only the histogram (CAPACITY / UNIT numbers) reaches the driver.

Cases: a null text counts as empty, and an empty text still has its closing id; repeated rows are packed each; null
doc_ids are kept; an empty table packs to no rows; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.llm.bpe import byte_letters
from fleetseries.llm.common import cut, solved

CAPACITY, UNIT, CLOSING = 2048, 8, 1
#: Pricing stops when the linear program is this near to its bound.
GAP = 5e-4
KEPT_STRETCHES, CHARS_AT_ONCE = 300_000, 2_000_000

_STRETCH = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_LOOSE = re.compile(r"[ ]\s|\s[ ]")
#: What both libraries may part differently: letters and signs outside long-settled blocks, and Python's own white space.
_ODD = re.compile("[\x1c-\x1f\u0500-\u1fff\u2070-\u209f\u2c00-\u2fff\ua000-\uabff\ud7a4-\uffff\U00010000-\U0010ffff]")
#: The pre-tokeniser of byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class StretchCoder:
    """The file's byte-level BPE, with the ids of frequent stretches (a word with its space) kept.

    White space parts pre-tokens, so a stretch has the same ids wherever it stands. New stretches are encoded by
    tiktoken, which applies the file's merges four times as fast; texts with a special token's string, with U+001C
    to U+001F or with letters newer than both libraries agree on go to the tokenizers library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=False)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(to_byte.__getitem__, token)): k for token, k in vocab.items()}
        self.fast = tiktoken.Encoding("stretches", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, k in vocab.items():
            self.bytes_of[k] = len(token)  # a letter stands for a byte
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.after_space: dict[str, bytes] = {}
        self.alone: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def learn(self, words: list[str]) -> None:
        """The ids of ' ' + word, for words that begin with no white space: encoded together, and parted by their bytes."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(part)), "<u2")
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in part), np.int64, len(part)))
            stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            raw, start = ids.tobytes(), 0
            for word, stop in zip(part, (2 * stops).tolist(), strict=True):
                self.after_space[word] = raw[start:stop]
                start = stop

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        block: list = []
        chars = 0
        for k, text in enumerate(texts):
            if _ODD.search(text) or any(s in text for s in self.special):
                block.append(self.whole(text))
            elif _LOOSE.search(text):
                block.append([b"".join(map(self.single, _STRETCH.findall(text)))])
            else:  # no space beside other white space: a space begins each stretch but the first
                block.append(text.split(" "))
            chars += len(text)
            if chars > CHARS_AT_ONCE or k == len(texts) - 1:
                new = set().union(*(p[1:] for p in block if isinstance(p, list)))
                if len(self.after_space) + len(new) > KEPT_STRETCHES:
                    self.after_space = {w: self.after_space[w] for w in new if w in self.after_space}
                new.difference_update(self.after_space)
                if "" in new:
                    new.discard("")
                    self.after_space[""] = self.whole(" ")
                self.learn(sorted(new))
                for p in block:
                    if isinstance(p, list):
                        head = p[0] if isinstance(p[0], bytes) else self.single(p[0])
                        p = head + b"".join(map(self.after_space.__getitem__, p[1:]))
                    yield np.frombuffer(p, "<u2").astype("<u4")
                block, chars = [], 0

    def single(self, stretch: str) -> bytes:
        found = self.alone.get(stretch)
        if found is None:
            if len(self.alone) > KEPT_STRETCHES // 4:
                self.alone.clear()
            found = self.alone[stretch] = self.whole(stretch) if stretch else b""
        return found


@lru_cache(maxsize=2)
def coder(path: str) -> StretchCoder:
    """One coder a Python worker and file, so that what it keeps lasts from task to task."""
    return StretchCoder(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, task int, nth long"


def pieces(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: full sequences, and a rest. bin is the rest's length in UNITs (full: one more than any);
    task and nth number the pieces of a bin in the task that made them. with_ids adds the ids (little-endian unsigned 32-bit)."""
    full = CAPACITY // UNIT + 1
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = coder(path), TaskContext.get().partitionId()
        numbered: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            ids_of = own.encode([x or "" for x in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
                for start in range(0, len(ids), CAPACITY):
                    piece = ids[start : start + CAPACITY]
                    bin_ = full if len(piece) == CAPACITY else -(-len(piece) // UNIT)
                    nth = numbered[bin_] = numbered.get(bin_, -1) + 1
                    raw = piece.tobytes()
                    rows.append((doc_id, start, len(piece), zlib.crc32(raw), len(ids), bin_, task, nth, raw)[: len(names)])
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


# -- the linear program --------------------------------------------------------------------------------


def best_of_each_capacity(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack program: by capacity the most that any number of each size is worth, and the size to take first (-1: none)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.searchsorted(sizes, room, side="right")
        best[room] = best[room - 1]
        take[room] = take[room - 1] if best[room] > 0 else -1
        if fit:
            worth = best[room - sizes[:fit]] + prices[:fit]
            k = int(worth.argmax())
            if worth[k] > best[room]:
                best[room], take[room] = worth[k], k
    return best, take


def pattern_of(sizes: np.ndarray, take: np.ndarray, first: int, capacity: int) -> np.ndarray:
    """The best pattern that holds one of the size numbered `first`."""
    pattern = np.zeros(len(sizes), np.int64)
    pattern[first] = 1
    room = capacity - int(sizes[first])
    while room and take[room] >= 0:
        pattern[take[room]] += 1
        room -= int(sizes[take[room]])
    return pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, start: list[np.ndarray], gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns by row and how often the linear program uses each: fewest sequences that hold demand[k] rests of sizes[k].

    sizes ascend. The simplex method runs over the patterns known so far (at first, one a size and those of `start`)
    until none improves the basis. Then one knapsack program over the duals prices, for each size, the best pattern
    that holds it, and all that improve become known. It ends at the optimum, or when it is within gap of the bound
    that the best value of a pattern, or the sum of the sizes, gives from below. Demands are shifted by less than
    a millionth each, so that no step is empty and the method cannot circle.
    """
    count = len(sizes)
    demand = demand + np.linspace(1e-7, 9e-7, count)
    known = np.array([*np.diag(capacity // sizes), *start], np.int64)
    held = {p.tobytes() for p in known}
    chosen = np.arange(count)
    inverse = np.diag(1.0 / (capacity // sizes))  # of the matrix whose columns are the chosen patterns
    used = demand / (capacity // sizes)
    bound, pivots = float(sizes @ demand) / capacity, 0
    while True:
        while True:
            prices = inverse.sum(0)
            worth = np.einsum("ij,j->i", known, prices)
            enter = int(worth.argmax())
            if worth[enter] <= 1 + 1e-9:
                break
            step = np.einsum("ij,j->i", inverse, known[enter])
            able = step > 1e-9
            ratio = np.where(able, used / np.where(able, step, 1), np.inf)
            k = int(np.argmin(ratio))
            moved = max(ratio[k], 0.0)
            used = used - moved * step
            used[k] = moved
            pivot = inverse[k] / step[k]
            inverse = inverse - np.outer(step, pivot)
            inverse[k] = pivot
            chosen[k] = enter
            pivots += 1
            if pivots % 200 == 0:  # against rounding errors that add up
                inverse = solved(known[chosen].T, np.eye(count))
                used = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
        best, take = best_of_each_capacity(sizes, prices, capacity)
        bound = max(bound, used.sum() / max(best[capacity], 1.0))
        worth = prices + best[capacity - sizes]
        new = [p for k in np.argsort(-worth) if worth[k] > 1 + 1e-7 and (p := pattern_of(sizes, take, int(k), capacity)).tobytes() not in held]
        new = list({p.tobytes(): p for p in new}.values())
        if used.sum() <= bound * (1 + gap) or not new:
            return known[chosen], used
        held.update(p.tobytes() for p in new)
        known = np.concatenate([known, new])


def best_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) by best fit from the longest down: each rest goes where the least room is left. Equal sequences are handled together."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room: sequences (the sizes in them, by number) and how many there are

    def put(room: int, inside: tuple[int, ...], times: int) -> None:
        if times:
            groups.setdefault(room, []).append((inside, times))

    for k in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[k]), int(demand[k])
        for room in [r for r in sorted(groups) if r >= size] + [capacity]:
            each = room // size
            for inside, times in groups.pop(room, []) if room < capacity else [((), n)]:
                whole = min(times, n // each)
                n -= whole * each
                put(room - each * size, (*inside, *[k] * each), whole)
                if whole < times and 0 < n < each:
                    put(room - n * size, (*inside, *[k] * n), 1)
                    whole, n = whole + 1, 0
                if inside or room < capacity:
                    put(room, inside, times - whole)
            if not n:
                break
    found = [(np.bincount(inside, minlength=len(sizes)), times) for held in groups.values() for inside, times in held]
    return [(pattern, times) for pattern, times in found if pattern.any()]


def plan(demand: dict[int, int], capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(sizes, copies, times) of each pattern, longest sizes first; together they hold demand exactly.

    The linear program's whole parts, and best fit for what is left; or best fit for all where that takes no more.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    wanted = np.array([demand[s] for s in sizes.tolist()], np.int64)
    plain = best_fit(sizes, wanted, capacity)
    patterns, used = cutting_stock(sizes, wanted.astype(float), capacity, [p for p, _ in plain])
    left, taken = wanted.copy(), []
    for rounding in (np.floor(used + 1e-6), np.ceil(used - 1e-6) - np.floor(used + 1e-6)):  # then up, while a whole pattern is still wanted
        for k in np.argsort(np.floor(used) - used, kind="stable"):
            some = patterns[k] > 0
            times = min(int(rounding[k]), int(np.min(left[some] // patterns[k][some])))
            if times > 0:
                left -= times * patterns[k]
                taken.append((patterns[k], times))
    taken += best_fit(sizes, left, capacity)
    if sum(t for _, t in plain) <= sum(t for _, t in taken):
        taken = plain
    return [(sizes[some], pattern[some], times) for pattern, times in taken if len(some := np.flatnonzero(pattern)[::-1])]


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there."""
    spark = docs.sparkSession
    made = cut(pieces(docs, path, with_ids), "pieces")
    per_task = made.groupBy("bin", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("bin").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = per_task.select("bin", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = made.join(first, ["bin", "task"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "task", "nth")
    full = CAPACITY // UNIT + 1
    demand = {r["bin"]: r["n"] for r in made.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # one row a length step
    demand.pop(full, 0)
    places, base = [], 0
    reached: dict[int, int] = {}
    for sizes, copies, times in plan(demand, CAPACITY // UNIT):
        for size, n in zip(sizes.tolist(), copies.tolist(), strict=True):
            low = reached.get(size, 0)
            reached[size] = low + n * times
            places.append((size, low, low + n * times, base, n))
        base += times
    # A place list has a few entries a pattern, and patterns number a few for each length step: a bounded table.
    schema = "bin int, low long, high long, base long, copies long"
    table = spark.createDataFrame([*places, (full, 0, 1 << 62, base, 1)], schema)
    placed = ranked.join(F.broadcast(table), "bin").where("rank >= low and rank < high")
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - low) div copies"))
    earlier = W.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"), *(["ids"] if with_ids else []),
    )
