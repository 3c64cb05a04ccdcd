"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold, for each adjacent pair of symbols, its merge rank and place as one number; an inner
node holds the smaller of its children, so the root is the leftmost pair of lowest rank. A merge changes three
leaves, each mended along one path to the root, until the root holds no mergeable pair. Short words are done many
at a time: one row of a numpy matrix is one word's tree.

Cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; strings of special
tokens in a text give their ids; rows keep their other columns, except that `ids`/`decoded` are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words longer than this have a tree of their own instead of a row in a matrix.
WIDEST = 256
#: Words whose ids are kept by a Python worker, and characters worked on at once; both bound its memory.
KEPT_WORDS, CHARS_AT_ONCE = 400_000, 2_000_000
#: Below this code point the library's letter classes and those of the regex module agree (tested); words with others take the library's own normaliser and pre-tokeniser.
AGREED = "Ԁ"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return [chr(x) for _, x in sorted([(b, b) for b in plain] + [(b, 256 + k) for k, b in enumerate(others)])]


class PairTreeBPE:
    """A word-level BPE of a tokenizer file: bytes as base symbols, the last one of a word with the end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(
            next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        )
        self.pattern_or_end = regex.compile(self.pattern.pattern + r"|\n")
        letters = byte_letters()
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        self.base = np.array([vocab[c] for c in letters], np.int64)
        self.base_last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.never = len(pairs)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        names = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.kept: dict[str, bytes] = {}

    # -- ranks and trees -------------------------------------------------------------------------------

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; `never` where it cannot merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def merge_rows(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """symbols: words by row, padded to a power of two with -1. Returns the final symbols, -1 where merged away."""
        n_rows, n = symbols.shape
        none = self.never * n
        final = symbols.copy()
        rows = np.arange(n_rows)
        column = np.arange(n)
        following = np.broadcast_to(column + 1, (n_rows, n)).copy()
        before = np.broadcast_to(column - 1, (n_rows, n)).copy()
        tree = np.full((n_rows, 2 * n), none, np.int64)
        if n > 1:
            rank = self.rank(np.maximum(symbols[:, :-1], 0), np.maximum(symbols[:, 1:], 0))
            rank = np.where(column[:-1] + 1 < lengths[:, None], rank, self.never)
            tree[:, n : 2 * n - 1] = np.where(rank < self.never, rank * n + column[:-1], none)
        width = n
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        live = symbols
        while True:
            root = tree[:, 1] if n > 1 else np.full(len(rows), none)
            going = root < none
            if not going.all():
                final[rows[~going]] = live[~going]
                if not going.any():
                    return final
                rows, live, following, before, tree, lengths = (x[going] for x in (rows, live, following, before, tree, lengths))
                root = root[going]
            k = np.arange(len(rows))
            rank, i = np.divmod(root, n)
            j = following[k, i]
            after = following[k, j]
            live[k, i] = self.merged[rank]
            live[k, j] = -1
            following[k, i] = after
            inner = after < lengths
            before[k[inner], after[inner]] = i[inner]
            ahead = before[k, i]
            leaf = lambda a, b, ok: np.where(
                ok & ((r := self.rank(live[k, np.maximum(a, 0)], np.maximum(live[k, np.minimum(b, n - 1)], 0))) < self.never), r * n + a, none
            )
            new_i, new_p = leaf(i, after, inner), leaf(ahead, i, ahead >= 0)
            tree[k, n + i] = new_i
            tree[k, n + j] = none
            has = ahead >= 0
            tree[k[has], n + ahead[has]] = new_p[has]
            for place in (n + i, n + j, np.where(has, n + ahead, n + i)):
                node = place >> 1
                while node[0]:
                    tree[k, node] = np.minimum(tree[k, 2 * node], tree[k, 2 * node + 1])
                    node = node >> 1

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One long word, with a tree in a list: n merges at most, each of logarithmic cost."""
        m = len(symbols)
        n = 1 << max(1, (m - 1).bit_length())
        none = self.never * n
        live = symbols.tolist()
        pairs = {int(k): int(r) for k, r in zip(self.keys, self.ranks, strict=True)}
        tree = [none] * (2 * n)
        ranks = self.rank(symbols[:-1], symbols[1:])
        tree[n : n + m - 1] = np.where(ranks < self.never, ranks * n + np.arange(m - 1), none).tolist()
        for node in range(n - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        following, before = list(range(1, m + 1)), list(range(-1, m - 1))

        def put(leaf: int, value: int) -> None:
            node = n + leaf
            tree[node] = value
            node >>= 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1

        def pair(a: int, b: int) -> int:
            r = pairs.get(live[a] << 32 | live[b])
            return none if r is None else r * n + a

        while tree[1] < none:
            rank, i = divmod(tree[1], n)
            j = following[i]
            after = following[j]
            live[i], live[j] = int(self.merged[rank]), -1
            following[i] = after
            put(j, none)
            if after < m:
                before[after] = i
            put(i, pair(i, after) if after < m else none)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        return np.array([x for x in live if x >= 0], np.int64)

    # -- words ----------------------------------------------------------------------------------------

    def encode_pieces(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens of `sizes` bytes (1 at least) that follow each other in flat: their ids in one array, and how many each has."""
        starts = np.cumsum(sizes) - sizes
        symbols = self.base[flat]
        symbols[starts + sizes - 1] = self.base_last[flat[starts + sizes - 1]]
        counts = np.zeros(len(sizes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low, width = 0, 2
        while low < WIDEST:
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            for part in np.array_split(chosen, 1 + len(chosen) * width // 200_000):
                if len(part):
                    inside = np.arange(width) < sizes[part, None]
                    at = starts[part, None] + np.arange(width)
                    rows = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], -1)
                    done = self.merge_rows(rows, sizes[part])
                    counts[part] = (done >= 0).sum(1)
                    found.append((part, done))
            low, width = width, width * 2
        for k in np.flatnonzero(sizes > WIDEST):
            ids = self.merge_long(symbols[starts[k] : starts[k] + sizes[k]])
            counts[k] = len(ids)
            found.append((np.array([k]), ids[None, :]))
        ends = np.cumsum(counts)
        out = np.zeros(ends[-1] if len(ends) else 0, "<u2")
        for part, done in found:
            good = done >= 0
            out[((ends - counts)[part, None] + np.cumsum(good, 1) - 1)[good]] = done[good]
        return out, counts

    def pre_tokens(self, words: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Of stretches without white space: the bytes of all their pre-tokens, the size of each, and how many each word has."""
        plain = [w for w in words if max(w) < AGREED]
        # NFC, then lower case letter by letter: a capital sigma has one small form here.
        text = unicodedata.normalize("NFC", "\n".join(plain)).replace("Σ", "σ").lower()
        parts = self.pattern_or_end.findall(text)
        sizes = np.fromiter(map(len, parts if text.isascii() else map(str.encode, parts)), np.int64, len(parts))
        ends = np.fromiter(map("\n".__eq__, parts), bool, len(parts))
        numbers = np.cumsum(ends)[~ends]
        counts = np.bincount(numbers, minlength=len(plain)) if plain else np.zeros(0, np.int64)
        flat, sizes = [text.replace("\n", "").encode()], [sizes[~ends]]
        if len(plain) < len(words):
            rare = [w for w in words if max(w) >= AGREED]
            own = [self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(w)) for w in rare]
            pieces = [bytes(map(self.letter_byte.__getitem__, p)) for parts in own for p, _ in parts]
            flat.append(b"".join(pieces))
            sizes.append(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            counts = np.concatenate([counts, np.fromiter(map(len, own), np.int64, len(own))])
            plain += rare
        words[:] = plain
        return b"".join(flat), np.concatenate(sizes), counts

    def learn(self, words: list[str]) -> None:
        """Work out the ids of words that are not kept yet."""
        flat, sizes, pieces = self.pre_tokens(words)
        ids, counts = self.encode_pieces(np.frombuffer(flat, np.uint8), sizes)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(pieces)] * 2
        raw = ids.tobytes()
        at = 0
        for word, end in zip(words, ends.tolist(), strict=True):
            self.kept[word] = raw[at:end]
            at = end

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as 32-bit little-endian unsigned numbers."""
        block: list[list] = []
        chars = 0
        for k, text in enumerate(texts):
            parts: list = []
            at = 0
            for m in self.special_at.finditer(text) if "<|" in text else ():
                parts += [stretch(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            parts.append(stretch(text[at:] if at else text))
            block.append(parts)
            chars += len(text)
            if chars > CHARS_AT_ONCE or k == len(texts) - 1:
                new = set().union(*(p for parts in block for p in parts if not isinstance(p, int)))
                if len(self.kept) + len(new) > KEPT_WORDS:  # what this block uses stays: it holds the frequent words
                    self.kept = {w: self.kept[w] for w in new if w in self.kept}
                new.difference_update(self.kept)
                if new:
                    self.learn(sorted(new))
                for parts in block:
                    yield np.frombuffer(
                        b"".join(p.to_bytes(2, "little") if isinstance(p, int) else b"".join(map(self.kept.__getitem__, p)) for p in parts), "<u2"
                    ).astype("<u4")
                block, chars = [], 0

    def decode(self, ids: np.ndarray) -> str:
        """The names of the ids, joined by a space: what a file without a decoder decodes to; unknown ids give nothing."""
        names = self.names
        return " ".join([names[i] for i in ids.tolist() if i < len(names)])


_CONTROL = regex.compile("[\x1c-\x1f]")
_STRETCH = regex.compile(r"[^\t-\r \x85\xa0  -     　]+")


def stretch(text: str) -> list[str]:
    """The stretches between white space. U+001C to U+001F are white space to Python's split alone."""
    return _STRETCH.findall(text) if _CONTROL.search(text) else text.split()


@lru_cache(maxsize=2)
def coder(path: str) -> PairTreeBPE:
    """One coder a Python worker and file, so that its kept words last from task to task."""
    return PairTreeBPE(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with `ids`: the ids of the whole text as bytes, each a little-endian unsigned 32-bit number. text is dropped."""
    schema = T.StructType([f for f in docs.schema if f.name not in (text, "ids")] + [T.StructField("ids", T.BinaryType())])
    rest = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for part in pieces_of(batch, text):
                ids = [x.tobytes() for x in bpe.encode([x or "" for x in part.column(text).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(ids, pa.binary())], names=[*rest, "ids"])

    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with `decoded`: the text that its ids decode to, special tokens included."""
    schema = T.StructType([f for f in encoded.schema if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])
    rest = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for part in pieces_of(batch, "ids"):
                texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "decoded"])

    return encoded.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


def pieces_of(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose values in column come to about `most` bytes, so that one Arrow batch need not be held twice."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text of every document."""
    coded = decode(encode(docs.select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
