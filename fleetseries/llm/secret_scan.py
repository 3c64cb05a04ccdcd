"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Patterns find assignments, access keys and long hexadecimal runs. Candidates are all runs of 12 or more characters
that CANDIDATE finds, long words among them. The network, in numpy, sees a candidate in windows of SPAN characters with LEFT characters
before and RIGHT after it: letters inside the candidate and around it have embeddings of their own, a convolution of
WIDTH characters and a maximum over the window follow, and a candidate's score is its highest window's.

It is trained on labelled findings of all documents: what the patterns find, also with random keys (some of letters alone)
in its place, against every candidate that no pattern finds. Findings are dealt by hash to parts of about PART windows.
In each of ROUNDS rounds every part takes the common network once through all its windows, and the next network is the
mean of the parts' by their windows: a fixed size, summed by Spark in whole numbers, so the order of sums does not matter.
A quarter of the windows stays out of the fit: a logistic curve calibrates the margins on all of it, counted in cells of
1 / GRID, and the threshold is the highest that finds RECALL of its real secrets and RECALL of its drawn ones.

Spans are code points, end exclusive. Cases: a null text counts as empty; spans that touch or overlap a pattern's
are not added; equal texts give equal spans; with no secret among the documents only drawn ones are learnt;
repeated rows each come back; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from fleetseries.llm.common import cut

LEFT, SPAN, RIGHT = 20, 44, 8
WIDTH, FILTERS, BATCH, RECALL = 5, 24, 128, 0.97
#: Windows of a part, rounds over all parts, least steps of a round, and the fineness of summed weights and of margins.
PART, ROUNDS, STEPS, UNIT, GRID, WIDEST = 32768, 3, 200, 1 << 20, 256, 64
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}|[0-9A-Za-z.@:-]{12,}|[A-Za-z0-9+/_=.-]{12,}")
KEYWORDS = ("passw", "secret", "token", "api")


def base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, leftmost and not overlapping within a kind, in the order of kinds."""
    lower = text.lower()
    out = []
    if any(k in lower for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else len(KINDS), s[2]))


def digest_string(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def candidates(text: str, known: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Candidate runs that touch no known span."""
    return [c for c in (m.span() for m in CANDIDATE.finditer(text)) if all(c[1] < a or c[0] > b for _, a, b in known)]


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """The candidate's windows: character codes (others: 1), those inside the candidate 128 higher, padding 0."""
    out = []
    for at in range(start, max(end, start + 1), SPAN):
        stop = min(at + SPAN, end)
        low = max(at - LEFT, 0)
        codes = np.array([min(ord(c), 128) % 128 or 1 for c in text[low : stop + RIGHT]], np.int64)
        codes[at - low : stop - low] += 128
        row = np.zeros(LEFT + SPAN + RIGHT, np.int64)
        row[LEFT - (at - low) : LEFT - (at - low) + len(codes)] = codes
        out.append(row)
    return out


class CharNet:
    """Embedding and convolution in one table by place and character, ReLU, maximum over places, logistic output."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.15, (WIDTH, 256, FILTERS))
        self.shift = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.3, FILTERS)
        self.bias = np.zeros(1)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = x.shape[1] - WIDTH + 1
        table = self.table.astype(np.float32)  # half the memory to fetch, several times as fast
        h = np.take(table[0], x[:, :n], axis=0)
        for k in range(1, WIDTH):
            h += np.take(table[k], x[:, k : k + n], axis=0)
        at = h.argmax(1)
        top = np.maximum(np.take_along_axis(h, at[:, None, :], 1)[:, 0] + self.shift, 0)
        return top @ self.out + self.bias[0], top, at

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[k : k + 512])[0] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def train(self, plain: np.ndarray, real: np.ndarray, seed: int) -> None:
        """At least one pass over all plain and all real windows: Adam on the logistic loss. Half of a batch is plain, a third of the rest has drawn keys."""
        rng = np.random.default_rng(seed)
        plain = plain if len(plain) else PLAIN
        half = BATCH // 2
        own = half * 2 // 3 if len(real) else 0
        steps = max(STEPS, -(-len(plain) // half), -(-len(real) // own) if own else 0)
        plain_at, real_at = cycled(rng, len(plain), half, steps), cycled(rng, len(real), own, steps)
        y = np.repeat([0, 1], [half, half])
        params = self.params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        filters = np.arange(FILTERS)
        for step in range(1, steps + 1):
            mine, secrets = plain[plain_at[step - 1]], real[real_at[step - 1]]
            around = [secrets[k % own] if own and k % 2 else mine[k] for k in range(half - own)]
            x = np.concatenate([mine, secrets, [replanted(rng, r) for r in around]])
            margin, top, at = self.forward(x)
            e = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
            back = (e[:, None] * self.out) * (top > 0)
            grads = [np.zeros_like(self.table), back.sum(0), top.T @ e, np.array([e.sum()])]
            for k in range(WIDTH):
                np.add.at(grads[0][k], (x[np.arange(len(x))[:, None], at + k], filters), back)
            grads[0] += 1e-4 * self.table
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.shift, self.out, self.bias]

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([p.ravel() for p in self.params()])

    @classmethod
    def of(cls, flat: np.ndarray) -> CharNet:
        net, at = cls(), 0
        for p in net.params():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return net


def cycled(rng: np.random.Generator, n: int, size: int, steps: int) -> np.ndarray:
    """Places below n for each of `steps` batches: all of them in random order, then all of them again."""
    if not n or not size:
        return np.zeros((steps, 0), np.int64)
    return np.concatenate([rng.permutation(n) for _ in range(-(-steps * size // n))])[: steps * size].reshape(steps, size)


ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-")
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


CODES = [[np.frombuffer(letters.encode(), np.uint8).astype(np.int64) for letters in kinds] for kinds in (LETTERS, ALPHABETS)]


def drawn(rng: np.random.Generator) -> np.ndarray:
    """The codes of a random key of 12 to 64 characters of one alphabet, a third of them of letters alone."""
    kind, which, n = rng.integers(0, (3, 60, 53)).tolist()
    kinds = CODES[min(kind, 1)]
    letters = kinds[which % len(kinds)]
    return letters[rng.integers(0, len(letters), 12 + n)]


def replanted(rng: np.random.Generator, row: np.ndarray) -> np.ndarray:
    """The window with a random key in the place of its finding."""
    stop = len(row) - int((row[::-1] >= 128).argmax())
    key = drawn(rng)
    inside = min(len(key), SPAN)
    told = np.concatenate([key[:inside] + 128, key[inside:], row[stop : stop + RIGHT]])[: inside + RIGHT]
    out = np.zeros_like(row)
    out[:LEFT], out[LEFT : LEFT + len(told)] = row[:LEFT], told
    return out


def findings(text: str) -> list[tuple[int, str, int, int]]:
    """(label, context, start, end): patterns' values are secrets; candidates are not."""
    known = base(text)
    out = []
    for kind, a, b in known:
        if kind == "assign":
            a = ASSIGN.match(text, a).start(2)
        out.append((1, a, b))
    out += [(0, *c) for c in candidates(text, known)]
    rows = []
    for label, a, b in out:
        low = max(a - LEFT, 0)
        rows.append((label, text[low : b + RIGHT], a - low, b - low))
    return rows


#: Stands for the plain windows where there are none.
PLAIN = np.array(windows("the word stands here", 4, 8))


def learnable(context: str, start: int, end: int) -> list[np.ndarray]:
    """The windows of a finding that it is learnt by: the first, and all others with at least 12 of its characters."""
    made = windows(context, start, end)
    return made[: max(1, (end - start - 12) // SPAN + 1)]


def parted(seen: list[bytes], kinds: list[int]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The (plain, real) windows to learn from, and a quarter by hash that is kept apart; where either is empty, all serve as both."""
    order = sorted(zip(kinds, seen, strict=True))
    kind, apart = np.array([k for k, _ in order], int), np.array([zlib.crc32(w) % 4 == 0 for _, w in order], bool)
    x = np.frombuffer(b"".join(w for _, w in order), np.uint8).reshape(len(order), LEFT + SPAN + RIGHT).astype(np.int64)
    used = [~apart, apart] if apart.any() and not apart.all() else [np.ones(len(order), bool)] * 2
    return tuple((x[u & (kind == 0)], x[u & (kind == 1)]) for u in used)


def cells(net: CharNet, plain: np.ndarray, real: np.ndarray, seed: int) -> Counter:
    """How many margins lie in each (kind, cell of 1 / GRID): plain windows 0, real ones 1, and with drawn keys, over a quarter of both, 2."""
    rng = np.random.default_rng(seed)
    plain = plain if len(plain) else PLAIN
    both = np.concatenate([plain, real])
    made = np.array([replanted(rng, both[k]) for k in cycled(rng, len(both), max(STEPS, len(both) // 4), 1)[0]])
    out: Counter = Counter()
    for kind, x in enumerate((plain, real, made)):
        at, n = np.unique(np.floor(np.clip(net.margins(x), -WIDEST, WIDEST) * GRID).astype(np.int64), return_counts=True)
        out.update({(kind, int(a)): int(c) for a, c in zip(at, n, strict=True)})
    return out


def fit(docs: DataFrame) -> dict:
    """The network, the calibration and the threshold, from the findings of all documents; equal windows of a kind count once."""

    def made(rows: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.binary())], names=["kind", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: set = set()
        for batch in batches:
            for x in batch.column(0):
                rows.update((label, w.astype(np.uint8).tobytes()) for label, *f in set(findings(x.as_py() or "")) for w in learnable(*f))
                if len(rows) >= PART:
                    yield made(rows)
                    rows = set()
        yield made(rows)

    found = cut(docs.select("text").mapInArrow(run, "kind int, seen binary").distinct(), "findings")
    parts = max(1, -(-found.count() // PART))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("seen"), F.lit(parts))).repartition(2 * parts, "part").groupBy("part")
    flat = CharNet().flat()
    for turn in range(ROUNDS):
        flat = averaged(dealt, flat, turn, flat)

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        _, (plain, real) = parted(table["seen"].to_pylist(), table["kind"].to_pylist())
        got = cells(CharNet.of(flat), plain, real, key[0].as_py())
        return pa.table({"kind": pa.array([k for k, _ in got], pa.int32()), "cell": pa.array([c for _, c in got], pa.int32()), "n": pa.array(got.values(), pa.int64())})

    counted = dealt.applyInArrow(judge, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()  # 3 * 2 * WIDEST * GRID rows at most
    net = CharNet.of(flat)
    return judged(net, Counter({(r.kind, r.cell): r.n for r in counted}) or cells(net, PLAIN, PLAIN[:0], 0))


def averaged(dealt: GroupedData, flat: np.ndarray, turn: int, nothing: np.ndarray) -> np.ndarray:
    """The mean, by their windows, of the networks that the parts make of one in a round; `nothing` where there is no part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (plain, real), _ = parted(table["seen"].to_pylist(), table["kind"].to_pylist())
        net = CharNet.of(flat)
        net.train(plain, real, 1000 * key[0].as_py() + turn)
        whole = np.round(np.append(net.flat(), 1.0) * (table.num_rows * UNIT)).astype(np.int64)
        return pa.table({"sums": pa.array([whole], pa.list_(pa.int64()))})

    sums = dealt.applyInArrow(run, "sums array<long>").select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()  # a row a weight
    total = np.zeros(len(flat) + 1)
    for r in sums:
        total[r.k] = r.s
    return total[:-1] / total[-1] if total[-1] else nothing


def learnt(real: list[tuple[str, int, int]], plain: list[tuple[str, int, int]]) -> dict:
    """The model from one part in memory: findings (context, start, end) that are secrets, and some that are not."""
    rows = sorted({(kind, w.astype(np.uint8).tobytes()) for kind, own in enumerate((plain, real)) for f in own for w in learnable(*f)})
    learn, apart = parted([w for _, w in rows], [k for k, _ in rows])
    net = CharNet()
    for turn in range(ROUNDS):
        net.train(*learn, turn)
    return judged(net, cells(net, *apart, 0))


def judged(net: CharNet, counted: Counter) -> dict:
    """The model with its calibration and threshold from the counts of margins by (kind, cell)."""
    keys = sorted(counted)
    which, m, n = np.array([k for k, _ in keys]), np.array([c for _, c in keys]) / GRID, np.array([counted[k] for k in keys])
    truth = np.minimum(which, 1)
    a, b = calibrate(m, truth, n)
    p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
    threshold = recalling(p, which, n)
    rate = lambda c: float(n[(truth == c) & (p >= threshold)].sum() / max(n[truth == c].sum(), 1))
    return {"net": net, "a": a, "b": b, "threshold": threshold, "recall": rate(1), "false": rate(0)}


def recalling(p: np.ndarray, which: np.ndarray, n: np.ndarray | None = None) -> float:
    """The highest threshold that finds RECALL of the real secrets (which is 1), and of the drawn ones (2); p stands n times."""
    n = np.ones(len(p), np.int64) if n is None else n
    found = []
    for k in (1, 2):
        own = np.flatnonzero(which == k)
        if len(own):
            order = own[np.argsort(p[own], kind="stable")]
            upto = np.cumsum(n[order])
            found.append(float(p[order[np.searchsorted(upto, int((1 - RECALL) * int(upto[-1])), side="right")]]))
    return min(found)


def calibrate(m: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """A logistic curve over the margins, which stand n times, by gradient steps on standardised margins; both classes weigh the same."""
    w = sum(np.where(y == c, n / max(n[y == c].sum(), 1), 0.0) for c in (0, 1))
    w = w / w.sum()
    mean = (w * m).sum()
    sd = np.sqrt((w * (m - mean) ** 2).sum()) + 1e-9
    z = (m - mean) / sd
    a, b = 1.0, 0.0
    for _ in range(500):
        e = w * (1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y)
        a, b = a - 0.5 * ((e * z).sum() + 1e-3 * a), b - 0.5 * e.sum()
    return float(a / sd), float(b - a * mean / sd)


def spans(texts: list[str], model: dict) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: the patterns', and the candidates that the network finds (kind net)."""
    found = [base(t) for t in texts]
    asked = [(k, a, b) for k, t in enumerate(texts) for a, b in candidates(t, found[k])]
    rows, owner = [], []
    for i, (k, a, b) in enumerate(asked):
        own = windows(texts[k], a, b)
        rows += own
        owner += [i] * len(own)
    if rows:
        p = 1 / (1 + np.exp(-np.clip(model["a"] * model["net"].margins(np.array(rows)) + model["b"], -30, 30)))
        best = np.zeros(len(asked))
        np.maximum.at(best, owner, p)
        for i in np.flatnonzero(best >= model["threshold"]):
            k, a, b = asked[i]
            found[k] = [*found[k], ("net", a, b)]
    return found


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every document. The network has a fixed size, so each task gets a copy."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = spans([x or "" for x in batch.column(1).to_pylist()], held.value)
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in ordered(s)] for s in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return made.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:bigint,end:bigint>>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the patterns' counts and the digest of their spans, and all spans in one string."""
    found = scan(docs, fit(docs))
    joined = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = F.filter("found", lambda s: s["kind"] != "net")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by [SECRET]."""
    out, at = [], 0
    for a, b in merged(found):
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def merged(found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, a, b in ordered(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in their texts replaced, and n_chars (if there is one) counted anew for these. Null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            texts = columns["text"].to_pylist()
            found = spans([x or "" for x in texts], held.value)
            new = [redacted(x, f) if f else x for x, f in zip(texts, found, strict=True)]
            columns["text"] = pa.array(new, batch.column("text").type)
            if "n_chars" in columns:
                lengths = [len(x) if f else n for x, f, n in zip(new, found, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def sha(spans_: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(digest_string(spans_).encode()).hexdigest()
