"""Hard negatives, the Jaccard join and spelling variants against brute force, on edge cases."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetseries.llm import hard_negatives, jaccard_join, spelling

DOC = "doc_id long, text string, x long, d string, token string, n long, count long, word string"


def documents(spark, texts):
    rows = [(k, t, 1, "a", "b", 2, 3, "c") for k, t in texts]
    return spark.createDataFrame(rows, DOC).repartition(4)


def near_copies(rng, base, most, how_many):
    """Copies of base with up to `most` words replaced."""
    out = []
    for _ in range(how_many):
        words = base.split()
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"word{k}" for k in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (90, 200, 201, 7, 4)]
    some = [None, "", " \t\n", "One", "one", "one two", "one two three", "a b c d", "A b\tC  d", "w " * 50000, "x y " * 300000]
    some += base + [base[1], base[1].upper(), base[0] + " tail", "une Été é", "une été é"]
    some += near_copies(rng, base[0], 4, 70) + near_copies(rng, base[1], 7, 40) + [t + " " + base[0] for t in near_copies(rng, base[2], 9, 12)]
    return [*enumerate(some), (3, base[0]), (None, base[1]), (None, None), (2, None)]


def linked(texts, size, percent):
    """(doc_id, set size, smallest id reachable) by comparing all."""
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {b" ".join(w)} if len(w) < size else set(zip(*(w[k:] for k in range(size)))))
    root = list(range(len(texts)))
    for i, p in enumerate(sets):
        for j in range(i):
            both = len(p & sets[j])
            if both and 100 * both >= percent * len(p | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (k, _), r in zip(texts, root):
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return Counter((k, len(s), least[r]) for (k, _), s, r in zip(texts, sets, root))


@pytest.mark.parametrize(("size", "percent", "short"), [(3, 90, 32), (5, 80, 3), (3, 70, 2)])
def test_jaccard_join_equals_all_pairs(spark, texts, monkeypatch, size, percent, short):
    monkeypatch.setattr(jaccard_join, "SHORT", short)  # so that most lists are long: what stars leave is joined exactly
    got = jaccard_join.near_duplicates(documents(spark, texts), size, percent)
    assert Counter(tuple(r) for r in got.collect()) == linked(texts, size, percent)
    assert jaccard_join.near_duplicates(documents(spark, texts).limit(0), size, percent).count() == 0


def test_overlap_thresholds():
    for n in range(1, 60):
        for m in range(1, 60):
            least = min((i for i in range(61) if 100 * i >= 90 * (n + m - i)))
            assert jaccard_join.least_overlap(n, m, 90) == least
            if 100 * min(n, m) >= 90 * max(n, m):  # else there is no link
                assert least >= jaccard_join.least_any(n, 90)


def variants_of(texts):
    counts = Counter()
    for k, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if k is None else k}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    vocabulary = {w: n for w, n in counts.items() if n > 1}

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    near = {w: [o for o in vocabulary if close(w, o)] for w in vocabulary}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-vocabulary[o], o), default=None)
        if best and vocabulary[best] >= 10 * vocabulary[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(near[w]), form.get(w), vocabulary.get(form.get(w)), root(w)) for w, n in vocabulary.items())


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(9)
    base = ["Elephant", "telephone", "révérence", "aaaaaaaa", "ÉLÉPHANT", "éléphantÿ", "mississippi", "abcdefg"]
    texts = []
    for k in range(300):
        found = []
        for w in rng.choices(base, weights=[60, 40, 20, 10, 5, 5, 5, 5], k=30):
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeiéz") + w[at + 1 :], w[:at] + rng.choice("aeiéz") + w[at:]])
            found.append(w)
        texts.append((k, " ".join(found)))
    long = "ab" * 400
    texts += [(1000, "zzzzzzzz " * 300), (1001, "zzzzzzzy " * 25), (1002, "zzzzzzxy zzzzzzxy")]
    return [*texts, (None, "elephant elephant"), (None, None), (5, None), (6, ""), (7, f"{long} {long} {long}b {long}b x{long} x{long}"), texts[0], texts[0]]


def test_spelling_variants_equal_all_pairs(spark, spelled):
    names = ("word", "n", "n_near", "form", "form_n", "root")
    got = sorted(tuple(r[c] for c in names) for r in spelling.variants(documents(spark, spelled)).collect())
    want = variants_of(spelled)
    assert got == want
    assert any(w[3] for w in want) and any(w[5] not in (w[0], w[3]) for w in want)  # chains of two steps occur
    assert spelling.variants(documents(spark, spelled).limit(0)).count() == 0


def test_spelling_in_passes_and_past_false_positives(spark, spelled, monkeypatch):
    """Filters of a bound that the vocabulary exceeds, and filters so full that most edits pass them."""
    want = variants_of(spelled[:150])
    monkeypatch.setattr(spelling, "FILTER_BYTES", 400)
    got = sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(documents(spark, spelled[:150])).collect())
    assert got == want
    monkeypatch.setattr(spelling, "BITS", 1)
    got = sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(documents(spark, spelled[:150])).collect())
    assert got == want


def mined(rows):
    """All pairs of rows (id, vector, label)."""
    known = [(k, np.array([int(np.floor(256 * x)) for x in v], object), y) for k, v, y in rows if None not in (k, v, y) and all(x is not None and np.isfinite(x) for x in v)]

    def score(a, b):
        n = min(len(a), len(b))
        return int(sum(a[:n] * b[:n])) if n else 0

    out = []
    for i, (k, v, y) in enumerate(known):
        if k % 50:
            continue
        others = sorted((-score(v, w), o, z) for j, (o, w, z) in enumerate(known) if j != i)
        for s, p, _ in [x for x in others if x[2] == y][:5]:
            fit = [x for x in others if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(k, p, r, o, -s, -t) for r, (t, o, _) in enumerate(fit, 1)]
    return Counter(out)


def vectors(spark, rows):
    named = "vec_id long, embedding array<double>, label int, row long, id long, score long, rank int, block int"
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], named).repartition(3)


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 300)
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16))
    rows = [(k, (middle[k % 12] + 0.3 * rng.normal(size=16)).tolist() if k % 3 else rng.normal(size=16).tolist(), int(rng.integers(4))) for k in range(1200)]
    rows += [(k, [0.5] * 16, k % 2) for k in range(1200, 1400)]  # many equal vectors
    rows += [(2000, None, 1), (2050, [0.5] * 16, None), (None, [0.5] * 16, 1), (2100, [0.5, float("nan")], 1), (2150, [0.5, None], 1), (2200, [float("inf")], 1)]
    rows += [(2250, [], 1), (2300, [0.25] * 4, 1), (2350, [0.0] * 16, 2), (2400, [1e4] * 20, 3), (2450, [-1.0] * 16, 0), rows[50], rows[50], rows[51]]
    got = hard_negatives.mine(hard_negatives.candidates(vectors(spark, rows)), F.col("id") % 50 == 0)
    assert Counter(tuple(r) for r in got.collect()) == mined(rows)


def test_hard_negatives_of_little(spark):
    for rows in ([], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1), (52, [0.6], 2)]):
        got = hard_negatives.mine(hard_negatives.candidates(vectors(spark, rows)), F.col("id") % 50 == 0)
        assert Counter(tuple(r) for r in got.collect()) == mined(rows)


def test_cover_tree_covers_and_prunes():
    """Every node's angle covers its rows, the leaves hold each row once, and a descent in clustered data visits few leaves."""
    rng = np.random.default_rng(1)
    middle = 200 * rng.normal(size=(40, 8))
    vec = (middle[rng.integers(40, size=4000)] + 5 * rng.normal(size=(4000, 8))).astype(np.int64)
    tree = hard_negatives.built(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), vec)
    assert sorted(tree.row) == list(range(4000))
    assert sum(b - a for a, b in tree.rows) == 4000
    up = np.column_stack([tree.vec, np.sqrt(np.maximum(tree.norm**2 - (tree.vec.astype(float) ** 2).sum(1), 0))])

    def spans(v):
        return [tree.rows[v]] + [s for c in range(*tree.child[v]) for s in spans(c)]

    for v in range(len(tree.centre)):
        for a, b in spans(v):
            angle = np.arccos(np.clip(up[a:b] @ tree.centre[v] / tree.norm**2, -1, 1))
            assert (angle <= tree.angle[v] + 1e-6).all()
    looked = defaultdict(int)

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                looked["rows"] += (key.stop or 0) - (key.start or 0)
            return super().__getitem__(key)

    part = tree._replace(label=tree.label.view(Counted))
    low, high = np.full((1, 1), -np.inf), np.full((1, 1), np.inf)
    _, _, at, score = hard_negatives.searched(part, np.array([-1]), np.array([0]), vec[:1], low, high, True, 5)
    assert sorted(score) == sorted((vec @ vec[0]).astype(float))[-5:]
    assert looked["rows"] < 1000
