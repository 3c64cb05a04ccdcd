"""Hard negatives for contrastive training by exact inner-product search in cover trees.

Rows are dealt by hash to blocks of about BLOCK rows. A block's vectors get one more component, so that all have the
largest norm M of the block: then they lie on a sphere, and the inner product with an anchor falls with the angle to
it. Over them stands a cover tree: the scale of a level is BASE times that of the next, a node's children are a net of
its rows (farthest first, FAN of them at a time; the rest of a level's net follows in more nodes of that level), and
each node knows the radius that covers all its rows. By the triangle inequality on the sphere a node with centre c and
covering angle r holds no inner product above |q| M cos(angle(q, c) - r) and none below |q| M cos(angle(q, c) + r).

Anchors go to all blocks in groups. A descent goes level by level and drops nodes outside all of an anchor's windows;
the leaves that are left are visited best first, one, then two, four and so on, as long as their upper bound reaches
the worst result kept. A leaf's scores are exact integers. Each block gives its best few rows per anchor and window,
and the best of those are the result.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; scaled components
are held within 2^26 on both sides (scores then fit a long up to 2,047 dimensions); missing components of shorter
vectors count as zero; an empty vector scores zero; repeated rows are rows of their own: an anchor is left out of its
own positives once, and repeated anchors each get their results; an anchor without positives, or a positive without
negatives in its window, gives no row; ties go to the smaller id, then to any; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseries.llm.common import cut

POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score between which a negative's lies.
LOW, HIGH = 50, 95
SCALE, BOUND = 256, 1 << 26
BLOCK, GROUP, LEAF, FAN, BASE = 8192, 1024, 48, 64, 1.3
FIELDS = ("row", "id", "label", "vec")
EXACT = float(1 << 53)


class Tree(NamedTuple):
    """A block's rows in the order of the leaves, and its nodes in breadth-first order: children and rows are ranges."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vec: np.ndarray
    norm: float
    centre: np.ndarray  # of each node, with the further component
    angle: np.ndarray  # that covers all rows of the node
    child: np.ndarray  # first and last + 1
    rows: np.ndarray  # first and last + 1


def matrix(vectors) -> np.ndarray:
    """The vectors as integers, with zeros for missing components."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def columns(table: pa.Table) -> tuple:
    return (*(table[c].to_numpy().astype(np.int64) for c in FIELDS[:3]), matrix([v.values.to_numpy(zero_copy_only=False) for v in table["vec"].combine_chunks()]))


def built(row: np.ndarray, ids: np.ndarray, label: np.ndarray, vec: np.ndarray) -> Tree:
    """The cover tree of a block."""
    first = np.argsort(ids, kind="stable")  # so that leaves have their rows in the order of ids
    row, ids, label, vec = row[first], ids[first], label[first], vec[first]
    wide = vec.astype(np.float64)
    square = (wide * wide).sum(1)
    norm = float(np.sqrt(square.max(initial=0)))
    points = np.column_stack([wide, np.sqrt(np.maximum(norm * norm - square, 0))])

    def away(at: np.ndarray, centre: int) -> np.ndarray:
        d = points[at] - points[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    todo = [(np.arange(len(ids)), 0, away(np.arange(len(ids)), 0))] if len(ids) else []
    centre, chord, child, spans, order, k, filled = [], [], [], [], [], 0, 0
    while k < len(todo):
        at, mid, far = todo[k]
        todo[k] = None
        radius = far.max()
        centre.append(mid)
        chord.append(radius)
        start = len(todo)
        if len(at) > LEAF and radius > 0:
            scale = 2 * norm * BASE ** -np.ceil(np.log(2 * norm / radius) / np.log(BASE) + 1e-9)
            if scale >= radius:
                scale /= BASE
            own, nearest, mids = np.zeros(len(at), np.int64), far.copy(), [mid]
            while len(mids) < FAN and nearest.max() > scale:
                mids.append(int(at[nearest.argmax()]))
                d = away(at, mids[-1])
                closer = d < nearest
                own[closer], nearest[closer] = len(mids) - 1, d[closer]
            for j, m in enumerate(mids):
                mine = own == j
                if mine.any():
                    todo.append((at[mine], m, nearest[mine]))
            spans.append((0, 0))
        else:
            order.append(np.sort(at))
            spans.append((filled, filled + len(at)))
            filled += len(at)
        child.append((start, len(todo)))
        k += 1
    order = np.concatenate(order) if order else np.empty(0, np.int64)
    angle = 2 * np.arcsin(np.minimum(np.array(chord) / (2 * norm), 1)) if norm else np.zeros(len(chord))
    return Tree(row[order], ids[order], label[order], vec[order], norm, points[centre], angle, np.array(child).reshape(-1, 2), np.array(spans).reshape(-1, 2))


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def searched(tree: Tree, row: np.ndarray, label: np.ndarray, vec: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
    """The k best rows of a block by anchor and window (low and high are anchors x windows): (anchor, window, tree row, score).

    same: of the anchor's label, but not itself; else of other labels. Windows that hold nothing are high < low.
    """
    width = max(vec.shape[1], tree.vec.shape[1])
    q, x = widened(vec, width), widened(tree.vec, width)
    long = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    if long.max(initial=0) * tree.norm < EXACT:
        q, x = q.astype(np.float64), x.astype(np.float64)  # sums of integers below 2^53 are exact, and fast
    centres = np.column_stack([widened(tree.centre[:, :-1], width), np.zeros(len(tree.centre))])  # an anchor's further component is zero
    reach = long * tree.norm
    top, slack = np.where(high >= low, high, -np.inf).max(1, initial=-np.inf), 1e-6 * reach + 1e-6
    floor = low.astype(np.float64)
    alive = np.zeros((len(q), len(tree.centre)), bool)
    upper = np.full(alive.shape, -np.inf)
    level = np.arange(min(1, len(tree.centre)))
    alive[:, level] = True
    while len(level):
        cosine = q.astype(np.float64) @ centres[level, :-1].T / np.where(reach > 0, reach, 1)[:, None]
        angle = np.arccos(np.clip(cosine, -1, 1))
        most = reach[:, None] * np.cos(np.maximum(angle - tree.angle[level], 0)) + slack[:, None]
        least = reach[:, None] * np.cos(np.minimum(angle + tree.angle[level], np.pi)) - slack[:, None]
        meets = np.zeros(most.shape, bool)
        for j in range(low.shape[1]):
            meets |= (least <= high[:, j : j + 1]) & (most >= low[:, j : j + 1]) & (low[:, j : j + 1] <= high[:, j : j + 1])
        alive[:, level] &= meets
        upper[:, level] = np.where(alive[:, level], np.minimum(most, top[:, None]), -np.inf)
        below = [np.arange(*tree.child[v]) for v in level[alive[:, level].any(0)]]
        for v in level:
            alive[:, slice(*tree.child[v])] = alive[:, v : v + 1]
        level = np.concatenate(below) if below else np.empty(0, np.int64)
    leaves = np.flatnonzero((tree.rows[:, 1] > tree.rows[:, 0]) & alive.any(0))
    bound = upper[:, leaves]
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    found = [np.empty(0, np.int64)] * 3 + [np.empty(0, x.dtype)]  # anchor, window, tree row, score
    at, step = 0, 1
    while at < len(leaves):
        asked = bound[:, at : at + step] >= np.maximum(floor.min(1, initial=np.inf), -np.finfo(float).max)[:, None]
        if not asked.any():
            break
        who, which = np.nonzero(asked)
        leaf = order[:, at : at + step][who, which]
        by_leaf = np.argsort(leaf, kind="stable")
        who, leaf = who[by_leaf], leaf[by_leaf]
        hits = [found]
        for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))), strict=True):
            people, span = who[a:b], slice(*tree.rows[leaves[leaf[a]]])
            score = q[people] @ x[span].T
            fits = (label[people, None] == tree.label[None, span]) == same
            if same:
                fits &= row[people, None] != tree.row[None, span]
            for j in range(low.shape[1]):
                i, c = np.nonzero(fits & (score >= floor[people, j, None]) & (score <= high[people, j, None]))
                if len(i):
                    hits.append([people[i], np.full(len(i), j), c + span.start, score[i, c]])
        anchor, window, at_row, score = (np.concatenate(part) for part in zip(*hits, strict=True))
        first = np.lexsort((tree.row[at_row], tree.id[at_row], -score, window, anchor))
        anchor, window, at_row, score = anchor[first], window[first], at_row[first], score[first]
        key = anchor * low.shape[1] + window
        start = np.flatnonzero(np.diff(key, prepend=-1))
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        found = [part[rank < k] for part in (anchor, window, at_row, score)]
        full = rank == k - 1
        floor[anchor[full], window[full]] = np.maximum(floor[anchor[full], window[full]], score[full])
        at, step = at + step, 2 * step
    return found


def candidates(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(row, id, label, vec) of the rows that take part; vec is the integer part of SCALE times each component."""
    scaled = F.transform(vec, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(BOUND)), F.lit(-BOUND)))
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    known = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull()).where(sound)
    return known.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.cast("array<long>").alias("vec"))


def dealt(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """rows with a number of a part of about `size` rows, and how many parts there are."""
    parts = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), parts


def forest(rows: DataFrame) -> DataFrame:
    """(block, tree): a cover tree over each block of rows."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"][:1].cast(pa.int32()), "tree": pa.array([pickle.dumps(tuple(built(*columns(table))))], pa.binary())})

    return dealt(rows, "block", BLOCK)[0].groupBy("block").applyInArrow(run, "block int, tree binary")


def asked(anchors: DataFrame, trees: DataFrame, same: bool, k: int) -> DataFrame:
    """(row, window, other, other_id, score): the best k in the windows (low, high: arrays) of each anchor."""
    parts, n = dealt(anchors, "part", GROUP)
    each = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(own: pa.Table, tables: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and tables.num_rows:
            row, ids, label, vec = columns(own)
            tree = Tree(*pickle.loads(tables["tree"][0].as_py()))
            low, high = (matrix_of_windows(own[c], fill) for c, fill in (("low", np.inf), ("high", -np.inf)))
            anchor, window, at, score = searched(tree, row, label, vec, low, high, same, k)
            out = [row[anchor], window, tree.row[at], tree.id[at], np.asarray(score).astype(np.int64)]
        return pa.table(dict(zip(("row", "window", "other", "other_id", "score"), (pa.array(c, pa.int64()) for c in out or [[]] * 5), strict=True)))

    copies = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(trees.count() and trees.agg(F.max("block")).first()[0]))))
    found = copies.groupBy("part", "block").cogroup(each.groupBy("part", "block")).applyInArrow(run, "row long, window long, other long, other_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), "other_id", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def matrix_of_windows(values: pa.ChunkedArray, fill: float) -> np.ndarray:
    lists = values.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0)), fill)
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def mine(rows: DataFrame, anchor: Column) -> DataFrame:
    """Hard negatives of the rows(row, id, label, vec) for which anchor holds.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    POSITIVES best rows of its label, the NEGATIVES best rows of other labels whose score is LOW to HIGH percent of
    the positive's.
    """
    rows = cut(rows, "vectors")
    trees = cut(forest(rows), "cover-trees")
    anchors = rows.where(anchor)
    everything = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    positives = cut(asked(anchors.withColumns(dict(zip(("low", "high"), everything, strict=True))), trees, True, POSITIVES), "positives")
    windows = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "other_id"))).alias("p"))
    cuts = {
        "low": F.transform("p", lambda e: F.ceil(e["score"] * LOW / 100).cast("double")),
        "high": F.transform("p", lambda e: F.floor(e["score"] * HIGH / 100).cast("double")),
    }
    with_windows = anchors.join(windows.withColumns(cuts), "row")
    found = asked(with_windows.select(*FIELDS, "low", "high"), trees, False, NEGATIVES)
    named = positives.select("row", (F.col("rank") - 1).cast("long").alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        found.withColumnsRenamed({"other_id": "negative_id", "score": "negative_score"})
        .join(named, ["row", "window"])
        .join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank,
         s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
