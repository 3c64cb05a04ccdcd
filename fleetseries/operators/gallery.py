"""Exact nearest neighbours in a gallery, union and reclustering of clients' codebooks, and rescoring of changed regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseries.functions.frames import framed, settled

#: Vectors of one cell of the gallery that meet queries at once, queries that meet them, and the cells at most.
CELL, GROUP, CELLS = 4096, 4096, 256

# -- nearest neighbours --------------------------------------------------------------------------------


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centres(gallery: DataFrame, cells: int) -> np.ndarray:
    """Some vectors of the gallery, by the hash of their id: CELLS at most, so every task gets them all. They steer the search, not its result."""
    rows = gallery.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").collect()
    return np.array([r.v for r in rows], float) if rows else np.zeros((0, 0))


def nearest_in_gallery(queries: DataFrame, gallery: DataFrame, cells: int = CELLS, cell: int = CELL) -> DataFrame:
    """(id, nearest, rmse, seen): for each query(id, v) the gallery vector(id, v) at the least distance, ties to the smaller id.

    rmse is the distance over the root of the dimension, seen the number of gallery vectors that the query was
    compared with. Exact, without meeting the whole gallery: its vectors belong to the nearest of `cells` centres. A
    query first searches the cell of its own nearest centre; what it finds there bounds the distance, and only cells
    whose ring of distances to their centre the bound can reach (triangle inequality) are searched next. Cells are cut
    into pieces of about `cell` vectors, so a cell that holds most of the gallery is searched by many tasks, each with the
    part of its piece in the ring. Queries of an empty gallery, and null vectors, have no row.
    """
    queries, gallery = queries.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v"), settled(gallery.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v"))
    middle = centres(gallery, cells)
    if not len(middle):
        return queries.select("id", F.lit(None).cast("long").alias("nearest"), F.lit(None).cast("double").alias("rmse"), F.lit(0).cast("long").alias("seen")).limit(0)
    kind = gallery.schema["id"].dataType.simpleString()

    def placed(batches):
        for batch in batches:
            v = vectors(batch.column("v"))
            gap = gaps(v, middle)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(gap.argmin(1), pa.int32()), pa.array(gap.min(1) if len(v) else [], pa.float64()), pa.array(list(gap), pa.list_(pa.float64()))],
                names=["id", "v", "c", "r", "gaps"],
            )

    layout = f"id {kind}, v array<double>, c int, r double, gaps array<double>"
    double = lambda df: df.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    held = settled(double(gallery).mapInArrow(placed, layout).drop("gaps"))
    asked = settled(double(queries).mapInArrow(placed, layout.replace(f"id {kind}", f"id {queries.schema['id'].dataType.simpleString()}")))
    size = held.groupBy("c").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    parts = F.greatest(F.ceil(F.col("n") / cell), F.lit(1)).cast("int")
    sizes = settled(size.withColumn("parts", parts))  # `cells` rows at most
    pieces = settled(held.join(F.broadcast(sizes.select("c", "parts")), "c").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))

    # an own cell can be empty only if no vector is nearest to that centre, and the centre is one
    own = searched(asked.select("id", "v", "c", F.lit(float("inf")).alias("bound"), F.col("r").alias("gap")), pieces, sizes)
    first = settled(best_of(own))
    lists = F.broadcast(sizes.agg(F.collect_list(F.struct("c", "lo", "hi")).alias("cells")))  # one row of `cells` entries
    reach = lambda s: (s["c"] != F.col("c")) & (F.get("gaps", s["c"]) - F.col("bound") <= s["hi"] + 1e-9) & (F.get("gaps", s["c"]) + F.col("bound") >= s["lo"] - 1e-9)
    bounded = asked.join(first.select("id", F.col("d").alias("bound")).distinct(), "id").crossJoin(lists)
    more = bounded.select("id", "v", "bound", "gaps", F.explode(F.filter("cells", reach)).alias("s")).select("id", "v", F.col("s.c").alias("c"), "bound", F.get("gaps", F.col("s.c")).alias("gap"))
    both = best_of(first.unionByName(searched(more, pieces, sizes)))
    return both.select("id", "nearest", (F.col("d") / F.sqrt(F.lit(float(middle.shape[1])))).alias("rmse"), "seen")


def vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all of a to all of b, some rows at a time; from differences, so that equal vectors are at zero."""
    out = np.zeros((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for at in range(0, len(a), step):
        out[at : at + step] = np.sqrt(((a[at : at + step, None] - b[None]) ** 2).sum(2))
    return out


def searched(asked: DataFrame, pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, nearest, d, seen) from each piece of the cells that queries (id, v, c, bound, gap) ask for."""
    id_kind, near_kind = (df.schema["id"].dataType.simpleString() for df in (asked, pieces))
    dealt = asked.join(F.broadcast(sizes.select("c", "parts")), "c").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = dealt.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(16)))  # queries that all want one cell meet its pieces in many tasks
    copies = pieces.join(settled(groups.select("c", "p", "g").distinct()), ["c", "p"])

    def run(own: pa.Table, cell: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if own.num_rows and cell.num_rows:
            cell = cell.sort_by([("r", "ascending"), ("id", "ascending")])
            v, r, ids = vectors(cell["v"].combine_chunks()), cell["r"].to_numpy(), cell["id"]
            q, bound, gap = vectors(own["v"].combine_chunks()), own["bound"].to_numpy(), own["gap"].to_numpy()
            low, high = np.searchsorted(r, gap - bound - 1e-9), np.searchsorted(r, gap + bound + 1e-9, side="right")
            for k in np.flatnonzero(high > low).tolist():
                d = np.sqrt(((v[low[k] : high[k]] - q[k]) ** 2).sum(1))
                at = min(np.flatnonzero(d == d.min()).tolist(), key=lambda i: ids[int(low[k]) + i].as_py())
                for column, value in zip(out, (own["id"][k].as_py(), ids[int(low[k]) + at].as_py(), float(d[at]), int(high[k] - low[k])), strict=True):
                    column.append(value)
        return pa.table({"id": pa.array(out[0], own.schema.field("id").type), "nearest": pa.array(out[1], cell.schema.field("id").type), "d": pa.array(out[2], pa.float64()), "seen": pa.array(out[3], pa.int64())})

    return groups.groupBy("c", "p", "g").cogroup(copies.groupBy("c", "p", "g")).applyInArrow(run, f"id {id_kind}, nearest {near_kind}, d double, seen long")


def best_of(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min(F.struct("d", "nearest")).alias("b"), F.sum("seen").alias("seen")).select("id", "b.nearest", "b.d", "seen")


# -- union and reclustering ----------------------------------------------------------------------------


def recluster(stats: DataFrame, book: DataFrame, threshold: float, steps: int = 5) -> DataFrame:
    """(slot, c, n): a codebook made anew from all clients' code means, each new code in the slot of the old one it is like.

    stats: client, code, n, m (an array of sums); book: slot, c. Means of codes with n >= threshold are points of weight
    n. Seeds are chosen farthest first, from the heaviest point on, so a rare but distinct code is kept; then `steps`
    weighted Lloyd steps move them (a centre without points stays). New and old codes are matched one to one, the
    nearest pair first. Slots without a new code keep the old one with n = 0. Ties go to the smaller client, code, slot.

    The points stay a table: each seed is one aggregate over them, and only the K centres (a codebook) reach the driver.
    """
    live = stats.where(F.col("n") >= threshold).select("client", "code", F.col("n").cast("double").alias("w"), F.transform("m", lambda x: x / F.col("n")).alias("v"))
    points = settled(live)
    old = sorted((r.slot, list(map(float, r.c))) for r in book.select("slot", "c").collect())  # a codebook
    array = lambda c: F.array(*(F.lit(float(x)) for x in c))
    order = F.struct(-F.col("w"), F.col("client"), F.col("code"))
    first = points.agg(F.min_by("v", order).alias("v")).first().v
    seeds: list[list[float]] = [first] if first is not None else []
    far = points.withColumn("d2", distance(F.col("v"), array(first)) ** 2) if seeds else points
    distinct = points.count()
    while len(seeds) < min(len(old), distinct):
        if len(seeds) % 8 == 0:  # so that the plan stays short
            far = settled(far)
        nxt = far.agg(F.min_by("v", F.struct(-F.col("d2"), F.col("client"), F.col("code"))).alias("v")).first().v
        seeds.append(nxt)
        far = far.withColumn("d2", F.least("d2", distance(F.col("v"), array(nxt)) ** 2))
    centre = [list(map(float, s)) for s in seeds]

    def assigned(rows: DataFrame) -> DataFrame:
        each = F.array(*(F.struct(distance(F.col("v"), array(c)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centre)))
        return rows.withColumn("k", F.array_min(each)["k"])

    weights: dict[int, float] = {}
    for step in range(steps + 1 if centre else 0):
        placed = assigned(points).select("k", "w", F.posexplode("v").alias("j", "x"))
        sums = placed.groupBy("k", "j").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("w")).collect()  # a codebook
        weights = {r.k: r.w for r in sums}
        if step < steps:
            for r in sums:
                centre[r.k][r.j] = r.s / r.w
    cost = np.array([[sum((a - b) ** 2 for a, b in zip(c, o, strict=True)) for _, o in old] for c in centre]).reshape(len(centre), len(old))
    out = {slot: (c, 0.0) for slot, c in old}
    for _ in centre:
        k, s = np.unravel_index(int(cost.argmin()), cost.shape)
        out[old[s][0]] = (centre[k], weights.get(int(k), 0.0))
        cost[k, :], cost[:, s] = np.inf, np.inf
    return book.sparkSession.createDataFrame([(slot, c, n) for slot, (c, n) in sorted(out.items())], f"slot {book.schema['slot'].dataType.simpleString()}, c array<double>, n double")


# -- rescoring of changed regions ----------------------------------------------------------------------


def rescored(kept: DataFrame, deltas: DataFrame, spans: DataFrame, width: int, keys: list[str], by: list[str]) -> DataFrame:
    """(keys, start, by, before, after): the greatest final score of each span, kept and with the changes of `by` made.

    kept: keys, channel, t, raw (sums over windows, before the impulse term); deltas: keys, channel, by, w_start, d (an
    array of changes of that window's scores); spans: keys, start, stop, by. A step's final score is the greatest over
    channels of half of raw and half its centred mean of `width` steps. All changes of a `by` are made at once.

    Only the steps within `width` of a span are read and scored anew; they meet spans in stretches of time.
    """
    own = [*keys, *by, "start"]
    size = max(width, 64)
    bucket = lambda t: F.floor(t / size)
    dealt = spans.select(*own, "stop", F.explode(F.sequence(bucket(F.col("start") - width), bucket(F.col("stop") + width))).alias("__b"))
    near = kept.select(*keys, "channel", "t", "raw", bucket(F.col("t")).alias("__b")).join(dealt, [*keys, "__b"])
    near = near.where((F.col("t") >= F.col("start") - width) & (F.col("t") <= F.col("stop") + width))
    steps = deltas.select(*keys, *by, "channel", F.posexplode("d").alias("k", "d"), "w_start").groupBy(*keys, *by, "channel", (F.col("w_start") + F.col("k")).alias("t")).agg(F.sum("d").alias("d"))
    changed = near.join(steps, [*keys, *by, "channel", "t"], "left").withColumn("new", F.col("raw") + F.coalesce("d", F.lit(0.0)))
    frame = lambda w: w.rowsBetween(-(width // 2), width - width // 2 - 1)
    means = {"__m": lambda w: F.avg("raw").over(frame(w)), "__n": lambda w: F.avg("new").over(frame(w))}
    scored = framed(changed, width // 2, width - width // 2 - 1, means, (*own, "channel")).where(F.col("t").between(F.col("start"), F.col("stop")))
    return scored.groupBy(*own).agg(F.max(0.5 * (F.col("raw") + F.col("__m"))).alias("before"), F.max(0.5 * (F.col("new") + F.col("__n"))).alias("after"))


def touched(spans: DataFrame, deltas: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(keys, start, stop, by): the spans(keys, start, stop) that a changed window overlaps, met in stretches of time."""
    size = 64
    reach = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))).alias("__b")
    end = F.col("w_start") + F.size("d") - 1
    windows = deltas.select(*keys, *by, "w_start", end.alias("w_stop")).distinct()
    met = spans.select(*keys, "start", "stop", reach(F.col("start"), F.col("stop"))).join(windows.select("*", reach(F.col("w_start"), F.col("w_stop"))), [*keys, "__b"])
    return met.where((F.col("w_start") <= F.col("stop")) & (F.col("w_stop") >= F.col("start"))).select(*keys, "start", "stop", *by).distinct()


def region_validity(kept: DataFrame, deltas: DataFrame, events: DataFrame, thresholds: DataFrame, width: int, keys: list[str], by: list[str]) -> DataFrame:
    """(by, validity, spread, n_events): the share of touched events whose peak falls below their key's thr once all changes are made, with its deviation."""
    peaks = rescored(kept, deltas, touched(events, deltas, keys, by), width, keys, by).join(thresholds, keys)
    flag = (F.col("after") < F.col("thr")).cast("double")
    return peaks.groupBy(*by).agg(F.avg(flag).alias("validity"), F.stddev_pop(flag).alias("spread"), F.count("*").alias("n_events"))
