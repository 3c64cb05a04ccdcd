"""Proximity-aware evaluation (PATE): precision and recall with credit near an event, averaged over pairs of buffers.

Every point of a key lies in one zone: a labelled segment, the zone before it (at most `early` steps, never into the
zone after the segment before), the zone after it (at most `late` steps, never into the next segment), or outside. A
predicted point counts 1 in a segment; in a zone it counts 1 - D(x) / D(end), where D(x) is the sum of its distances to
all points of the segment and D(end) that of the zone's far end; before a segment it counts only if the segment itself
is found; else it is a false alarm. A segment not found is missed with its whole length; of one that is found, each
missed point counts 1 up to as many steps from its start as the first found run is long, and less the later it is.

All cuts are handled at once: a point has the number of the first cut that its score reaches, sums over (cut, distance)
need one pass, and running sums over a key's cuts give the curve. Distances have closed sums, so no zone is walked.
Only a segment's points meet its own cuts, as many as the segment has different ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import framed, let, settled, value_sums
from fleetseries.operators.prep import segments

#: Elements of a list of cuts that are compared before the search goes on in one stretch between them.
STRETCH = 16


def kept_scores(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, score, m): the distinct scores, rising, without those whose number of hits equals both neighbours'; m is how many stay.

    A score stays if it is a key's highest or lowest, if a label stands at it, or at the next lower score.
    """
    counts = points.where("score IS NOT NULL").groupBy(*keys, "score").agg(F.max("label").alias("hit"))
    ranked = value_sums(counts, keys, "score", {"t": F.lit(1)})
    both = framed(ranked, 1, 1, {"lower": lambda w: F.lag("hit").over(w), "higher": lambda w: F.lead("hit").over(w)}, tuple(keys), "t")
    stay = both.where(F.col("lower").isNull() | F.col("higher").isNull() | (F.col("hit") > 0) | (F.col("lower") > 0))
    placed = value_sums(stay.select(*keys, "score"), keys, "score", {"place": F.lit(1)})
    return placed.join(placed.groupBy(*keys).agg(F.count("*").alias("m")), keys)


def cut_scores(points: DataFrame, keys: list[str], cuts: int) -> DataFrame:
    """(keys, thr): an array of `cuts` falling thresholds, evenly spaced percentiles of the kept scores (linear between two).

    A percentile that falls on a score, but for rounding, is that score.
    """
    kept = settled(kept_scores(points, keys))
    grid = kept.where("place = 1").select(*keys, "m", F.posexplode(F.array(*(F.lit(float(q)) for q in np.linspace(100, 0, cuts) / 100))).alias("k", "q"))
    at = (F.col("m") - 1) * F.col("q")
    at = F.when(F.abs(at - F.round(at)) < 1e-9, F.round(at)).otherwise(at)
    ends = F.array(F.struct(F.floor(at).alias("p"), (1 - (at - F.floor(at))).alias("w")), F.struct(F.ceil(at).alias("p"), (at - F.floor(at)).alias("w")))
    needed = grid.select(*keys, "k", F.explode(F.array_distinct(ends)).alias("e")).where("e.w > 0").select(*keys, "k", (F.col("e.p") + 1).alias("place"), "e.w")
    found = needed.join(kept.select(*keys, "place", "score"), [*keys, "place"])
    one = found.groupBy(*keys, "k").agg(F.when(F.count("*") == 1, F.max("score")).otherwise(F.sum(F.col("w") * F.col("score"))).alias("thr"))
    lists = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "thr"))).alias("l"))
    return lists.select(*keys, F.transform("l", lambda e: e["thr"]).alias("thr"))


def first_reached(thr: Column, score: Column, cuts: int) -> Column:
    """The number of the first of the falling thresholds that score reaches; `cuts` if none or the score is null."""
    above = lambda part: F.size(F.filter(part, lambda x: x > score))
    heads = F.sequence(F.lit(0), F.floor((F.size(thr) - 1) / STRETCH).cast("int"))
    rough = F.size(F.filter(heads, lambda j: F.get(thr, j * STRETCH) > score))
    fine = lambda r: F.when(r == 0, F.lit(0)).otherwise((r - 1) * STRETCH + 1 + above(F.slice(thr, (r - 1) * STRETCH + 2, F.lit(STRETCH - 1))))
    return F.coalesce(F.when(score.isNotNull(), let(rough, fine)), F.lit(cuts)).cast("int")


def distances(length: Column, gap: Column) -> Column:
    """The sum of the distances from a point `gap` steps outside a segment to all points of it."""
    return length * gap + length * (length - 1) / 2


def proximity(placed: DataFrame, keys: list[str], early: int, late: int, cuts: int, spans: DataFrame | None = None) -> DataFrame:
    """(keys, e, d, bin, tp, predicted, missed) for the buffers e of {0, early}, d of {0, late} and every cut.

    placed: keys, t (dense), bin, label. spans: the labelled segments (keys, start, stop, length), if they are known.
    """
    placed = settled(placed.select(*keys, "t", "bin", "label"))
    spans = (segments(placed, keys=keys) if spans is None else spans).select(*keys, "start", "stop", "length")
    reach = placed.groupBy(*keys).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    order = W.partitionBy(*keys).orderBy("start")  # a key's segments, not its points
    spans = settled(spans.join(reach, keys).withColumns({"before": F.lag("stop").over(order), "after": F.lead("start").over(order)}))
    inside = settled(points_inside(placed, spans, keys))
    lowest = settled(inside.groupBy(*keys, "start", "length", "bin").agg(F.min("u").alias("u")))
    found = lowest.groupBy(*keys, "start").agg(F.min("bin").alias("found"))

    pairs = F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.lit(d).alias("d")) for e in sorted({0, early}) for d in sorted({0, late})))).alias("pair")
    ends = spans.select("*", pairs).select("*", "pair.e", "pair.d")
    earlier_end = F.when(F.col("before").isNull(), F.col("first") - 1).otherwise(F.least(F.col("before") + F.col("d"), F.col("start") - 1))
    zones = ends.select(
        *keys, "e", "d", "start", "stop", "length", (F.col("start") - F.greatest(F.col("first"), F.col("start") - F.col("e"), earlier_end + 1)).cast("long").alias("pre"),
        (F.least(F.col("stop") + F.col("d"), F.coalesce(F.col("after") - 1, F.col("last"))) - F.col("stop")).cast("long").alias("post"),
    )
    side = lambda wide, edge, sign, name: zones.where(F.col(wide) > 0).select(*keys, "e", "d", "start", "length", F.lit(name).alias("side"), F.col(wide).alias("wide"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(wide))).alias("gap"), F.col(edge).alias("edge"), F.lit(sign).alias("sign"))  # noqa: E731, E501
    steps = side("pre", "start", -1, "pre").unionByName(side("post", "stop", 1, "post")).withColumn("t", F.col("edge") + F.col("sign") * F.col("gap"))
    near = steps.join(placed.select(*keys, "t", "bin"), [*keys, "t"]).where(F.col("bin") < cuts).join(found, [*keys, "start"])
    weight = 1 - distances(F.col("length"), F.col("gap")) / distances(F.col("length"), F.col("wide"))
    counts_from = F.when(F.col("side") == "pre", F.greatest("bin", "found")).otherwise(F.col("bin"))
    gained = near.where("wide > gap").select(*keys, "e", "d", counts_from.alias("bin"), weight.alias("w")).groupBy(*keys, "e", "d", "bin").agg(F.sum("w").alias("zone"))

    plain = placed.groupBy(*keys, "bin").agg(F.sum("label").alias("hits"), F.count("*").alias("predicted"))
    missed = missed_weight(inside, lowest, keys, cuts)
    whole = spans.groupBy(*keys).agg(F.sum("length").alias("all"))
    grid = reach.select(*keys, pairs).select(*keys, "pair.e", "pair.d", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("bin"))
    cells = grid.join(plain, [*keys, "bin"], "left").join(missed, [*keys, "bin"], "left").join(gained, [*keys, "e", "d", "bin"], "left").join(whole, keys, "left")
    line = W.partitionBy(*keys, "e", "d").orderBy("bin")
    total = lambda c: F.coalesce(F.sum(c).over(line), F.lit(0))
    return cells.select(
        *keys, "e", "d", "bin", (total("hits") + total("zone")).alias("tp"), total("predicted").alias("predicted"), (F.coalesce("all", F.lit(0)) + total("change")).alias("missed")
    )


def points_inside(placed: DataFrame, spans: DataFrame, keys: list[str], step: int = 1024) -> DataFrame:
    """(keys, start, length, u, bin): each labelled point with its segment and its place there. Both meet in stretches of `step` steps."""
    dealt = spans.select(*keys, "start", "stop", "length", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("stop") / step))).alias("__b"))
    points = placed.where("label = 1").select(*keys, "t", "bin", F.floor(F.col("t") / step).alias("__b"))
    return points.join(dealt, [*keys, "__b"]).where(F.col("t").between(F.col("start"), F.col("stop"))).select(*keys, "start", "length", (F.col("t") - F.col("start")).alias("u"), "bin")


def missed_weight(inside: DataFrame, lowest: DataFrame, keys: list[str], cuts: int) -> DataFrame:
    """(keys, bin, change): how the missed weight of all segments changes at a cut, from all points being missed."""
    own = [*keys, "start"]
    falls = W.partitionBy(*own).orderBy("bin")  # as many rows as a segment has different cuts
    known = lowest.where(F.col("bin") < cuts).select(*own, "length", F.col("bin").alias("k"), F.min("u").over(falls).alias("head"))
    beyond = known.join(inside.select(*own, "u", "bin"), own).where((F.col("bin") > F.col("k")) & (F.col("u") > F.col("head")))
    stops = beyond.groupBy(*own, "k").agg(F.min("u").alias("tail"))
    runs = settled(known.join(stops, [*own, "k"], "left").withColumn("run", F.coalesce("tail", "length") - F.col("head")))
    lost = runs.join(inside.select(*own, "u", "bin"), own).where(F.col("bin") > F.col("k"))
    far = (F.col("u") > F.col("run")).cast("long")
    sums = lost.groupBy(*own, "k").agg(F.count("*").alias("n"), F.sum(far).alias("far"), F.sum(far * F.col("u")).alias("far_u"))
    at = runs.join(sums, [*own, "k"], "left").fillna(0, ["n", "far", "far_u"])
    less = ((F.col("run") + 1) * F.col("far_u") - F.col("far") * F.col("run") * (F.col("run") + 1) / 2) / (F.col("length") * (F.col("length") - 1) / 2)
    worth = at.withColumn("worth", F.col("n") - F.when(F.col("far") > 0, less).otherwise(0.0))
    earlier = F.coalesce(F.lag("worth").over(W.partitionBy(*own).orderBy("k")), F.col("length").cast("double"))
    return worth.withColumn("change", F.col("worth") - earlier).groupBy(*keys, F.col("k").alias("bin")).agg(F.sum("change").alias("change"))


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pate(points: DataFrame, keys: list[str], early: int, late: int, cuts: int = 250, spans: DataFrame | None = None) -> DataFrame:
    """(keys, pate): the area under the proximity-aware precision-recall curve, averaged over the pairs of {0, early} and {0, late}.

    points: keys, t (dense), score, label. A point is predicted where its score reaches the threshold. The curve starts
    at recall 0 and precision 1 and leaves out points whose recall (to twelve places) is below that of an earlier one. A key without
    labelled points has the value 0; points with a null score are never predicted.
    """
    points = points.select(*keys, "t", "score", "label")
    lists = cut_scores(points, keys, cuts)
    placed = points.join(lists, keys).select(*keys, "t", "label", first_reached(F.col("thr"), F.col("score"), cuts).alias("bin"))
    curve = proximity(placed, keys, early, late, cuts, spans).select(
        *keys, "e", "d", "bin", share(F.col("tp"), F.col("predicted")).alias("precision"), F.round(share(F.col("tp"), F.col("tp") + F.col("missed")), 12).alias("recall")
    )
    line = W.partitionBy(*keys, "e", "d").orderBy("bin")
    rising = curve.withColumn("most", F.max("recall").over(line.rowsBetween(W.unboundedPreceding, -1))).where("most IS NULL OR recall >= most")
    before = lambda c, v: F.coalesce(F.lag(c).over(line), F.lit(v))
    area = (F.col("recall") - before("recall", 0.0)) * (F.col("precision") + before("precision", 1.0)) / 2
    each = rising.withColumn("area", area).groupBy(*keys, "e", "d").agg(F.sum("area").alias("area"))
    return averaged(each, keys, "area", "pate", early, late)


def averaged(each: DataFrame, keys: list[str], value: str, name: str, early: int, late: int) -> DataFrame:
    """The mean over four pairs; where a buffer is 0, a pair stands for two."""
    times = F.when(F.lit(early == 0), 2).otherwise(1) * F.when(F.lit(late == 0), 2).otherwise(1)
    return each.groupBy(*keys).agg((F.sum(F.col(value) * times) / 4).alias(name))


def pate_f1(points: DataFrame, keys: list[str], early: int, late: int, flag: str = "pred", spans: DataFrame | None = None) -> DataFrame:
    """(keys, pate_f1): the proximity-aware F1 of the flags (1: predicted), averaged over the same pairs of buffers."""
    placed = points.select(*keys, "t", "label", (F.coalesce(F.col(flag), F.lit(0)) == 0).cast("int").alias("bin"))
    one = proximity(placed, keys, early, late, 1, spans)
    precision, recall = share(F.col("tp"), F.col("predicted")), share(F.col("tp"), F.col("tp") + F.col("missed"))
    return averaged(one.withColumn("f1", share(2 * precision * recall, precision + recall)), keys, "f1", "pate_f1", early, late)
