"""Volume under the surface, threshold strategies and the evaluation report of scored series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import quantiles, running_sum, settled, value_sums
from fleetseries.operators import catalog, detect, proximity
from fleetseries.operators.prep import segments

# -- volume under the surface --------------------------------------------------------------------------


def cut_places(points: DataFrame, keys: list[str], cuts: int) -> DataFrame:
    """points with bin: the first of `cuts` evenly spaced places in the falling order of the scores whose score a point reaches."""
    counts = points.groupBy(*keys, "score").agg(F.count("*").alias("__c"))
    size = points.groupBy(*keys).agg((F.count("*") - 1).alias("__last"))
    above = value_sums(counts, keys, "score", {"__seen": F.col("__c")}, falling=True).join(size, keys)
    step = F.col("__last") / F.lit(float(cuts - 1))
    place = lambda k: F.when(k >= cuts - 1, F.col("__last")).otherwise(F.floor(k * step))
    g = F.col("__seen") - F.col("__c")
    guess = F.least(F.greatest(F.ceil(g / step), F.lit(0)), F.lit(cuts - 1))
    near = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: guess + i), lambda k: (k >= 0) & (k < cuts) & (place(k) >= g))
    bins = above.where("__last > 0").select(*keys, "score", F.array_min(near).cast("int").alias("bin"))
    return points.join(bins, [*keys, "score"])


def surface(points: DataFrame, keys: list[str], buffer: int, cuts: int = 250) -> DataFrame:
    """vus_roc and vus_pr by key: the areas under the range-aware ROC and precision-recall curves, averaged over windows 0 to buffer.

    points: keys, t, score, label. For window v a point d <= v // 2 steps from a labelled segment has the soft label
    sqrt(1 - d / v), summed over segments and 1 at most; segments that reach each other are one range, and the share
    of ranges in which anything is found scales the recall. Keys of one class have no row.

    Only points near a segment meet the windows, and as counts by (bin, distances); a key's curves are buffer x cuts rows.
    """
    both = points.groupBy(*keys).agg(F.sum("label").alias("pos"), F.count("*").alias("n")).where("pos > 0 and pos < n")
    placed = settled(cut_places(points.select(*keys, "t", "score", "label").join(both.select(*keys), keys, "left_semi"), keys, cuts))
    spans = settled(segments(placed, keys=keys).select(*keys, "start", "stop"))
    half = buffer // 2
    # steps around each segment, with their distance: at most `buffer` rows a segment
    ring = spans.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(half)))) if half else spans.withColumn("d", F.lit(1)).limit(0)
    sides = ring.select(*keys, "start", "d", F.explode(F.array(F.col("start") - F.col("d"), F.col("stop") + F.col("d"))).alias("t"))
    near = settled(sides.join(placed.select(*keys, "t", "bin", "label"), [*keys, "t"]))

    shares = near.where("label = 0").groupBy(*keys, "t", "bin").agg(F.sort_array(F.collect_list("d")).alias("ds"))  # segments within reach: few
    counted = shares.groupBy(*keys, "bin", "ds").agg(F.count("*").alias("c"))
    by_window = counted.withColumn("v", F.explode(F.sequence(2 * F.col("ds")[0], F.lit(buffer))))
    soft = F.least(F.lit(1.0), F.aggregate(F.filter("ds", lambda d: 2 * d <= F.col("v")), F.lit(0.0), lambda a, d: a + F.sqrt(1 - d / F.col("v"))))
    gained = by_window.where(2 * F.col("ds")[0] <= F.col("v")).groupBy(*keys, "v", "bin").agg(F.sum(F.col("c") * soft).alias("soft"))

    # the lowest bin of each segment with h steps on each side, then of each range of segments that reach each other
    own = segments_lowest(placed, keys).withColumn("d", F.lit(0))
    rings = near.groupBy(*keys, "start", "d").agg(F.min("bin").alias("low"))
    steps = spans.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(half)))).join(own.unionByName(rings), [*keys, "start", "d"], "left")
    grown = steps.withColumn("low", F.min("low").over(W.partitionBy(*keys, "start").orderBy("d")))
    gaps = spans_with_gap(spans, keys).select(*keys, "start", "gap")
    heads = (F.coalesce("gap", F.lit(1 << 40)) > 2 * F.col("d")).cast("long")
    ranged = running_sum(grown.join(gaps, [*keys, "start"]), heads, "range", (*keys, "d"), "start")
    ranges = ranged.groupBy(*keys, "d", "range").agg(F.min("low").alias("bin"))
    met = ranges.groupBy(*keys, "d", "bin").agg(F.count("*").alias("hit"))
    n_ranges = ranges.groupBy(*keys, "d").agg(F.count("*").alias("ranges"))

    plain = placed.groupBy(*keys, "bin").agg(F.sum("label").alias("seg"), F.count("*").alias("pred"))
    grid = both.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(buffer)))).withColumn("d", F.floor(F.col("v") / 2).cast("int"))
    grid = grid.join(n_ranges, [*keys, "d"]).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    cells = grid.join(plain, [*keys, "bin"], "left").join(gained, [*keys, "v", "bin"], "left").join(met, [*keys, "d", "bin"], "left").fillna(0, ["seg", "pred", "hit"]).fillna(0.0, ["soft"])
    line = W.partitionBy(*keys, "v").orderBy("bin")
    run = cells.withColumns({c: F.sum(c).over(line) for c in ("seg", "pred", "soft", "hit")})
    tp, real = F.col("seg") + F.col("soft"), F.col("pos") + F.col("soft") / 2
    curve = run.select(
        *keys, "v", "bin", (F.least(tp / real, F.lit(1.0)) * F.col("hit") / F.col("ranges")).alias("tpr"),
        F.when(F.col("n") > real, (F.col("pred") - tp) / (F.col("n") - real)).otherwise(0.0).alias("fpr"), (tp / F.col("pred")).alias("precision"),
    )
    before = lambda c: F.coalesce(F.lag(c).over(line), F.lit(0.0))
    area = curve.withColumns({
        "roc": (F.col("fpr") - before("fpr")) * (F.col("tpr") + before("tpr")) / 2
        + F.when(F.col("bin") == cuts - 1, (1 - F.col("fpr")) * (1 + F.col("tpr")) / 2).otherwise(0.0),
        "pr": (F.col("tpr") - before("tpr")) * F.col("precision"),
    })
    return area.groupBy(*keys).agg((F.sum("roc") / (buffer + 1)).alias("vus_roc"), (F.sum("pr") / (buffer + 1)).alias("vus_pr"))


def segments_lowest(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, low): the lowest bin on each labelled segment."""
    inside = detect.runs(placed, F.col("label") == 1, tuple(keys))
    return inside.groupBy(*keys, "run_id").agg(F.min("t").alias("start"), F.min("bin").alias("low")).drop("run_id")


def spans_with_gap(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans with gap: the steps from the end of the segment before; null for the first. A key's segments, not its points, are ordered."""
    return spans.withColumn("gap", F.col("start") - F.lag("stop").over(W.partitionBy(*keys).orderBy("start")))


# -- strategies and the report -------------------------------------------------------------------------


def strategies(train: DataFrame, raw: DataFrame, adjusted: DataFrame | None, keys: list[str], q: float = 0.99, level: float = 0.02) -> DataFrame:
    """(keys, variant, strategy, thr): every threshold strategy on raw and on point-adjusted scores (if there are any); those from training scores are the same on both.

    The quantiles of the training scores are found in one pass, and the scores of both variants in one, with the variant as a key.
    """
    sides = {"raw": raw} if adjusted is None else {"raw": raw, "adjusted": adjusted}
    top = settled(quantiles(train, keys, "score", {"thr": q, "u": 1 - level}))
    free = {f"quantile_{q:g}": top, "pot": catalog.pot_threshold(train, keys, level, top=top.select(*keys, "u"))}
    out = None
    for name, thr in free.items():
        part = thr.select(*keys, F.explode(F.array(*map(F.lit, sides))).alias("variant"), F.lit(name).alias("strategy"), "thr")
        out = part if out is None else out.unionByName(part)
    both = None
    for variant, scores in sides.items():
        own = scores.select(*keys, F.lit(variant).alias("variant"), "label", "score")
        both = own if both is None else both.unionByName(own)
    own = [*keys, "variant"]
    for name, thr in {"best_f1_search": detect.grid_threshold(both, own), "anomaly_ratio": detect.ratio_threshold(both, own)}.items():
        out = out.unionByName(thr.select(*own, F.lit(name).alias("strategy"), "thr"))
    return out


def report(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """The nested report as a long table: keys, variant, strategy, metric, value; the strategy of threshold-free metrics is 'free'.

    scores: keys, variant, score, label. A key's thresholds are few, so they go with its points as one array and points are not multiplied.
    """
    own = [*keys, "variant"]
    lists = thresholds.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("strategy", "thr"))).alias("__t"))
    passed = F.transform("__t", lambda e: (F.col("score") > e["thr"]).cast("int"))
    counts = scores.join(lists, own).withColumn("__p", passed).groupBy(*own, "__t", "__p").agg(F.count("*").alias("n"), F.sum("label").alias("y"))  # 2 ** strategies rows at most
    each = counts.select(*own, F.posexplode("__t").alias("k", "e"), "__p", "n", "y").withColumn("on", F.get("__p", F.col("k")))
    sums = each.groupBy(*own, F.col("e.strategy").alias("strategy"), F.col("e.thr").alias("threshold")).agg(
        F.sum(F.col("on") * F.col("y")).alias("tp"), F.sum(F.col("on") * F.col("n")).alias("pred"), F.sum("y").alias("pos")
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rates = {"threshold": F.col("threshold"), "precision": share(F.col("tp"), F.col("pred")), "recall": share(F.col("tp"), F.col("pos")), "f1": share(2 * F.col("tp"), F.col("pred") + F.col("pos"))}
    free = detect.auroc(scores, own).join(detect.auprc(scores, own), own).withColumn("strategy", F.lit("free"))
    long = lambda df, made: df.select(*own, "strategy", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in made.items()))).alias("m"))
    both = long(sums, rates).unionByName(long(free, {c: F.col(c) for c in ("auroc", "auprc", "best_f1")}))
    return both.select(*own, "strategy", "m.metric", "m.value")


def suite(points: DataFrame, thresholds: DataFrame, keys: list[str], buffer: int, cuts: int = 250) -> DataFrame:
    """(keys, strategy, metric, value): what the report leaves out, as more rows of it.

    Free of a threshold: volumes under both surfaces and the proximity-aware area. For each strategy's threshold: event
    precision, recall and F1, mean delay and segments found, affiliation precision, recall and F1, proximity-aware F1.
    points: the series keys, t, label, score; thresholds: keys, strategy, thr. The flags of all strategies are one table
    with the strategy as a key, so each metric is one plan, however many strategies there are. What hangs on the labels
    alone, the true segments, is found once from the points; delays come from the labelled points.
    """
    by = [*keys, "strategy"]
    points = settled(points)
    flags = settled(points.join(thresholds.select(*by, F.col("thr").alias("__thr")), keys).withColumn("pred", (F.col("score") > F.col("__thr")).cast("int")))
    spans = settled(segments(points, keys=keys).select(*keys, "start", "stop", "length"))
    truth, found = settled(spans.join(thresholds.select(*by), keys)), settled(segments(flags, F.col("pred") == 1, by))
    half_open = lambda df: df.select(*by, "start", (F.col("stop") + 1).alias("stop"))
    inside = proximity.points_inside(points.withColumn("bin", F.col("score")), spans, keys).join(thresholds.select(*by, F.col("thr").alias("__thr")), keys)
    hits = inside.groupBy(*by, "start", "length").agg(F.min(F.when(F.col("bin") > F.col("__thr"), F.col("u"))).alias("hit"))
    delay = hits.groupBy(*by).agg(F.avg(F.coalesce("hit", "length")).alias("mean_delay"), F.sum(F.col("hit").isNotNull().cast("int")).alias("segments_found"))
    lengths = flags.groupBy(*by).agg(F.count("*").alias("n"))
    long = lambda df, own, made: df.select(*own, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in made.items()))).alias("m")).select(*own, "m.metric", "m.value")  # noqa: E731, E501
    free = surface(points, keys, buffer, cuts).join(proximity.pate(points, keys, buffer, buffer, cuts, spans), keys, "full").withColumn("strategy", F.lit("free"))
    three = lambda p: {f"{p}_{c}": c for c in ("precision", "recall", "f1")}
    parts = [
        long(free, by, {c: c for c in ("vus_roc", "vus_pr", "pate")}), long(detect.event_overlap(truth, found, by), by, three("event")),
        long(delay, by, {c: c for c in ("mean_delay", "segments_found")}), long(catalog.affiliation(half_open(truth), half_open(found), lengths, by), by, three("affiliation")),
        long(proximity.pate_f1(flags, by, buffer, buffer, spans=truth), by, {"pate_f1": "pate_f1"}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("value IS NOT NULL")
