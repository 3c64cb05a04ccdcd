"""Selection, labels, cleaning, splits, scaling and windows of series tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import CHUNK, SERIES_KEYS, bankers, framed, let, running_sum, settled, value_sums

KEYS = list(SERIES_KEYS)
SCALE_FLOOR, WINDOW_FLOOR = 1e-4, 1e-4


# -- labels and segments -------------------------------------------------------------------------------


def segment_pieces(series: DataFrame, flag: Column, keys: list[str], alone: Column | None = None) -> DataFrame:
    """What join_pieces makes segments of, settled: a row a run within a chunk of the time axis, and one for what lies between a chunk's runs.

    Points where `alone` holds are rows of their own, with their step as __alone: one reading of series finds both.
    """
    mark = F.coalesce(flag, F.lit(False))
    own = [] if alone is None else ["__alone"]
    chunk = W.partitionBy(*keys, "__chunk").orderBy("t")
    rows = series.select(*keys, "t", mark.alias("__f"), F.floor(F.col("t") / CHUNK).alias("__chunk"), *(F.when(alone, F.col("t")).alias(n) for n in own))
    near = rows.withColumns({"__p": F.lag("__f").over(chunk), "__last": F.lead("__f").over(chunk).isNull()})
    begins = F.col("__f") & ~F.coalesce("__p", F.lit(False))
    told = near.withColumn("__run", F.when(F.col("__f"), F.sum(begins.cast("long")).over(chunk.rowsBetween(W.unboundedPreceding, 0))))
    return settled(told.groupBy(*keys, "__chunk", "__run", *own).agg(
        F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("length"),
        F.max(F.col("__p").isNull()).alias("__first"), F.max("__last").alias("__last"),
    ))


def join_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """segments of segment_pieces without `alone`. Only the first and last run of a chunk can go on elsewhere.

    On disk the pieces are many times smaller than in memory, so Spark would take them for a table to broadcast: the hint forbids it.
    """
    line = W.partitionBy(*keys).orderBy("__chunk")
    ends = pieces.groupBy(*keys, "__chunk").agg(F.max(F.col("__run").isNotNull() & F.col("__last")).alias("__open"))
    left = ends.select(*keys, "__chunk", F.coalesce(F.lag("__open").over(line), F.lit(False)).alias("__open"))
    flagged = pieces.where("__run IS NOT NULL").join(left.hint("shuffle_hash"), [*keys, "__chunk"]).withColumn("t", F.col("start"))
    found = running_sum(flagged, (~(F.col("__first") & F.col("__open"))).cast("long"), "run_id", tuple(keys))
    return found.groupBy(*keys, "run_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("length").alias("length"))


def segments(series: DataFrame, flag: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Maximal runs of labelled points: start, stop (inclusive) and length."""
    keys = keys or KEYS
    return join_pieces(segment_pieces(series, F.col("label") == 1 if flag is None else flag, keys), keys)


def labels_from_segments(series: DataFrame, spans: DataFrame, keys: list[str] | None = None, step: int = 1024) -> DataFrame:
    """series with label 1 inside any span (inclusive). Spans meet points by buckets of `step` steps: of those that begin at one step of a bucket the longest counts, so a bucket's list holds `step` spans at most."""
    keys = keys or KEYS
    dealt = spans.select(*keys, "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("stop") / step))).alias("__b"))
    longest = dealt.groupBy(*keys, "__b", F.greatest("start", F.col("__b") * step).alias("__from")).agg(F.max("stop").alias("__to"))
    lists = longest.groupBy(*keys, "__b").agg(F.collect_list(F.struct("__from", "__to")).alias("__s"))
    points = series.drop("label").withColumn("__b", F.floor(F.col("t") / step)).join(lists, [*keys, "__b"], "left")
    inside = F.exists("__s", lambda s: F.col("t").between(s["__from"], s["__to"]))
    return points.withColumn("label", F.coalesce(inside.cast("int"), F.lit(0))).drop("__b", "__s")


def collapse_channels(series: DataFrame) -> DataFrame:
    """Point labels: 1 where any channel's label is positive."""
    return series.groupBy("entity", "t").agg(F.max((F.col("channel_label") > 0).cast("int")).alias("label"))


def relative_segments(spans: DataFrame, offset: Column, length: Column) -> DataFrame:
    """Absolute inclusive spans in a split's own steps, clipped to it; spans outside go."""
    low, high = F.greatest(F.col("start") - offset, F.lit(0)), F.least(F.col("stop") - offset, length - 1)
    return spans.withColumns({"rel_start": low, "rel_stop": high}).where("rel_start <= rel_stop")


def align_tail(scores: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Each score with the label that stands as far from the end: the last labels count. More scores than labels is an error."""
    n_scores = scores.groupBy(*keys).agg(F.count("*").alias("__ns"))
    n_labels = labels.groupBy(*keys).agg(F.count("*").alias("__nl"))
    shift = n_scores.join(n_labels, keys, "left").select(
        *keys,
        F.when(F.col("__ns") > F.coalesce("__nl", F.lit(0)), F.raise_error(F.lit("more scores than labels")).cast("long")).otherwise(F.col("__nl") - F.col("__ns")).alias("__d"),
    )
    placed = scores.join(shift, keys).withColumn("__t", F.col("t") + F.col("__d"))
    return placed.join(labels.withColumnRenamed("t", "__t").select(*keys, "__t", "label"), [*keys, "__t"]).drop("__t", "__d")


# -- cleaning and splits -------------------------------------------------------------------------------


def mask_straight(series: DataFrame, least: int = 32, tolerance: float = 1e-9, keys: list[str] | None = None) -> DataFrame:
    """Values of imputed straight lines become null: runs of `least` points or more with one constant first difference."""
    keys = keys or KEYS
    stepped = framed(series, 2, 0, {"__a": lambda w: F.lag("value", 1).over(w), "__b": lambda w: F.lag("value", 2).over(w)}, tuple(keys))
    bend = F.abs(F.col("value") - 2 * F.col("__a") + F.col("__b"))
    spans = segments(stepped, bend <= tolerance, keys).withColumn("start", F.col("start") - 2)
    marked = labels_from_segments(series.withColumnRenamed("label", "__label"), spans.where(F.col("stop") - F.col("start") + 1 >= least), keys)
    return marked.withColumn("value", F.when(F.col("label") == 0, F.col("value"))).drop("label").withColumnRenamed("__label", "label")


def split_tail(series: DataFrame, share: float, least_val: int, least_train: int) -> DataFrame:
    """Training points of each entity with `part`: the last share of them is validation, if both parts can be long enough."""
    n = series.groupBy(*KEYS).agg(F.count("*").alias("__n"))
    wanted = F.greatest(F.lit(least_val), bankers(F.col("__n") * share))
    most = F.col("__n") - F.greatest(F.lit(1), F.lit(least_train))
    val = F.when((most >= least_val) & (most > 0), F.least(wanted, most)).otherwise(F.lit(0))
    return series.join(n.withColumn("__v", val), KEYS).withColumn("part", F.when(F.col("t") >= F.col("__n") - F.col("__v"), "val").otherwise("train")).drop("__n", "__v")


def fill_empty_val(series: DataFrame) -> DataFrame:
    """Entities without validation points get a copy of their training points as such."""
    has = series.where("split = 'val'").select("entity").distinct()
    copied = series.where("split = 'train'").join(has, "entity", "left_anti").withColumn("split", F.lit("val"))
    return series.unionByName(copied)


def shards(series: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Points with the shard they fall into: contiguous cuts at T * cumulated weight // total, in integers."""
    total, reached, bounds = sum(weights), 0, []
    for k, w in enumerate(weights):
        bounds.append((k, reached, reached + w))
        reached += w
    n = series.groupBy(*KEYS).agg(F.count("*").alias("__n"))
    at = lambda c: F.expr(f"(__n * {c}) div {total}")
    shard = F.coalesce(*(F.when((F.col("t") >= at(low)) & (F.col("t") < at(high)), F.lit(k)) for k, low, high in bounds))
    return series.join(n, KEYS).withColumn("shard", shard).drop("__n")


def reveal_events(series: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """Points after the end of each entity's k-th event; entities with fewer than k + 1 events go."""
    ranked = spans.withColumn("r", F.row_number().over(W.partitionBy(*KEYS).orderBy("start")))
    ends = ranked.groupBy(*KEYS).agg(F.max(F.when(F.col("r") <= k, F.col("stop"))).alias("__end"), F.count("*").alias("__c")).where(F.col("__c") > k)
    return series.join(ends, KEYS).where(F.col("t") > F.col("__end")).drop("__end", "__c")


def eligibility(series: DataFrame, least: dict[str, int]) -> DataFrame:
    """(entity, reason): the first split that is shorter than it must be, or eligible."""
    sizes = series.groupBy("entity").agg(*(F.count_if(F.col("split") == part).alias(part) for part in least))
    reason = F.coalesce(*(F.when(F.col(part) < n, F.lit(f"short_{part}")) for part, n in least.items()), F.lit("eligible"))
    return sizes.select("entity", reason.alias("reason"))


def capped(series: DataFrame, entities: int, steps: int) -> DataFrame:
    """The first steps of the first entities, by name. Names are ranked on their own, not with their points."""
    first = series.select("entity").distinct().orderBy("entity").limit(entities)
    return series.where(F.col("t") < steps).join(first, "entity", "left_semi")


# -- scaling -------------------------------------------------------------------------------------------


def scale_stats(series: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and standard deviation (population, floored) of the training points, from additive central moments."""
    sums = series.where("split = 'train'").groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("__sd"))
    return sums.select(*keys, "n", "mu", F.greatest("__sd", F.lit(SCALE_FLOOR)).alias("sd"))


def scale(series: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """series with x, its scaled value. An entity without statistics is an error."""
    known = series.join(stats.select(*keys, "mu", "sd"), keys, "left")
    return known.withColumn("x", F.when(F.col("mu").isNull(), F.raise_error(F.lit("no scaling statistics")).cast("double")).otherwise((F.col("value") - F.col("mu")) / F.col("sd"))).drop("mu", "sd")


def standardise_window(w: Column, floor: float = WINDOW_FLOOR) -> Column:
    """The window minus its mean, over its sample standard deviation (floored)."""
    n = F.size(w)
    mean = F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / n
    spread = lambda m: F.aggregate(w, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    own = let(mean, lambda m: F.struct(m.alias("m"), F.greatest(F.sqrt(spread(m) / (n - 1)), F.lit(floor)).alias("sd")))
    return let(own, lambda s: F.transform(w, lambda x: (x - s["m"]) / s["sd"]))


def minmax_window(w: Column, floor: float = 1e-6) -> Column:
    ends = F.struct(F.array_min(w).alias("low"), F.greatest(F.array_max(w) - F.array_min(w), F.lit(floor)).alias("span"))
    return let(ends, lambda s: F.transform(w, lambda x: (x - s["low"]) / s["span"]))


def trend(series: DataFrame, keys: list[str]) -> DataFrame:
    """Slope __m and intercept __c of each series' linear trend; null for a single point."""
    return series.groupBy(*keys).agg(F.regr_slope("value", "t").alias("__m"), F.regr_intercept("value", "t").alias("__c"))


def detrend(series: DataFrame, keys: list[str]) -> DataFrame:
    """series with d: the value minus its linear trend, over its population standard deviation (plus 1e-9).

    The trend comes along with the residuals' mean and deviation, so series is read three times and the points meet one table.
    """
    left = F.col("value") - F.col("__m") * F.col("t") - F.col("__c")
    flat = series.join(trend(series, keys), keys).withColumn("__r", left)
    fit = flat.groupBy(*keys).agg(F.first("__m").alias("__m"), F.first("__c").alias("__c"), F.avg("__r").alias("__a"), F.stddev_pop("__r").alias("__s"))
    return series.join(fit, keys).withColumn("d", (left - F.col("__a")) / (F.col("__s") + 1e-9)).drop("__m", "__c", "__a", "__s")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the average rank of value by key: ties share the mean of their places. Values are counted before they are ranked."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranks = value_sums(counts, keys, value, {"__upto": F.col("__n")}).select(*keys, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, [*keys, value])


# -- windows -------------------------------------------------------------------------------------------


def sliding_windows(series: DataFrame, width: int, stride: int, value: str = "value") -> DataFrame:
    """w_start, w_stop and w of every full window whose start is a multiple of stride; shorter series have none."""
    made = framed(series, 0, width - 1, {"w": lambda w: F.collect_list(value).over(w.rowsBetween(0, width - 1))})
    return made.where((F.col("t") % stride == 0) & (F.size("w") == width)).select("entity", "cluster", "split", "channel", F.col("t").alias("w_start"), (F.col("t") + width).alias("w_stop"), "w")


def richness(windows: DataFrame) -> DataFrame:
    """windows with richness: their sample deviation plus three times the share of places where the step's sign flips."""
    n = F.size("w")
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / n
    sd = let(mean, lambda m: F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (n - 1)))
    at = lambda k: F.get("w", k)
    flips = F.size(F.filter(F.sequence(F.lit(1), n - 2), lambda k: F.signum(at(k) - at(k - 1)) != F.signum(at(k + 1) - at(k))))
    return windows.withColumn("richness", sd + 3 * flips / (n - 2))


def label_density(series: DataFrame, width: int, context: float = 0.1) -> DataFrame:
    """Labelled points of each full tumbling window, their share, and whether enough normal points are left for context."""
    each = series.groupBy(*KEYS, (F.col("t") - F.col("t") % width).alias("w_start")).agg(F.count("*").alias("__n"), F.sum("label").alias("n_pos"))
    share = F.col("n_pos") / F.col("__n")
    return each.where(F.col("__n") == width).withColumns({"density": share, "has_context": (share <= 1 - context).cast("int")}).drop("__n")


def n_windows(length: Column, width: int, stride: int) -> Column:
    return F.when(length < width, F.lit(0)).otherwise(F.floor((length - width) / stride) + 1).cast("long")


def eval_stride(width: int) -> int:
    """A tenth of the window, half to even, one at least."""
    return max(1, round(0.1 * width))


def centred_average(series: DataFrame, width: int, name: str, value: str = "value") -> DataFrame:
    """series with the mean over width // 2 points before and width // 2 - 1 after, clipped at the edges; widths up to 1 change nothing."""
    if width <= 1:
        return series.withColumn(name, F.col(value))
    half = width // 2
    return framed(series, half, half - 1, {name: lambda w: F.avg(value).over(w.rowsBetween(-half, half - 1))})


def causal_average(series: DataFrame, width: int, name: str, value: str = "value") -> DataFrame:
    """series with the mean of the width points before; the first point stands for itself."""
    return framed(series, width, 0, {name: lambda w: F.coalesce(F.avg(value).over(w.rowsBetween(-width, -1)), F.col(value))})


def acf_at(series: DataFrame, lag: int, value: str, keys: list[str]) -> DataFrame:
    """Autocorrelation at one lag: sum of x(t) x(t + lag) over sum of x squared; null where the series is too short."""
    ahead = framed(series, 0, lag, {"__y": lambda w: F.lead(value, lag).over(w)}, tuple(keys))
    top = F.sum(F.col(value) * F.col("__y"))
    return ahead.groupBy(*keys).agg(F.try_divide(top, F.sum(F.col(value) * F.col(value))).alias("acf"))


def detrended_acf_at(series: DataFrame, lag: int, keys: list[str]) -> DataFrame:
    """acf_at of what detrend leaves of the value; null where the series is too short or nothing is left.

    The deviation that detrend divides by cancels, and the residuals' mean is taken out of the sums: series is read
    twice, once for the trend, and sorted once, with the point `lag` ahead found before the trend is joined.
    """
    ahead = {"__v": lambda w: F.lead("value", lag).over(w), "__u": lambda w: F.lead("t", lag).over(w)}
    both = framed(series, 0, lag, ahead, tuple(keys)).join(trend(series, keys), keys)
    left = lambda v, t: F.col(v) - F.col("__m") * F.col(t) - F.col("__c")
    pairs = both.select(*keys, left("value", "t").alias("__r"), left("__v", "__u").alias("__y"))
    r, y = F.col("__r"), F.col("__y")
    sums = pairs.groupBy(*keys).agg(
        F.avg(r).alias("__a"), F.count(r).alias("__n"), F.sum(r * r).alias("__rr"), F.count(r * y).alias("__k"), F.sum(r * y).alias("__ry"), F.sum(F.when((r * y).isNotNull(), r + y)).alias("__q"),
    )
    a = F.col("__a")
    return sums.select(*keys, F.try_divide(F.col("__ry") - a * F.col("__q") + F.col("__k") * a * a, F.col("__rr") - F.col("__n") * a * a).alias("acf"))


def envelope(series: DataFrame, buckets: int, keys: list[str]) -> DataFrame:
    """Minimum, maximum and mean of each of `buckets` equal parts of a series."""
    n = series.groupBy(*keys).agg(F.count("*").alias("__n"))
    part = F.expr(f"cast((t * {buckets}) div __n as int)")
    return series.join(n, keys).groupBy(*keys, part.alias("bucket")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def hour_profile(series: DataFrame) -> DataFrame:
    """The average day of each entity: mean of log(1 + value - least value) by hour."""
    least = series.groupBy("entity").agg(F.min("value").alias("__m"))
    return series.join(least, "entity").groupBy("entity", F.hour("ts").alias("hour")).agg(F.avg(F.log1p(F.col("value") - F.col("__m"))).alias("level"))
