"""Descriptors of series, near-duplicates among them, clusters of vectors and spectra of windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import CHUNK, carried, correlation, framed, settled
from fleetseries.operators.models import assign, square_distance


def total(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


# -- daily profiles ------------------------------------------------------------------------------------


def standardised(rows: DataFrame, value: str) -> DataFrame:
    """(entity, hour, z): value minus the entity's mean, over its population deviation plus 1e-9. An entity has a row an hour."""
    w = W.partitionBy("entity")
    return rows.select("entity", "hour", ((F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-9)).alias("z"))


def day_profiles(levels: DataFrame, bins: int = 24) -> DataFrame:
    """(entity, hour, z) from (entity, hour, level): empty hours are interpolated around the clock, then the profile is standardised.

    With fewer than two filled hours the profile is 0 throughout.
    """
    n = levels.groupBy("entity").agg(F.count("*").alias("filled"))
    grid = n.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    met = grid.join(levels, ["entity", "hour"], "left")
    turns = met.withColumn("turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("h", F.col("hour") + bins * F.col("turn"))
    w = W.partitionBy("entity").orderBy("h")  # three times the hours
    known = F.when(F.col("level").isNotNull(), F.struct("h", "level"))
    both = turns.withColumn("k", known).withColumns({"p": F.last("k", True).over(w), "q": F.first("k", True).over(w.rowsBetween(0, W.unboundedFollowing))})
    p, q = F.col("p"), F.col("q")
    line = p["level"] + (q["level"] - p["level"]) * F.try_divide(F.col("h") - p["h"], q["h"] - p["h"])
    return standardised(both.where("turn = 0").withColumn("x", F.when(F.col("filled") < 2, 0.0).otherwise(F.coalesce("level", line))), "x")


def deviation_profiles(profiles: DataFrame) -> DataFrame:
    """Each profile minus the mean profile of all, standardised again."""
    mean = profiles.groupBy("hour").agg(F.avg("z").alias("m"))
    return standardised(profiles.join(mean, "hour").withColumn("x", F.col("z") - F.col("m")), "x")


# -- near-duplicate series -----------------------------------------------------------------------------


def overlaps(aligned: DataFrame, least: int) -> DataFrame:
    """Absolute correlation and label overlap of each two series on their common time stamps, if there are `least` of them.

    The result has a row a pair; stamps of a pair are added up before they are shuffled.
    """
    a, b = (aligned.where("value is not null").select("ts", F.col("entity").alias(f"e{s}"), F.col("value").alias(f"v{s}"), F.col("label").alias(f"l{s}")) for s in "ab")
    both, either = F.sum(F.col("la") * F.col("lb")), F.sum(F.greatest("la", "lb"))
    flat = (F.stddev_pop("va") <= 1e-9) | (F.stddev_pop("vb") <= 1e-9)
    met = a.join(b, "ts").where("ea < eb").groupBy("ea", "eb").agg(
        F.count("*").alias("n"), F.when(flat, 0.0).otherwise(F.abs(correlation("va", "vb"))).alias("r"), F.coalesce(F.try_divide(both, either), F.lit(0.0)).alias("jaccard")
    )
    return met.where(F.col("n") >= least)


def groups(nodes: DataFrame, edges: DataFrame, settle: int = 4) -> DataFrame:
    """(entity, grp): the smallest name that edges (ea, eb) reach. Labels spread until nothing changes, cut off every `settle` rounds."""
    both = edges.select(F.col("ea").alias("entity"), F.col("eb").alias("other")).unionByName(edges.select(F.col("eb").alias("entity"), F.col("ea").alias("other")))
    both = settled(both)
    labels = settled(nodes.select("entity", F.col("entity").alias("grp")))
    while True:
        before = labels
        for _ in range(settle):
            seen = both.join(labels.withColumnRenamed("entity", "other"), "other").groupBy("entity").agg(F.min("grp").alias("__g"))
            labels = labels.join(seen, "entity", "left").select("entity", F.least("grp", "__g").alias("grp"))
        labels = settled(labels)
        if labels.join(before.withColumnRenamed("grp", "__old"), "entity").where("grp <> __old").isEmpty():
            return labels


def keep_longest(grouped: DataFrame) -> DataFrame:
    """grouped (entity, grp, n) with kept: 1 for the longest series of each group, the first by name of equals."""
    best = grouped.groupBy("grp").agg(F.min_by("entity", F.struct(-F.col("n"), F.col("entity"))).alias("__best"))
    return grouped.join(best, "grp").withColumn("kept", (F.col("entity") == F.col("__best")).cast("int")).drop("__best")


def cluster_agreement(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Share of pairs within one cluster, against the chance of it from the clusters' sizes."""
    side = lambda s: clusters.select(F.col("entity").alias(f"e{s}"), F.col("cluster").alias(f"c{s}"))
    hit = pairs.join(side("a"), "ea").join(side("b"), "eb").agg(F.count("*").alias("n_pairs"), F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("same"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    chance = sizes.agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2.0))).alias("chance"))
    return hit.join(F.broadcast(chance))  # one row each


# -- clusters of vectors -------------------------------------------------------------------------------


def cosine_cohesion(vectors: DataFrame) -> DataFrame:
    """By cluster: mean cosine within it and to all others. From sums of unit vectors, without pairs."""
    norm = F.sqrt(total(F.transform("v", lambda x: x * x)))
    unit = vectors.select("cluster", F.posexplode(F.transform("v", lambda x: x / norm)).alias("dim", "x"))
    sums = unit.groupBy("cluster", "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    all_ = sums.groupBy("dim").agg(F.sum("s").alias("sa"), F.sum("n").alias("na"))
    per = sums.join(all_, "dim").groupBy("cluster").agg(F.max("n").alias("n"), F.max("na").alias("na"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * (F.col("sa") - F.col("s"))).alias("so"))
    return per.select("cluster", "n", F.try_divide(F.col("ss") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("within"), F.try_divide(F.col("so"), F.col("n") * (F.col("na") - F.col("n"))).alias("between"))


def centroids(vectors: DataFrame, name: str = "cluster") -> DataFrame:
    """(cluster, n, c, q): mean vector and mean squared length of each cluster."""
    cells = vectors.select(name, F.posexplode("v").alias("dim", "x")).groupBy(name, "dim").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return cells.groupBy(name).agg(F.max("n").alias("n"), F.transform(ordered, lambda e: e["m"]).alias("c"), F.sum("q").alias("q"))


def silhouette(vectors: DataFrame) -> DataFrame:
    """vectors with their silhouette by squared Euclidean distance, from cluster moments: |x|^2 - 2 x m + q is the mean distance to a cluster.

    The clusters' moments go to every task as one array: they number as the clusters do.
    """
    book = centroids(vectors).agg(F.collect_list(F.struct("cluster", "n", "c", "q")).alias("__book"))
    met = vectors.crossJoin(F.broadcast(book)).withColumn("__x", total(F.transform("v", lambda x: x * x)))
    far = met.withColumn("__d", F.transform("__book", lambda e: F.struct(e["cluster"].alias("k"), e["n"].alias("n"), (F.col("__x") - 2 * total(F.zip_with("v", e["c"], lambda a, b: a * b)) + e["q"]).alias("d"))))
    own = F.element_at(F.filter("__d", lambda e: e["k"] == F.col("cluster")), 1)
    a = own["d"] * own["n"] / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("__d", lambda e: e["k"] != F.col("cluster")), lambda e: e["d"]))
    s = F.when(own["n"] > 1, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).otherwise(0.0)
    return far.withColumn("silhouette", s).drop("__book", "__x", "__d")


def nearest_centroid(outsiders: DataFrame, members: DataFrame) -> DataFrame:
    """outsiders with the cluster of the nearest centroid of members, and its distance."""
    book = centroids(members).select(F.col("cluster").alias("code"), "c")
    return assign(outsiders, book).withColumn("distance", F.sqrt("d2")).drop("d2", "d2_next")


def lloyd(vectors: DataFrame, book: DataFrame, rounds: int) -> DataFrame:
    """book (code, c) after so many Lloyd steps; codes without members stay where they are. A book has K rows whatever the data."""
    for _ in range(rounds):
        moved = centroids(assign(vectors, book).select("code", "v"), "code").select("code", F.col("c").alias("__c"))
        book = settled(book.join(moved, "code", "left").select("code", F.coalesce("__c", "c").alias("c")))  # else the plan doubles a round
    return book


def md5_codebook(vectors: DataFrame, k: int) -> DataFrame:
    """(code, c): k vectors in the order of their ids' md5. k rows."""
    name = F.md5(F.col("vec_id").cast("string"))
    return vectors.withColumn("__h", name).orderBy("__h").limit(k).select((F.row_number().over(W.orderBy("__h")) - 1).alias("code"), F.col("v").alias("c"))


def residual_codes(vectors: DataFrame, books: list[DataFrame]) -> DataFrame:
    """vectors with code_1, code_2, ... of residual quantisation, and what is left over as v."""
    for k, book in enumerate(books, 1):
        flat = book.agg(F.map_from_entries(F.collect_list(F.struct("code", "c"))).alias("__c"))  # one row
        coded = assign(vectors, book).drop("d2", "d2_next").crossJoin(F.broadcast(flat))
        vectors = coded.withColumn("v", F.zip_with("v", F.element_at("__c", F.col("code")), lambda a, b: a - b)).withColumnRenamed("code", f"code_{k}").drop("__c")
    return vectors


def book_distance(books: DataFrame) -> DataFrame:
    """Mean distance from each code of client a to the nearest of client b, for each two clients. books: client, code, c."""
    whole = books.groupBy("client").agg(F.collect_list("c").alias("c"))  # K codes a client
    a, b = whole.select(F.col("client").alias("a"), F.col("c").alias("ca")), whole.select(F.col("client").alias("b"), F.col("c").alias("cb"))
    near = F.transform("ca", lambda x: F.array_min(F.transform("cb", lambda y: F.sqrt(square_distance(x, y)))))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", (total(near) / F.size(near)).alias("distance"))


# -- shapes and spectra --------------------------------------------------------------------------------


def interpolate(series: DataFrame, keys: list[str], step: int = CHUNK) -> DataFrame:
    """series with filled: nulls on the line between the nearest values on both sides, ends held; null where a series has no value."""
    both = carried(series, keys, "value", "__p", "__n", step=step)
    p, n = F.col("__p"), F.col("__n")
    line = p["value"] + (n["value"] - p["value"]) * F.try_divide(F.col("t") - p["t"], n["t"] - p["t"])
    return both.withColumn("filled", F.coalesce("value", line, p["value"], n["value"])).drop("__p", "__n")


def resample(series: DataFrame, keys: list[str], points: int) -> DataFrame:
    """(keys, j, z): each series at `points` equal places by linear interpolation, standardised. Each step brings the places between it and the next one."""
    n = series.groupBy(*keys).agg(F.count("*").alias("n"))
    near = framed(series.select(*keys, "t", "filled"), 0, 1, {"__next": lambda w: F.lead(F.struct("t", "filled")).over(w)}, tuple(keys))
    last, t, long = points - 1, F.col("t"), F.greatest(F.col("n") - 1, F.lit(1))
    place = lambda j: j * (F.col("n") - 1) / last
    held = lambda c: F.least(F.greatest(c.cast("long"), F.lit(0)), F.lit(last))
    low, high = held(F.ceil(t * last / long - 1e-6)), held(F.floor((t + 1) * last / long + 1e-6))  # a little wide: place has the last word
    met = near.join(n, keys).where(low <= high).withColumn("j", F.explode(F.sequence(low, high))).where(F.floor(place(F.col("j"))) == t).withColumn("__x", place(F.col("j")))
    on, after = F.ceil("__x") == t, F.col("__next")
    hi = F.when(on, F.col("filled")).otherwise(after["filled"])
    value = met.where(on | (after["t"] == t + 1)).withColumn("r", F.col("filled") + (hi - F.col("filled")) * (F.col("__x") - t)).withColumn("j", F.col("j").cast("int"))
    w = W.partitionBy(*keys)  # as many rows as places
    return value.withColumn("z", (F.col("r") - F.avg("r").over(w)) / (F.stddev_pop("r").over(w) + 1e-9)).select(*keys, "j", "r", "z")


def box_filter(series: DataFrame, half: int, keys: list[str], name: str = "m") -> DataFrame:
    """series with the mean of 2 * half + 1 points around each; both ends are mirrored without repeating the end point."""
    n = series.groupBy(*keys).agg(F.count("*").alias("__n"))
    met = series.join(n, keys)
    left = met.where((F.col("t") >= 1) & (F.col("t") <= half)).withColumn("t", -F.col("t"))
    right = met.where((F.col("t") < F.col("__n") - 1) & (F.col("t") >= F.col("__n") - 1 - half)).withColumn("t", 2 * (F.col("__n") - 1) - F.col("t"))
    padded = met.unionByName(left).unionByName(right)
    return framed(padded, half, half, {name: lambda w: F.avg("value").over(w.rowsBetween(-half, half))}, tuple(keys)).where("t >= 0 and t < __n").drop("__n")


def dft_power(w: Column, n: int) -> Column:
    """Power of the bins 0 to n // 2 of an array of n values."""
    def power(k: int) -> Column:
        part = lambda f: total(F.transform(w, lambda x, i: x * f(2 * math.pi * k * i / n)))
        re, im = part(F.cos), part(F.sin)
        return re * re + im * im

    return F.array(*(power(k) for k in range(n // 2 + 1)))


def spectral_retained(pairs: DataFrame, n: int) -> DataFrame:
    """pairs of windows (x, y) with the share of x's power that y has in the low, middle and high third of the bins."""
    cuts = [0, (n // 2 + 1) // 3, 2 * (n // 2 + 1) // 3, n // 2 + 1]
    spec = pairs.withColumns({"__px": dft_power(F.col("x"), n), "__py": dft_power(F.col("y"), n)})
    band = lambda c, k: total(F.slice(c, cuts[k] + 1, cuts[k + 1] - cuts[k]))
    return spec.withColumns({b: F.try_divide(band("__py", k), band("__px", k)) for k, b in enumerate(("low", "middle", "high"))}).drop("__px", "__py")


def stft(w: Column, n: int, n_fft: int = 4) -> Column:
    """Short-time spectrum of a window of n values: an array of frames, each (re, im) of n_fft // 2 + 1 bins; hop n_fft // 4, Hann, mirrored ends, over sqrt(n_fft)."""
    hop = max(1, n_fft // 4)
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * j / n_fft) for j in range(n_fft)]
    mirrored = lambda i: F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)

    def frame(c: Column) -> Column:
        at = [F.get(w, mirrored(c + (j - n_fft // 2)).cast("int")) for j in range(n_fft)]
        def part(k: int, f) -> Column:
            return sum((x * (h * f(2 * math.pi * k * j / n_fft) / math.sqrt(n_fft)) for j, (x, h) in enumerate(zip(at, hann, strict=True))), F.lit(0.0))
        return F.array(*(F.struct(part(k, math.cos).alias("re"), (-part(k, math.sin)).alias("im")) for k in range(n_fft // 2 + 1)))

    return F.transform(F.sequence(F.lit(0), F.lit(n // hop * hop), F.lit(hop)), frame)


def greedy_peaks(points: DataFrame, keys: list[str], score: str, k: int, apart: int) -> DataFrame:
    """The k best of each key, `apart` steps or more from each other: (keys, t, score, pick). Equal scores go by t. One aggregate a pick."""
    left, out = points.select(*keys, "t", F.col(score).alias("score")), None
    for pick in range(1, k + 1):
        best = left.groupBy(*keys).agg(F.max_by(F.struct("t", "score"), F.struct(F.col("score"), -F.col("t"))).alias("b")).select(*keys, F.col("b.t").alias("__t"), F.col("b.score").alias("__s"))
        row = best.select(*keys, F.col("__t").alias("t"), F.col("__s").alias("score"), F.lit(pick).alias("pick"))
        out = row if out is None else out.unionByName(row)
        left = left.join(best.drop("__s"), keys).where(F.abs(F.col("t") - F.col("__t")) >= apart).drop("__t")
    return out
