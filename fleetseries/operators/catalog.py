"""Clean windows, samples of windows, integrity of builds, cohorts, record keeping and verdicts over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import bankers, beside, dense_index, let, quantiles, running_sum, settled
from fleetseries.operators.faults import normal, uniform
from fleetseries.operators.prep import KEYS, average_rank, join_pieces, labels_from_segments, segment_pieces

# -- clean windows -------------------------------------------------------------------------------------


def labelled_pieces(series: DataFrame) -> DataFrame:
    """Pieces of each entity's runs without gaps, labelled points apart. The points are read once, here; all of clean windows is worked out from these."""
    return segment_pieces(series, F.col("value").isNotNull(), ["entity"], F.col("label") == 1)


def window_candidates(pieces: DataFrame, guard: int, val: int, train: int, share: float, step: int = 128) -> DataFrame:
    """(entity, a, b, n, s, bad): windows without gaps from a run's start, or guard steps after a label, to the run's end, whose
    first s steps and the guard before them hold no label and whose rest holds bad of them, one at least.

    Labels and runs meet by buckets of `step` steps; labels are counted up to three places of a window by running totals over
    both. Both come from small files of very many rows, which Spark would broadcast by the files' size: the hint forbids it.
    """
    hits = pieces.where("__alone IS NOT NULL").groupBy("entity", F.col("__alone").alias("t")).agg(F.sum("length").alias("c"))
    runs = pieces.groupBy("entity", "__chunk", "__run").agg(*(f(n).alias(n) for f, n in ((F.min, "start"), (F.max, "stop"), (F.sum, "length"), (F.max, "__first"), (F.max, "__last"))))
    ends = settled(join_pieces(runs, ["entity"]).select("entity", F.col("start").alias("a0"), (F.col("stop") + 1).alias("b")))
    dealt = ends.withColumn("__b", F.explode(F.sequence(F.floor(F.col("a0") / step), F.floor((F.col("b") - 1) / step))))
    later = hits.select("entity", (F.col("t") + 1 + guard).alias("a")).withColumn("__b", F.floor(F.col("a") / step))
    after = later.join(dealt.hint("merge"), ["entity", "__b"]).where((F.col("a") >= F.col("a0")) & (F.col("a") < F.col("b"))).select("entity", "a", "b")
    cand = ends.select("entity", F.col("a0").alias("a"), "b").unionByName(after).distinct()
    length = F.col("b") - F.col("a")
    sized = cand.withColumns({"n": length, "s": bankers(0.5 * length)})
    fits = sized.where((F.col("s") >= val + train) & (F.col("s") >= share * F.col("n")) & (F.col("n") - F.col("s") >= share * F.col("n")))
    window = F.struct("a", "b", "n", "s").alias("w")
    at = (F.col("a") - guard - 1, F.col("a") + F.col("s") - 1, F.col("b") - 1)
    asked = fits.select("entity", window, F.posexplode(F.array(*at)).alias("k", "t")).withColumn("t", 2 * F.col("t") + 1)  # after a label at the same step
    both = hits.select("entity", (2 * F.col("t")).alias("t"), "c").unionByName(asked, allowMissingColumns=True)
    upto = running_sum(both, F.coalesce("c", F.lit(0)), "__c", ("entity",)).where("w IS NOT NULL")
    count = lambda k: F.max(F.when(F.col("k") == k, F.col("__c")))
    counted = upto.groupBy("entity", "w").agg(*(count(k).alias(f"c{k}") for k in range(3)))
    return counted.where("c1 = c0 AND c2 > c1").select("entity", "w.*", (F.col("c2") - F.col("c1")).alias("bad"))


def longest_windows(candidates: DataFrame, most_rate: float | None) -> DataFrame:
    """(entity, a, split_at, b): the longest of each entity's candidates, labelled on at most most_rate of their rest; of equally long ones the first."""
    good = candidates if most_rate is None else candidates.where(F.col("bad") <= most_rate * (F.col("n") - F.col("s")))
    best = good.groupBy("entity").agg(F.min_by(F.struct("a", (F.col("a") + F.col("s")).alias("split_at"), "b"), F.struct(-F.col("n"), F.col("a"))).alias("w"))
    return best.select("entity", "w.a", "w.split_at", "w.b")


def clean_windows(series: DataFrame, guard: int, val: int, train: int, share: float = 0.1, most_rate: float | None = None) -> DataFrame:
    """(entity, a, split_at, b): the longest window without gaps whose first half, and the guard before it, is free of labels.

    Its second half has a label, and labels on at most most_rate of its points (None: any). Half of it holds val and
    train points at least, and each part a `share` of it. A window starts at a run's start or guard steps after a label.
    Of equally long windows the first counts.
    """
    return longest_windows(window_candidates(labelled_pieces(series), guard, val, train, share), most_rate)


def funnel(series: DataFrame, guard: int, val: int, train: int, most_rate: float) -> DataFrame:
    """(entity, reason): the first stage that turns a series down, or client."""
    pieces = labelled_pieces(series)
    any_ = pieces.groupBy("entity").agg(F.max(F.col("__alone").isNotNull()).alias("any"))
    found = window_candidates(pieces, guard, val, train, 0.1).groupBy("entity").agg(F.max(F.col("bad") <= most_rate * (F.col("n") - F.col("s"))).alias("minor"))
    met = any_.join(found, "entity", "left")
    reason = F.when(~F.col("any"), "no_anomaly").when(F.col("minor").isNull(), "no_clean_window").when(~F.col("minor"), "anomaly_dominated").otherwise("client")
    return met.select("entity", reason.alias("reason"))


def fixed_parts(series: DataFrame, windows: DataFrame, val: int) -> DataFrame:
    """Points of each entity's window with part: the last `val` before the split are validation, those after it test."""
    met = series.join(windows.hint("shuffle_hash"), "entity").where((F.col("t") >= F.col("a")) & (F.col("t") < F.col("b")))
    part = F.when(F.col("t") >= F.col("split_at"), "test").when(F.col("t") >= F.col("split_at") - val, "val").otherwise("train")
    return met.withColumn("part", part).drop("a", "split_at", "b")


# -- samples of windows --------------------------------------------------------------------------------


def by_md5(windows: DataFrame, seed: int) -> DataFrame:
    return windows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), "entity", "split", F.col("w_start").cast("string"))))


def scarce(windows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A share of each entity's windows (one at least), half to even, in the order of their md5."""
    placed = dense_index(by_md5(windows, seed), ("entity",), F.substring("__h", 1, 2), ["__h"], "__i")
    n = windows.groupBy("entity").agg(F.count("*").alias("__n"))
    return placed.join(n, "entity").where(F.col("__i") < F.greatest(F.lit(1), bankers(F.col("__n") * share))).drop("__i", "__n", "__h")


def pooled_cap(windows: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """At most `cap` windows over all entities, in the order of their md5."""
    return by_md5(windows, seed).orderBy("__h").limit(cap).drop("__h")


def rank_fingerprints(series: DataFrame) -> DataFrame:
    """(entity, n, f1, f2, f3): sums of md5 pieces of (step, rank of its value). Scaling a series does not change them; no series is gathered."""
    ranked = average_rank(series, ["entity"], "value", "__r")
    return content_sums(ranked, ["entity"], F.concat_ws("|", F.col("t").cast("string"), (2 * F.col("__r")).cast("long").cast("string")))


def content_sums(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """(keys, n, f1, f2, f3): an additive digest of a multiset of rows, three sums of 40 bits of each row's md5."""
    piece = lambda at: F.sum(F.conv(F.substring(F.md5(content), at, 10), 16, 10).cast("long"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), piece(1).alias("f1"), piece(11).alias("f2"), piece(21).alias("f3"))


def first_of_equal(prints: DataFrame) -> DataFrame:
    """prints with kept: 1 for the first entity, by name, of those with one fingerprint."""
    first = prints.groupBy("n", "f1", "f2", "f3").agg(F.min("entity").alias("__first"))
    return prints.join(first, ["n", "f1", "f2", "f3"]).withColumn("kept", (F.col("entity") == F.col("__first")).cast("int")).drop("__first")


# -- integrity -----------------------------------------------------------------------------------------


def split_alignment(series: DataFrame, splits: list[str]) -> DataFrame:
    """By entity: points and labels of each split, and whether all splits are there with as many labels as points."""
    counts = series.groupBy("entity").agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits), *(F.count_if((F.col("split") == s) & F.col("label").isNotNull()).alias(f"l_{s}") for s in splits))
    fine = F.lit(True)
    for s in splits:
        fine = fine & (F.col(f"n_{s}") > 0) & (F.col(f"n_{s}") == F.col(f"l_{s}"))
    return counts.withColumn("aligned", fine.cast("int"))


def partition_proof(original: DataFrame, shards: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows lost and rows added when the shards are put together again, duplicates counted."""
    a, b = original.select(*columns), shards.select(*columns)
    count = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return count(a, b, "lost").join(F.broadcast(count(b, a, "added")))  # one row each


def pair_builds(a: DataFrame, b: DataFrame) -> DataFrame:
    """(entity, state): both builds' digests compared: same, drift, only_a or only_b."""
    both = a.select("entity", F.struct("n", "f1", "f2", "f3").alias("x")).join(b.select("entity", F.struct("n", "f1", "f2", "f3").alias("y")), "entity", "full")
    return both.select("entity", F.when(F.col("y").isNull(), "only_a").when(F.col("x").isNull(), "only_b").when(F.col("x") == F.col("y"), "same").otherwise("drift").alias("state"))


def cohort(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, fingerprint): the pinned membership of each cohort, 16 digits of the SHA-256 of its sorted names."""
    names = F.array_join(F.array_sort(F.collect_list("entity")), ",")  # a cohort's names are a row each in the result's source
    return members.groupBy(*keys).agg(F.count("*").alias("n"), F.substring(F.sha2(names, 256), 1, 16).alias("fingerprint"))


# -- records -------------------------------------------------------------------------------------------


def deduped(records: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The last record of each key; one with a suite is never displaced by one without."""
    rank = F.struct(F.col("suite").isNotNull(), F.col(stamp))
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__r")).select(*keys, "__r.*")


def bootstrap_median(differences: DataFrame, keys: list[str], draws: int = 10_000) -> DataFrame:
    """(keys, n, low, high): the 2.5 and 97.5 % points of the median over md5-picked resamples. Rows are a result table's few."""
    placed = differences.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy("entity")) - 1)
    n = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    slots = placed.select(*keys, F.col("i").alias("slot")).join(n, keys).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = slots.withColumn("i", pick.cast("int")).join(placed.select(*keys, "i", "d"), [*keys, "i"])
    medians = drawn.groupBy(*keys, "n", "draw").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    return medians.groupBy(*keys, "n").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def canonical_arms(records: DataFrame, prefixes: DataFrame) -> DataFrame:
    """records with the window mark (__w<n>) taken off the arm's name, and canon: the name of its longest known prefix.

    prefixes (prefix, name) are a short list that is kept by hand.
    """
    bare = F.regexp_replace("arm", r"__w\d+$", "")
    arms = records.select("arm").distinct().withColumn("bare", bare)
    met = arms.join(F.broadcast(prefixes), F.col("bare").startswith(F.col("prefix")), "left")
    best = met.groupBy("arm", "bare").agg(F.max_by("name", F.length("prefix")).alias("canon"))
    window = F.expr(r"try_cast(nullif(regexp_extract(arm, '__w([0-9]+)$', 1), '') as int)")
    return records.join(best, "arm").withColumn("window", window)


def ladder(records: DataFrame, rungs: DataFrame) -> DataFrame:
    """(arm, n, value) for every rung (arm), those without records included."""
    means = records.groupBy("arm").agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return rungs.join(means, "arm", "left").fillna(0, ["n"])


def verdicts(differences: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(keys, n, ci_low, ci_high, verdict): the normal interval of the mean against the predicted one."""
    m = differences.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    reach = 1.96 * F.col("s") / F.sqrt("n")
    ci = m.withColumns({"ci_low": F.col("m") - reach, "ci_high": F.col("m") + reach})
    inside, apart = (F.col("ci_low") >= low) & (F.col("ci_high") <= high), (F.col("ci_high") < low) | (F.col("ci_low") > high)
    return ci.select(*keys, "n", "ci_low", "ci_high", F.when(F.col("s").isNull(), "too_few").when(inside, "confirmed").when(apart, "refuted").otherwise("open").alias("verdict"))


def experiment_state(design: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """design with state: done (one record), double (more) or missing."""
    n = records.groupBy(*keys).agg(F.count("*").alias("__n"))
    return design.join(n, keys, "left").withColumn("state", F.when(F.col("__n") > 1, "double").when(F.col("__n") == 1, "done").otherwise("missing")).drop("__n")


def before_after(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Means of a and b, their difference and the share of rows that fell, by key."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("a").alias("before"), F.avg("b").alias("after"), F.avg(F.col("b") - F.col("a")).alias("delta"), F.avg((F.col("b") < F.col("a")).cast("double")).alias("improved"))


def convergence(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, best_round, last_round, reportable): a run whose best round is its last has not converged. rounds: keys, round, loss."""
    g = rounds.groupBy(*keys).agg(F.min_by("round", F.struct("loss", "round")).alias("best_round"), F.max("round").alias("last_round"))
    return g.withColumn("reportable", (F.col("best_round") < F.col("last_round")).cast("int"))


def best_median_worst(rows: DataFrame, keys: list[str], metric: str, k: int) -> DataFrame:
    """rows of the k best, the k around the middle and the k worst by metric, a row for each place; equal ones go by entity."""
    w = W.partitionBy(*keys)
    r = rows.withColumns({"__r": F.row_number().over(w.orderBy(F.desc(metric), "entity")), "__n": F.count("*").over(w)})
    first = F.floor((F.col("__n") - k) / 2) + 1
    places = F.filter(F.array(
        F.when(F.col("__r") <= k, "best"), F.when((F.col("__r") >= first) & (F.col("__r") < first + k), "median"), F.when(F.col("__r") > F.col("__n") - k, "worst")
    ), lambda p: p.isNotNull())
    return r.withColumn("place", F.explode(places)).drop("__r", "__n")


# -- scores and tokens ---------------------------------------------------------------------------------


def pot_threshold(scores: DataFrame, keys: list[str], level: float = 0.02, q: float = 1e-3, top: DataFrame | None = None) -> DataFrame:
    """thr: peaks over the (1 - level) quantile as a generalised Pareto tail, fitted by its moments (our own estimator), cut at risk q. top: that quantile u by key, if it is known."""
    top = (quantiles(scores, keys, "score", {"u": 1 - level}) if top is None else top).join(scores.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    peak = scores.join(top, keys).where("score > u").withColumn("e", F.col("score") - F.col("u"))
    g = peak.groupBy(*keys, "u", "n").agg(F.count("*").alias("c"), F.avg("e").alias("m"), F.var_pop("e").alias("v"))
    ratio = F.col("m") * F.col("m") / F.col("v")
    xi, sigma, r = 0.5 * (1 - ratio), 0.5 * F.col("m") * (ratio + 1), q * F.col("n") / F.col("c")
    tail = F.when((F.col("v") <= 1e-12) | (F.abs(xi) < 1e-9), -F.col("m") * F.log(r)).otherwise(sigma / xi * (F.pow(r, -xi) - 1))
    return top.join(g.select(*keys, tail.alias("__x")), keys, "left").select(*keys, (F.col("u") + F.coalesce("__x", F.lit(0.0))).alias("thr"))


def two_level_quantile(scores: DataFrame, q: float) -> DataFrame:
    """(channel, thr) from (rate, channel, freq, score): quantile over time, sum over rates, mean over frequencies."""
    low = quantiles(scores, ["rate", "channel", "freq"], "score", {"x": q})
    joint = low.groupBy("channel", "freq").agg(F.sum("x").alias("x"))
    return joint.groupBy("channel").agg(F.avg("x").alias("thr"))


def window_flags(scores: DataFrame, width: int, share: float = 0.9) -> DataFrame:
    """scores over their threshold thr, of each window and channel the floor(share * width) best at most."""
    at = W.partitionBy("entity", "channel", F.floor(F.col("t") / width)).orderBy(F.desc("score"), "t")
    return scores.where("score > thr").withColumn("__r", F.row_number().over(at)).where(F.col("__r") <= int(share * width)).drop("__r")


def hit_windows(points: DataFrame, width: int) -> DataFrame:
    """Tumbling windows with a labelled point whose highest score passes the threshold."""
    each = points.groupBy(*KEYS, (F.col("t") - F.col("t") % width).alias("w_start")).agg(F.sum("label").alias("n_pos"), F.max("score").alias("top"), F.max("thr").alias("thr"))
    return each.where("n_pos > 0 and top > thr").drop("thr")


def tile_bands(series: DataFrame, width: int) -> DataFrame:
    """Low, mean and high of the means of the tiles that hold a step: tiles of `width` side by side, and one aligned to the end."""
    n = series.groupBy(*KEYS).agg(F.count("*").alias("__n"))
    met = series.join(n, KEYS).where(F.col("__n") >= width)
    own, last = F.col("t") - F.col("t") % width, F.col("__n") - width
    starts = F.array_distinct(F.filter(F.array(F.when(own + width <= F.col("__n"), own), F.when(F.col("t") >= last, last)), lambda s: s.isNotNull()))
    tiled = met.withColumn("__s", F.explode(starts))
    means = tiled.groupBy(*KEYS, "__s").agg(F.avg("value").alias("__m"))
    return tiled.join(means, [*KEYS, "__s"]).groupBy(*KEYS, "t").agg(F.min("__m").alias("low"), F.avg("__m").alias("mean"), F.max("__m").alias("high"), F.count("*").alias("n_tiles"))


def select_positions(points: DataFrame, keys: list[str], score: str, q: float) -> DataFrame:
    """points with variant: top (score at its window's quantile q or over it), and as many random (by md5) and bottom ones."""
    cut = points.groupBy(*keys).agg(F.percentile(score, F.lit(q)).alias("__q"))
    top = points.join(cut, keys).withColumn("__top", F.col(score) >= F.col("__q"))
    w = W.partitionBy(*keys)  # a window's positions
    name = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col("pos").cast("string")))
    ranked = top.withColumns({"__k": F.count_if(F.col("__top")).over(w), "__low": F.row_number().over(w.orderBy(score, "pos")), "__rnd": F.row_number().over(w.orderBy(name))})
    variants = F.filter(F.array(F.when(F.col("__top"), "top"), F.when(F.col("__rnd") <= F.col("__k"), "random"), F.when(F.col("__low") <= F.col("__k"), "bottom")), lambda v: v.isNotNull())
    return ranked.withColumn("variant", F.explode(variants)).drop("__q", "__top", "__k", "__low", "__rnd")


def combine_nll(nll: DataFrame, keys: list[str]) -> DataFrame:
    """nll of several sources as one: best, mean, and the log of the mean likelihood, plain and by weight. The least is taken out of the exponents."""
    low = nll.groupBy(*keys).agg(F.min("nll").alias("best"))
    e = F.exp(F.col("best") - F.col("nll"))
    g = nll.join(low, keys).groupBy(*keys, "best").agg(F.avg("nll").alias("mean"), F.avg(e).alias("a"), (F.sum(F.col("weight") * e) / F.sum("weight")).alias("b"))
    return g.select(*keys, "best", "mean", (F.col("best") - F.log("a")).alias("mixture"), (F.col("best") - F.log("b")).alias("weighted"))


def gated_nll(tokens: DataFrame, experts: DataFrame, keys: list[str]) -> DataFrame:
    """tokens (keys, pos, token) with nll of mixtures of experts(client, token, logq, nll, logn): gated by volume, by context and by target.

    An expert's log weight is logn; logn and the log occupancies logq of all tokens of the window (keys); logn less its
    nll of the very token (a foil: it looks at what it predicts). The mixture is -log sum exp(weight - nll) + log sum
    exp(weight), each sum with its greatest exponent taken out. Tokens that an expert has no row for are not its.
    """
    met = tokens.select(*keys, "pos", "token").join(experts, "token")
    context = met.groupBy(*keys, "client").agg(F.sum("logq").alias("__q"))
    rows = met.join(context, [*keys, "client"]).groupBy(*keys, "pos", "token").agg(F.collect_list(F.struct("logn", "nll", (F.col("logn") + F.col("__q")).alias("context"))).alias("__e"))

    def log_sum(weight) -> Column:
        total = lambda x, top: F.aggregate(x, F.lit(0.0), lambda a, y: a + F.exp(y - top))
        return let(F.transform("__e", weight), lambda x: let(F.array_max(x), lambda top: top + F.log(total(x, top))))

    mixed = lambda weight: -log_sum(lambda e: weight(e) - e["nll"]) + log_sum(weight)
    gates = {"volume_gate": lambda e: e["logn"], "context_gate": lambda e: e["context"], "target_gate": lambda e: e["logn"] - e["nll"]}
    return rows.select(*keys, "pos", "token", *(mixed(w).alias(name) for name, w in gates.items()))


def choose_source(calibration: DataFrame, rest: DataFrame) -> DataFrame:
    """By target: the source that is best on the calibration slice, its value on the rest against the mean and the best there, and the share of that gap."""
    pick = calibration.groupBy("target").agg(F.min_by("source", F.struct(-F.col("value"), F.col("source"))).alias("picked"))
    met = rest.join(pick, "target").groupBy("target", "picked").agg(F.max(F.when(F.col("source") == F.col("picked"), F.col("value"))).alias("value"), F.avg("value").alias("mean"), F.max("value").alias("oracle"))
    return met.withColumn("recovered", F.try_divide(F.col("value") - F.col("mean"), F.col("oracle") - F.col("mean")))


def noised_release(counts: DataFrame, k: int, sigma: float, alpha: float = 1.0) -> DataFrame:
    """counts (group, token, n) with normal noise of sigma times the mean count, not below 0, and p after Laplace. Noise only: no privacy guarantee."""
    mean = counts.groupBy("group").agg((F.sum("n") / k).alias("__m"))
    z = normal(F.concat_ws("|", F.col("group").cast("string"), F.col("token").cast("string")))
    noisy = counts.join(mean, "group").withColumn("noisy", F.greatest(F.col("n") + sigma * F.col("__m") * z, F.lit(0.0)))
    return noisy.withColumn("p", (F.col("noisy") + alpha) / (F.sum("noisy").over(W.partitionBy("group")) + alpha * k)).drop("__m")


def poisoned(tokens: DataFrame, entity: str, k: int) -> DataFrame:
    """tokens with one entity's tokens replaced by uniform ones (by md5 of the place)."""
    place = F.concat_ws("|", "entity", "split", F.col("win").cast("string"), F.col("pos").cast("string"))
    drawn = (F.conv(F.substring(F.md5(place), 1, 8), 16, 10).cast("long") % k).cast("int")
    return tokens.withColumn("token", F.when(F.col("entity") == entity, drawn).otherwise(F.col("token")))


def moving_usage(rounds: DataFrame, decay: float) -> DataFrame:
    """(code, round, ema, corrected): the moving average of each round's counts in closed form. rounds (code, round, n): codes times rounds."""
    whole = rounds.groupBy("code").agg(F.collect_list(F.struct("round", "n")).alias("__h"))
    each = rounds.select("round").distinct().crossJoin(whole)  # the size of the result
    seen = F.filter("__h", lambda e: e["round"] <= F.col("round"))
    ema = F.aggregate(seen, F.lit(0.0), lambda s, e: s + (1 - decay) * F.pow(F.lit(decay), F.col("round") - e["round"]) * e["n"])
    return each.withColumn("ema", ema).withColumn("corrected", F.col("ema") / (1 - F.pow(F.lit(decay), F.col("round") + 1))).drop("__h")


def revive(book: DataFrame, usage: DataFrame, least: int, jitter: float) -> DataFrame:
    """book (code, c) where codes used less than `least` times take a live code's place, plus jitter. K rows: dead codes go round the live ones by use."""
    met = book.join(usage, "code", "left").fillna(0, ["n"]).withColumn("live", F.col("n") >= least)
    w = W.partitionBy("live")
    placed = met.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "code")) - 1, "m": F.count("*").over(w)})
    alive = placed.where("live").select(F.col("r").alias("__r"), F.col("c").alias("__c"), F.col("m").alias("__m"))
    n_live = alive.agg(F.count("*").alias("__m"))
    dead = placed.where("not live").crossJoin(F.broadcast(n_live)).withColumn("__r", (F.col("r") % F.col("__m")).cast("int")).drop("__m").join(alive.drop("__m"), "__r")
    shaken = F.transform("__c", lambda x, i: x + jitter * (2 * uniform(F.concat_ws("|", F.col("code").cast("string"), i.cast("string"))) - 1))
    return placed.where("live").select("code", "c", F.lit(0).alias("revived")).unionByName(dead.select("code", shaken.alias("c"), F.lit(1).alias("revived")))


def agreement(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Agreement of two tokenizers (columns a, b): raw, by chance, kappa, Jaccard overlap of the tokens used, and Jensen-Shannon divergence (Laplace over k)."""
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))  # k * k cells a key
    use = lambda c, name: cells.groupBy(*keys, F.col(c).alias("token")).agg(F.sum("n").alias(name))
    both = use("a", "na").join(use("b", "nb"), [*keys, "token"], "full").fillna(0, ["na", "nb"])
    n = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    p, q = (F.col("na") + 1) / (F.col("n") + k), (F.col("nb") + 1) / (F.col("n") + k)
    m = (p + q) / 2
    term = 0.5 * (p * F.log(p / m) + q * F.log(q / m))
    each = both.join(n, keys).groupBy(*keys, "n", "same").agg(
        F.sum(F.col("na") * F.col("nb") / (F.col("n") * F.col("n"))).alias("chance"), (F.count_if((F.col("na") > 0) & (F.col("nb") > 0)) / F.count("*")).alias("jaccard"), F.sum(term).alias("js")
    )
    raw = F.col("same") / F.col("n")
    return each.select(*keys, "n", raw.alias("raw"), "chance", F.try_divide(raw - F.col("chance"), 1 - F.col("chance")).alias("kappa"), "jaccard", "js")


def channel_labels_from_events(series: DataFrame, events: DataFrame) -> DataFrame:
    """series with channel_label from event rows (entity, start, stop half-open, anomaly_channels as a JSON list).

    Channels that a series doesn't have are ignored; an entity without any event row gets null.
    """
    spans = events.where("stop > start").select("entity", "start", (F.col("stop") - 1).alias("stop"), F.explode(F.from_json("anomaly_channels", "array<int>")).alias("channel"))
    marked = labels_from_segments(series, spans, ["entity", "channel"])
    known = events.select("entity").distinct().withColumn("__k", F.lit(True))
    return marked.join(known, "entity", "left").withColumn("channel_label", F.when(F.col("__k"), F.col("label"))).drop("__k", "label")


def nearest_upsample(series: DataFrame, columns: DataFrame, keys: list[str], width: int, value: str) -> DataFrame:
    """series with the value of the column floor(t * width / T) that stands for each step."""
    n = series.groupBy(*keys).agg(F.count("*").alias("__n"))
    return series.join(n, keys).withColumn("bucket", F.expr(f"cast((t * {width}) div __n as int)")).join(columns.select(*keys, "bucket", value), [*keys, "bucket"], "left").drop("__n")


def weighted_scores(wide: DataFrame, weights: dict[str, float]) -> DataFrame:
    """wide (entity, t, a column a scorer) with score: the weighted sum of the scores, each brought to 0..1 within its entity."""
    ends = wide.groupBy("entity").agg(*(f(h).alias(f"__{n}_{h}") for h in weights for n, f in (("lo", F.min), ("hi", F.max))))
    part = lambda h: (F.col(h) - F.col(f"__lo_{h}")) / F.greatest(F.col(f"__hi_{h}") - F.col(f"__lo_{h}"), F.lit(1e-6))
    return wide.join(ends, "entity").withColumn("score", sum((w * part(h) for h, w in weights.items()), F.lit(0.0))).select(*wide.columns, "score")


# -- affiliation ---------------------------------------------------------------------------------------


def affiliation(truth: DataFrame, found: DataFrame, lengths: DataFrame, keys: list[str], step: int = 1024) -> DataFrame:
    """Affiliation precision, recall and F1 by key, from integrals in closed form.

    truth and found: keys, start, stop (half-open). lengths: keys, n. Each true event has a zone that reaches halfway to
    its neighbours. A found point scores the chance that a random point of the zone lies as far from the event or
    farther; a point of the event, the chance that a random one lies as far from it as what was found there.
    Zones without a found part count 0 for recall and not for precision. Keys without events on either side have no row.
    Zones meet what was found in buckets of the time axis; a pair is kept in the first bucket that both share.
    """
    ends = truth.select(*keys, F.col("start").cast("double").alias("a"), F.col("stop").cast("double").alias("b"))
    zones = beside(ends, keys, "a", {"__p": "b"}, {"__n": "a"}, step).join(lengths, keys).select(
        *keys, "a", "b", F.coalesce((F.col("__p") + F.col("a")) / 2, F.lit(0.0)).alias("e0"), F.coalesce((F.col("b") + F.col("__n")) / 2, F.col("n").cast("double")).alias("e1")
    )
    spread = lambda df, lo, hi: df.withColumn("__b", F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step))))
    z = spread(zones, F.col("e0"), F.col("e1"))
    p = spread(found.select(*keys, F.col("start").cast("double").alias("c"), F.col("stop").cast("double").alias("d")), F.col("c"), F.col("d"))
    met = z.join(p, [*keys, "__b"]).where((F.col("c") < F.col("e1")) & (F.col("d") > F.col("e0")) & (F.col("__b") == F.floor(F.greatest("c", "e0") / step)))
    cut = met.withColumns({"i0": F.greatest("c", "e0"), "i1": F.least("d", "e1")}).drop("__b", "c", "d")
    a, b, e0, e1, i0, i1 = (F.col(x) for x in ("a", "b", "e0", "e1", "i0", "i1"))
    zero, size = F.lit(0.0), e1 - e0

    def capped(d0: Column, d1: Column, room: Column) -> Column:
        """The integral of min(d, room) from d0 to d1."""
        upto = lambda d: F.when(d <= room, d * d / 2).otherwise(room * room / 2 + room * (d - room))
        return upto(d1) - upto(d0)

    def outside(d0: Column, d1: Column) -> Column:
        return F.when(d1 > d0, (d1 - d0) - ((b - a) * (d1 - d0) + capped(d0, d1, a - e0) + capped(d0, d1, e1 - b)) / size).otherwise(zero)

    inside = F.greatest(F.least(i1, b) - F.greatest(i0, a), zero)
    gain = inside + outside(F.greatest(a - F.least(i1, a), zero), F.greatest(a - i0, zero)) + outside(F.greatest(F.greatest(i0, b) - b, zero), F.greatest(i1 - b, zero))
    zone = [*keys, "a", "b", "e0", "e1"]
    v = W.partitionBy(*keys, "a").orderBy("i0")
    shared = cut.withColumn("gain", gain).withColumns({"z0": F.coalesce((F.lag("i1").over(v) + i0) / 2, e0), "z1": F.coalesce((i1 + F.lead("i0").over(v)) / 2, e1)})
    j0, j1 = F.greatest(a, F.col("z0")), F.least(b, F.col("z1"))

    def missed(lo: Column, hi: Column, pivot: Column, near: Column) -> Column:
        """The integral over y from lo to hi of 1 - (|y - pivot| + min(|y - near|, |y - pivot|)) / size, near being the zone's end on y's side."""
        d = lambda y: F.abs(y - pivot)
        far = F.greatest(d(lo), d(hi))
        close = F.least(d(lo), d(hi))
        span = F.abs(pivot - near)
        half = span / 2  # from there on the zone's end is nearer than the pivot
        tent = lambda x: F.when(x <= half, x * x / 2).otherwise(half * half / 2 + span * (x - half) - (x * x - half * half) / 2)
        return F.when(hi > lo, (hi - lo) - ((far * far - close * close) / 2 + tent(far) - tent(close)) / size).otherwise(zero)

    hit = F.greatest(F.least(j1, i1) - F.greatest(j0, i0), zero)
    seen = hit + missed(j0, F.least(j1, i0), i0, e0) + missed(F.greatest(j0, i1), j1, i1, e1)
    per = shared.withColumn("seen", F.when(j1 > j0, seen).otherwise(zero)).groupBy(*zone).agg((F.sum("gain") / F.sum(i1 - i0)).alias("precision"), (F.sum("seen") / (b - a)).alias("recall"))
    both = zones.join(found.select(*keys).distinct(), keys, "left_semi").join(per, zone, "left")
    out = both.groupBy(*keys).agg(F.avg("precision").alias("precision"), F.avg(F.coalesce("recall", zero)).alias("recall"), F.count("*").alias("n_events"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
