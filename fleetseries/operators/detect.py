"""Scoring heads, score assembly, thresholds and detection metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import framed, quantiles, runs, value_sums
from fleetseries.operators.prep import KEYS, average_rank, causal_average, centred_average

# -- closed-form heads ---------------------------------------------------------------------------------


def ma_centred(series: DataFrame, k: int = 10, value: str = "x") -> DataFrame:
    """score: squared distance from the centred moving average."""
    made = centred_average(series, k, "__a", value)
    return made.withColumn("score", F.pow(F.col(value) - F.col("__a"), 2)).drop("__a")


def ma_causal(series: DataFrame, k: int = 10, value: str = "x") -> DataFrame:
    made = causal_average(series, k, "__a", value)
    return made.withColumn("score", F.pow(F.col(value) - F.col("__a"), 2)).drop("__a")


def diff1(series: DataFrame, value: str = "x") -> DataFrame:
    """score: squared first difference; the first point copies the second, a single point scores 0."""
    made = framed(series, 1, 1, {"__b": lambda w: F.lag(value).over(w), "__f": lambda w: F.lead(value).over(w)})
    step = F.coalesce(F.col(value) - F.col("__b"), F.col("__f") - F.col(value), F.lit(0.0))
    return made.withColumn("score", step * step).drop("__b", "__f")


def random_head(series: DataFrame, seed: int = 0) -> DataFrame:
    """score: a stable uniform number by seed, entity, split, channel and step."""
    h = F.pmod(F.xxhash64(F.lit(seed), *KEYS, "t"), F.lit(1 << 53))
    return series.withColumn("score", h / F.lit(float(1 << 53)))


#: Numbers that a task's sums of products may take before they are passed on: 256 MB.
HELD = 1 << 25


def gram(vectors: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """n, s (sums) and g (sums of products, row by row) of vectors by key.

    A task adds up its own rows over all its batches, and passes the sums on when they take HELD numbers; Spark adds
    the tasks' sums. Products are sent once for a pair of places.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        width = 0

        def flush() -> pd.DataFrame:
            rows = [(*key, n, t, g[np.triu_indices(len(t))]) for key, (n, t, g) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "n", "s", "g"])

        for pdf in batches:
            for key, own in pdf.groupby(keys, dropna=False, sort=False):
                x = np.stack(own[v].to_numpy()).astype(float)
                width = x.shape[1]
                sums = held.setdefault(tuple(None if pd.isna(k) else k for k in key), [0, np.zeros(width), np.zeros((width, width))])
                sums[0] += len(x)
                sums[1] += x.sum(0)
                sums[2] += x.T @ x
                if len(held) * width * width > HELD:
                    yield flush()
        if held:
            yield flush()

    kinds = ", ".join(f"`{k}` {dict(vectors.dtypes)[k]}" for k in keys)
    parts = vectors.select(*keys, v).mapInPandas(part, f"{kinds}, n long, s array<double>, g array<double>")
    # one row a place: the count, then the sums, then the triangle
    cells = parts.select(*keys, F.size("s").alias("m"), F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "g")).alias("i", "x"))
    added = cells.groupBy(*keys, "m", "i").agg(F.sum("x").alias("x")).groupBy(*keys, "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("x"))
    m = F.col("m")

    def product(k: Column) -> Column:
        i, j = F.least(F.floor(k / m), k % m), F.greatest(F.floor(k / m), k % m)
        return F.get("x", (1 + m + i * m - F.floor(i * (i - 1) / 2) + j - i).cast("int"))  # rows before i have m, m - 1, ... places

    whole = F.transform(F.sequence(F.lit(0), m * m - 1), product)
    return added.select(*keys, F.get("x", F.lit(0)).cast("long").alias("n"), F.slice("x", F.lit(2), m).alias("s"), whole.alias("g"))


def ar_stats(series: DataFrame, keys: list[str], p: int = 32, value: str = "x") -> DataFrame:
    """Sums for an AR(p) fit by key: over vectors of the p values before a point, last first, with the point itself at the end."""
    lagged = framed(series, p, 0, {"__w": lambda w: F.collect_list(value).over(w.rowsBetween(-p, 0))}).where(F.size("__w") == p + 1)
    return gram(lagged.select(*keys, F.concat(F.reverse(F.slice("__w", 1, p)), F.slice("__w", p + 1, 1)).alias("v")), keys)


def ar_solve(stats: DataFrame, keys: list[str], ridge: float = 1e-4) -> DataFrame:
    """w and sigma2 of each key: the ridge solution of its normal equations. One small solve a row."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                m = int(round(len(row.g) ** 0.5))
                full = np.asarray(row.g, float).reshape(m, m)
                g, b, q = full[:-1, :-1], full[:-1, -1], full[-1, -1]
                w = np.linalg.solve(g + ridge * row.n * np.eye(m - 1), b)
                out.append((*(getattr(row, k) for k in keys), w, max((q - 2 * w @ b + w @ g @ w) / row.n, 1e-8)))
            yield pd.DataFrame(out, columns=[*keys, "w", "sigma2"])

    kinds = ", ".join(f"`{k}` {dict(stats.dtypes)[k]}" for k in keys)
    return stats.mapInPandas(solve, f"{kinds}, w array<double>, sigma2 double")


def ar_score(series: DataFrame, models: DataFrame, keys: list[str], p: int = 32, value: str = "x") -> DataFrame:
    """score: squared one-step error over the model's error variance; 0 for the first p points."""
    lagged = framed(series, p, 0, {"__w": lambda w: F.collect_list(value).over(w.rowsBetween(-p, -1))}).join(models, keys)
    guess = F.aggregate(F.zip_with(F.reverse("__w"), "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    error = F.pow(F.col(value) - guess, 2) / F.col("sigma2")
    return lagged.withColumn("score", F.when(F.size("__w") == p, error).otherwise(0.0)).drop("__w", "w", "sigma2")


def subspace_models(stats: DataFrame, keys: list[str], top: int = 8, shrink: float = 0.05) -> DataFrame:
    """From window moments: the mean, the projector off the top principal directions, and the whitening matrix of the shrunk covariance."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                mu = np.asarray(row.s, float) / row.n
                m = len(mu)
                cov = np.asarray(row.g, float).reshape(m, m) / row.n - np.outer(mu, mu)
                _, v = np.linalg.eigh(cov)
                v = v[:, -min(top, m):]
                e, u = np.linalg.eigh((1 - shrink) * cov + shrink * np.trace(cov) / m * np.eye(m))
                white = (u / np.sqrt(np.maximum(e, 1e-12))) @ u.T
                out.append((*(getattr(row, k) for k in keys), mu, (np.eye(m) - v @ v.T).ravel(), white.ravel()))
            yield pd.DataFrame(out, columns=[*keys, "mu", "residual", "white"])

    kinds = ", ".join(f"`{k}` {dict(stats.dtypes)[k]}" for k in keys)
    return stats.mapInPandas(solve, f"{kinds}, mu array<double>, residual array<double>, white array<double>")


def apply_matrix(windows: DataFrame, models: DataFrame, keys: list[str], matrix: str, t: str = "w_start", chunk: int = 1 << 14) -> DataFrame:
    """windows with r: the squares of (w - mu) times the model's matrix, in numpy. A model goes once to each chunk of its key: of steps t, or by the windows' hash where there is no t."""
    schema = windows.withColumn("r", F.array(F.lit(0.0))).schema
    names = windows.columns

    def run(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if own.empty or model.empty:
            return pd.DataFrame(columns=[*names, "r"])
        mu = np.asarray(model.iloc[0]["mu"], float)
        x = (np.stack(own["w"].to_numpy()) - mu) @ np.asarray(model.iloc[0][matrix], float).reshape(len(mu), len(mu))
        return own[names].assign(r=list(x * x))

    dealt = windows.withColumn("__chunk", F.floor(F.col(t) / chunk) if t in names else F.pmod(F.xxhash64("w"), F.lit(256)))
    each = dealt.select(*keys, "__chunk").distinct().join(models.select(*keys, "mu", matrix), keys)
    by = [F.col(c).alias(f"__of_{c}") for c in (*keys, "__chunk")]
    one = each.select(*by, "mu", matrix).groupBy(*(f"__of_{c}" for c in (*keys, "__chunk")))
    return dealt.groupBy(*keys, "__chunk").cogroup(one).applyInPandas(run, schema)


# -- assembly ------------------------------------------------------------------------------------------


def coverage(t: Column, length: Column, width: int, stride: int) -> Column:
    """How many windows of a series hold step t."""
    last = F.floor(F.least(t, length - width) / stride)
    first = F.ceil(F.greatest(F.lit(0), t - width + 1) / stride)
    return F.when(length >= width, F.greatest(last - first + 1, F.lit(0))).otherwise(F.lit(0)).cast("long")


def assemble(scored: DataFrame, width: int, stride: int, mode: str = "mean_coverage") -> DataFrame:
    """Rolling scores: the sum over the windows that hold a point, or that over their number; uncovered points are filled
    forward, leading ones from the first covered. Series without a window go."""
    n = scored.groupBy(*KEYS).agg(F.count("*").alias("__n"))
    held = scored.join(n, KEYS).where(F.col("__n") >= width).withColumn("cov", coverage(F.col("t"), F.col("__n"), width, stride))
    raw = F.when(F.col("cov") > 0, F.col("score") * (F.col("cov") if mode == "sum" else F.lit(1.0)))
    reach = width + stride
    filled = framed(
        held.withColumn("__s", raw), reach, reach,
        {"__b": lambda w: F.last("__s", True).over(w.rowsBetween(-reach, 0)), "__a": lambda w: F.first("__s", True).over(w.rowsBetween(0, reach))},
    )
    return filled.withColumn("score", F.coalesce("__b", "__a")).drop("__s", "__a", "__b", "__n")


def overlap_add(windows: DataFrame, values: str = "r") -> DataFrame:
    """The sum of window scores on each step, and how many windows hold it."""
    each = windows.select(*KEYS, "w_start", F.posexplode(values).alias("k", "s"))
    return each.groupBy(*KEYS, (F.col("w_start") + F.col("k")).alias("t")).agg(F.sum("s").alias("score"), F.count("*").alias("cov"))


def impulse(scored: DataFrame, width: int) -> DataFrame:
    """Half the score, half its centred average."""
    return centred_average(scored, width, "__m", "score").withColumn("score", 0.5 * (F.col("score") + F.col("__m"))).drop("__m")


def channel_aggregates(scores: DataFrame, keys: list[str], top: int = 2, q: float = 0.9, trim: float = 0.2, p: float = 3.0, above: float = 1.0) -> DataFrame:
    """All channel aggregations of a step's scores, a column each. Channels of a step are few, so their sorted array is small."""
    s = F.col("s")
    n = F.size(s)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    cut = F.floor(n * trim).cast("int")
    edge_low, edge_high = F.element_at(s, cut + 1), F.element_at(s, n - cut)
    highest = F.array_max(s)
    weights = F.transform(s, lambda x: F.exp(x - highest))
    out = {
        "mean": total(s) / n, "max": highest, "sum": total(s), "median": F.col("mid"), "rms": F.sqrt(total(F.transform(s, lambda x: x * x)) / n),
        "l2": F.sqrt(total(F.transform(s, lambda x: x * x))), "lp_norm": F.pow(total(F.transform(s, lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1 / p)),
        "logsumexp": highest + F.log(total(weights)), "topk": total(F.slice(F.reverse(s), 1, top)) / F.least(n, F.lit(top)), "quantile": F.col("high"),
        "trimmed_mean": total(F.slice(s, cut + 1, n - 2 * cut)) / (n - 2 * cut),
        "winsorized_mean": total(F.transform(s, lambda x: F.least(F.greatest(x, edge_low), edge_high))) / n,
        "softmax": total(F.zip_with(s, weights, lambda a, b: a * b)) / total(weights), "mean_max_mix": 0.5 * (total(s) / n + highest),
        "fraction_above": F.size(F.filter(s, lambda x: x > above)) / n,
    }
    sets = scores.groupBy(*keys).agg(F.array_sort(F.collect_list("score")).alias("s"), F.percentile("score", F.lit(0.5)).alias("mid"), F.percentile("score", F.lit(q)).alias("high"))
    return sets.select(*keys, *(c.alias(k) for k, c in out.items()))


# -- thresholds ----------------------------------------------------------------------------------------


def quantile_threshold(scores: DataFrame, keys: list[str], q: float) -> DataFrame:
    """thr by key: the exact quantile with linear interpolation."""
    return quantiles(scores, keys, "score", {"thr": q})


def predict(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    return scores.join(thresholds.select(*keys, "thr"), keys).withColumn("pred", (F.col("score") > F.col("thr")).cast("int"))


def grid_threshold(scores: DataFrame, keys: list[str], points: int = 400) -> DataFrame:
    """thr and f1: the first best of a linear grid between each key's lowest and highest score.

    Scores are counted by the number of grid points below them, so the grid is not joined to the points.
    """
    ends = scores.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("label").alias("pos"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = ends.select(*keys, "pos", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("lo") + k * step)).alias("k", "thr"))
    guess = F.when(step > 0, F.least(F.greatest(F.ceil((F.col("score") - F.col("lo")) / step), F.lit(0)), F.lit(points))).otherwise(0)
    below = scores.join(ends, keys).withColumn("b", guess)
    at = lambda k: F.col("lo") + k * step
    exact = F.when((F.col("b") > 0) & (at(F.col("b") - 1) >= F.col("score")), F.col("b") - 1).when((F.col("b") < points) & (at(F.col("b")) < F.col("score")), F.col("b") + 1).otherwise(F.col("b"))
    bins = below.withColumn("b", exact).groupBy(*keys, "b").agg(F.sum("label").alias("tp"), F.count("*").alias("n"))
    counted = grid.join(bins.withColumn("k", (F.col("b") - 1).cast("int")).drop("b"), [*keys, "k"], "left").fillna(0, ["tp", "n"])
    above = W.partitionBy(*keys).orderBy(F.desc("k"))
    f1 = counted.withColumns({"tp": F.sum("tp").over(above), "n": F.sum("n").over(above)}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n") + F.col("pos")), F.lit(0.0)))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("f1"), "k"))
    return f1.withColumn("r", best).where("r = 1").select(*keys, "thr", "f1")



#: The shares of points, in percent, that ratio_threshold tries in this order.
RATIOS = (0.1, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 15.0, 20.0, 25.0)


def ratio_threshold(scores: DataFrame, keys: list[str], ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """thr, ratio and f1: the first best of the quantiles that leave each share of the points above them."""
    names = [f"q{k}" for k in range(len(ratios))]
    cut = quantiles(scores, keys, "score", {n: 1 - r / 100 for n, r in zip(names, ratios, strict=True)}).select(*keys, F.array(*names).alias("q"))
    cuts = cut.join(scores.groupBy(*keys).agg(F.sum("label").alias("pos")), keys)
    above = lambda k: F.col("score") > F.get("q", F.lit(k))
    counted = scores.join(cuts, keys).groupBy(*keys, "pos", "q").agg(
        F.array(*(F.struct(F.count_if(above(k)).alias("n"), F.sum(F.when(above(k), F.col("label")).otherwise(0)).alias("tp")) for k in range(len(ratios)))).alias("c")
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("c.tp"), F.col("c.n") + F.col("pos")), F.lit(0.0))
    each = counted.select(*keys, "pos", "q", F.posexplode("c").alias("k", "c")).select(*keys, "k", F.get("q", F.col("k")).alias("thr"), f1.alias("f1"))
    return each.groupBy(*keys).agg(F.max_by(F.struct("thr", "k", "f1"), F.struct("f1", -F.col("k"))).alias("b")).select(
        *keys, "b.thr", F.get(F.array(*(F.lit(r) for r in ratios)), F.col("b.k")).alias("ratio"), "b.f1"
    )


def base_rate_threshold(scores: DataFrame, keys: list[str]) -> DataFrame:
    """thr: the quantile of the scores at one minus the share of labelled points, between the two order statistics next to it."""
    size = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("label").alias("rate"))
    counts = scores.groupBy(*keys, "score").agg(F.count("*").alias("c"))
    upto = value_sums(counts, keys, "score", {"hi": F.col("c")}).join(size, keys)
    place = (1 - F.col("rate")) * (F.col("n") - 1)
    holds = lambda k: F.max(F.when((F.col("hi") - F.col("c") <= k) & (k < F.col("hi")), F.col("score")))
    ends = upto.groupBy(*keys, "n", "rate").agg(holds(F.floor(place)).alias("a"), holds(F.ceil(place)).alias("b"))
    return ends.select(*keys, "rate", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("thr"))


def frozen_thresholds(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """f1 of each entity under the threshold of each source in its cluster.

    Points are counted by how many of the cluster's thresholds they pass, so they are not multiplied by the sources.
    """
    ranked = thresholds.withColumn("b", F.row_number().over(W.partitionBy("cluster").orderBy("thr", "source")))
    steps = ranked.groupBy("cluster").agg(F.array_sort(F.collect_list("thr")).alias("__q"))
    passed = F.size(F.filter("__q", lambda q: q < F.col("score")))
    bins = scores.join(steps, "cluster").groupBy("cluster", F.col("entity").alias("target"), passed.alias("b")).agg(F.count("*").alias("n"), F.sum("label").alias("tp"))
    total = bins.groupBy("cluster", "target").agg(F.sum("tp").alias("pos"))
    above = W.partitionBy("target").orderBy(F.desc("b"))
    grid = total.join(ranked, "cluster").join(bins, ["cluster", "target", "b"], "left").fillna(0, ["n", "tp"])
    counted = grid.withColumns({"n": F.sum("n").over(above), "tp": F.sum("tp").over(above)})
    return counted.select("source", "target", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n") + F.col("pos")), F.lit(0.0)).alias("f1"))

# -- metrics -------------------------------------------------------------------------------------------


def confusion(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and the usual rates; divisions by zero give 0."""
    on = lambda p, y: F.sum(((F.col("pred") == p) & (F.col("label") == y)).cast("long"))
    c = predicted.groupBy(*keys).agg(on(1, 1).alias("tp"), on(1, 0).alias("fp"), on(0, 1).alias("fn"), on(0, 0).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn),
        "accuracy": share(tp + tn, tp + fp + fn + tn), "fpr": share(fp, fp + tn),
    })


def point_adjust(points: DataFrame, column: str) -> DataFrame:
    """points with column raised to its maximum over the labelled segment that a point is in."""
    inside = runs(points, F.col("label") == 1)
    tops = inside.groupBy(*KEYS, "run_id").agg(F.max(column).alias("__top"))
    raised = inside.select(*KEYS, "t", "run_id").join(tops, [*KEYS, "run_id"]).drop("run_id")
    return points.join(raised, [*KEYS, "t"], "left").withColumn(column, F.coalesce("__top", column)).drop("__top")


def auroc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve from average ranks; null where a class is missing."""
    ranked = average_rank(scores, keys, "score", "__r")
    pos = F.sum("label")
    neg = F.count("*") - pos
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("label") == 1, F.col("__r"))) - pos * (pos + 1) / 2, pos * neg).alias("auroc"))


def pr_curve(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall at each distinct score, with the recall gained there."""
    steps = scores.groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    run = value_sums(steps, keys, "score", {"tp": F.col("pos"), "seen": F.col("n")}, falling=True).join(scores.groupBy(*keys).agg(F.sum("label").alias("all")), keys)
    return run.withColumns({"precision": F.col("tp") / F.col("seen"), "recall": F.try_divide("tp", "all"), "gain": F.try_divide("pos", "all")})


def auprc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision (a step function), and the best F1 on the curve with its threshold."""
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return pr_curve(scores, keys).withColumn("f1", f1).groupBy(*keys).agg(
        F.sum(F.col("gain") * F.col("precision")).alias("auprc"), F.max("f1").alias("best_f1"), F.max_by("score", F.struct("f1", "score")).alias("best_thr")
    )


def event_overlap(truth: DataFrame, found: DataFrame, keys: list[str], step: int = 1024) -> DataFrame:
    """Event precision, recall and F1: an event counts where any event of the other side overlaps it; 0 where there are none.

    Events meet in buckets of the time axis: those of a side are disjoint, so a bucket holds at most `step` of them.
    """
    t, p = truth.select(*keys, F.col("start").alias("a"), F.col("stop").alias("b")), found.select(*keys, F.col("start").alias("c"), F.col("stop").alias("d"))
    dealt = lambda df, lo, hi: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))))
    meet = dealt(t, "a", "b").join(dealt(p, "c", "d"), [*keys, "__b"]).where("a <= d and c <= b")
    n_t, n_p = t.groupBy(*keys).agg(F.count("*").alias("n_true")), p.groupBy(*keys).agg(F.count("*").alias("n_pred"))
    hits = meet.groupBy(*keys).agg(F.count_distinct("a").alias("hit_true"), F.count_distinct("c").alias("hit_pred"))
    both = n_t.join(n_p, keys, "full").join(hits, keys, "left").fillna(0)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    precision, recall = share("hit_pred", "n_pred"), share("hit_true", "n_true")
    return both.withColumns({"precision": precision, "recall": recall, "f1": F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))})


def detection_delay(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Mean delay of the first hit in each labelled segment; a missed one counts its length."""
    inside = runs(predicted, F.col("label") == 1)
    hit = F.min(F.when(F.col("pred") == 1, F.col("t"))) - F.min("t")
    each = inside.groupBy(*KEYS, "run_id").agg(F.coalesce(hit, F.count("*")).alias("delay"), hit.isNotNull().cast("long").alias("found"))
    return each.groupBy(*keys).agg(F.avg("delay").alias("mean_delay"), F.sum("found").alias("found"), F.count("*").alias("n_segments"))


def score_extremes(points: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """top1: whether the highest score (the first of equals) lies within tolerance of a labelled point; null without any."""
    best = points.groupBy(*keys).agg(F.max_by("t", F.struct("score", -F.col("t"))).alias("t_top"), F.max("label").alias("any"))
    marks = points.where("label = 1").select(*keys, F.col("t").alias("m"))
    near = best.join(marks, keys, "left").groupBy(*keys, "t_top", "any").agg(F.min(F.abs(F.col("m") - F.col("t_top"))).alias("gap"))
    return near.select(*keys, "t_top", F.when(F.col("any") == 1, (F.col("gap") <= tolerance).cast("int")).alias("top1"))
