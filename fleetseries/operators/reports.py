"""Report reducers and paired statistics over long tables of records."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import settled, value_sums
from fleetseries.operators.prep import average_rank


def micro_mean(records: DataFrame) -> DataFrame:
    """Mean by arm and by arm and cluster; the cluster of a whole arm is null."""
    return records.groupingSets([["arm"], ["arm", "cluster"]], "arm", "cluster").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def two_level(records: DataFrame) -> DataFrame:
    """Mean within a seed, then mean and sample deviation over seeds (0 for one seed), and the mean of each seed's worst entity."""
    seeds = records.groupBy("arm", "seed").agg(F.avg("value").alias("m"), F.min("value").alias("worst"))
    return seeds.groupBy("arm").agg(F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd"), F.avg("worst").alias("worst"), F.count("*").alias("n_seeds"))


def pairs(records: DataFrame, a: str, b: str) -> DataFrame:
    """Both arms' values by seed and entity, with a status: matched, only_a or only_b."""
    left = records.where(F.col("arm") == a).select("seed", "entity", F.col("value").alias("va"))
    right = records.where(F.col("arm") == b).select("seed", "entity", F.col("value").alias("vb"))
    status = F.when(F.col("va").isNull(), "only_b").when(F.col("vb").isNull(), "only_a").otherwise("matched")
    return left.join(right, ["seed", "entity"], "full").withColumn("status", status)


def contrast(matched: DataFrame) -> DataFrame:
    """Mean and deviation of the paired differences, wins, losses and ties."""
    d = F.col("va") - F.col("vb")
    return matched.where("status = 'matched'").agg(
        F.count("*").alias("n"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"),
        F.count_if(d == 0).alias("ties"), F.percentile(d, F.lit(0.5)).alias("median_delta"),
        (1.96 * F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("ci95"), (2.8 * F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("m80"),
    )


def wilcoxon(matched: DataFrame, least: int = 6) -> DataFrame:
    """Signed-rank statistic and z by the normal approximation with tie correction; zeros go, fewer than `least` give null."""
    d = matched.where("status = 'matched'").select((F.col("va") - F.col("vb")).alias("d")).where("d <> 0")
    ranked = average_rank(d.withColumn("g", F.lit(0)).withColumn("a", F.abs("d")), ["g"], "a", "r")
    ties = ranked.groupBy("g", "a").agg(F.count("*").alias("m")).groupBy("g").agg(F.sum(F.pow("m", 3) - F.col("m")).alias("tie"))
    sums = ranked.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    z = F.when(n >= least, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var))
    return sums.join(ties, "g").select("n", "w_plus", z.alias("z"))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """The two-sided sign test's p: twice the smaller tail of a fair binomial, 1 at most."""
    low = F.least(k, n - k)
    log_factorial = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i))
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * F.log(F.lit(2.0)))
    tail = F.aggregate(F.sequence(F.lit(0), low.cast("int")), F.lit(0.0), lambda a, i: a + term(i))
    return F.least(F.lit(1.0), 2 * tail)


def sign_test(matched: DataFrame) -> DataFrame:
    d = F.col("va") - F.col("vb")
    c = matched.where("status = 'matched'").agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    return c.withColumn("p", binomial_two_sided(F.col("wins"), F.col("wins") + F.col("losses")))


#: Means that are looked at one by one at the end, and cuts that a range is split by in one round.
FEW, CUTS = 4096, 64


def hodges_lehmann(matched: DataFrame, few: int = FEW) -> DataFrame:
    """(hl, n_walsh): the median of the means of all pairs of differences, each with itself included; null without any.

    The means are never written out. How many lie at or below a value is counted from running counts of the sorted
    differences, for CUTS values at once; the range that holds the median shrinks by that factor a round until it holds
    `few` means at most, or no number between its ends. Only those pairs are made, by stretches as wide as the range.
    """
    d = matched.where("status = 'matched'").select((F.col("va") - F.col("vb")).alias("d")).where("d IS NOT NULL")
    counts = settled(d.groupBy("d").agg(F.count("*").alias("c")))
    ends = counts.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("c").alias("n")).first()
    n = ends.n or 0
    total, spark = n * (n + 1) // 2, matched.sparkSession
    if not n:
        return spark.createDataFrame([(None, 0)], "hl double, n_walsh long")
    first, last = (total + 1) // 2, total // 2 + 1
    # low lies below the median and high does not; below counts the means at or below low
    low, high, below, upto = np.nextafter(ends.lo, -np.inf), ends.hi, 0, total
    while upto - below > few:
        # with zero and what is next below it: a range closes in on any other value within the digits of a number, on zero never
        cuts = {float(x) for x in np.linspace(low, high, CUTS + 1)[1:-1]} | {float(x) for x in (0.0, np.nextafter(0.0, -1.0)) if low < x < high}
        cuts = sorted(cuts - {low, high})
        if not cuts:
            break
        found = walsh_counts(counts, cuts)
        known = (low, high)
        low, below = max(((x, k) for x, k in zip(cuts, found, strict=True) if k < first), default=(low, below))
        high, upto = min(((x, k) for x, k in zip(cuts, found, strict=True) if k >= last), default=(high, upto))
        if known == (low, high):
            break  # the two middle means are on both sides of all cuts
    slack = 8 * np.finfo(float).eps * max(abs(ends.lo), abs(ends.hi))  # counting works out 2 x - d, which may be rounded
    if slack:
        low, high = float(low - slack), float(high + slack)
        below = walsh_counts(counts, [low])[0]
    inside = walsh_inside(counts, low, high).withColumn("one", F.lit(0))
    upper = settled(value_sums(inside, ["one"], "w", {"k": F.col("c")}))
    middle = lambda rank: F.min(F.when(F.col("k") + below >= rank, F.col("w")))
    return upper.agg(((middle(first) + middle(last)) / 2).alias("hl"), F.lit(total).cast("long").alias("n_walsh"))


def walsh_counts(counts: DataFrame, cuts: list[float]) -> list[int]:
    """How many means of pairs of counts(d, c) are at or below each cut: ordered pairs from running counts, and those of a value with itself."""
    cut = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(cuts)))).alias("e")
    asked = counts.select(cut, "c", "d").select("e.i", (2 * F.col("e.x") - F.col("d")).alias("v"), F.lit(0).alias("here"), F.col("c").alias("asks"))
    held = counts.select(cut, "c", "d").select("e.i", F.col("d").alias("v"), F.col("c").alias("here"), F.lit(0).alias("asks"))
    places = held.unionByName(asked).groupBy("i", "v").agg(F.sum("here").alias("here"), F.sum("asks").alias("asks"))
    pairs = value_sums(places, ["i"], "v", {"upto": F.col("here")}).groupBy("i").agg(F.sum(F.col("asks") * F.col("upto")).alias("pairs"))
    alone = counts.select(cut, "c", "d").where("d <= e.x").groupBy("e.i").agg(F.sum("c").alias("alone"))
    rows = {r.i: (r.pairs + (r.alone or 0)) // 2 for r in pairs.join(alone, "i", "left").collect()}  # a row a cut
    return [rows[i] for i in range(len(cuts))]


def walsh_inside(counts: DataFrame, low: float, high: float) -> DataFrame:
    """(w, c): the means above low, to high, and how often each occurs. Differences meet in stretches of twice the range."""
    wide = max(2 * (high - low), 1e-300)
    a = counts.select(F.col("d").alias("x"), F.col("c").alias("cx"), F.explode(F.sequence(F.floor((2 * low - F.col("d")) / wide), F.floor((2 * high - F.col("d")) / wide))).alias("b"))
    met = a.join(counts.select(F.col("d").alias("y"), F.col("c").alias("cy"), F.floor(F.col("d") / wide).alias("b")), "b").where("x <= y")
    mean = met.withColumn("w", (F.col("x") + F.col("y")) / 2).where((F.col("w") > low) & (F.col("w") <= high))
    pairs = F.when(F.col("x") < F.col("y"), F.col("cx") * F.col("cy")).otherwise(F.expr("cx * (cx + 1) div 2"))
    return mean.groupBy("w").agg(F.sum(pairs).alias("c"))


# -- equivalence ---------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0: Stirling's series eight steps up."""

    def body(z: Column) -> Column:
        tail = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
        product = (z - 1) * (z - 2) * (z - 3) * (z - 4) * (z - 5) * (z - 6) * (z - 7) * (z - 8)
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - F.log(product)

    return let(x + 8, body)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """The regularised incomplete beta function, by its continued fraction from the end up, on the side where that converges fast."""

    def up(s: Column) -> Callable[[Column, Column], Column]:
        p, q, y = s["p"], s["q"], s["y"]

        def term(tail: Column, m: Column) -> Column:
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            return F.when(m == 0, 1 + odd / tail).otherwise(1 + even / (1 + odd / tail))

        return term

    def value(s: Column) -> Column:
        p, q, y = s["p"], s["q"], s["y"]
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log(1 - y)) / p
        found = front / F.aggregate(F.transform(F.sequence(F.lit(steps), F.lit(0), F.lit(-1)), lambda m: m.cast("double")), F.lit(1.0), up(s))
        return F.when(s["swap"], 1 - found).otherwise(found)

    swap = x > (a + 1) / (a + b + 2)
    sides = let(F.struct(a.alias("a"), b.alias("b"), x.alias("x"), swap.alias("swap")), lambda s: F.struct(
        F.when(s["swap"], s["b"]).otherwise(s["a"]).alias("p"), F.when(s["swap"], s["a"]).otherwise(s["b"]).alias("q"),
        F.when(s["swap"], 1 - s["x"]).otherwise(s["x"]).alias("y"), s["swap"].alias("swap"),
    ))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(let(sides, value))


def student_upper(t: Column, freedom: Column) -> Column:
    """The chance that a Student variable of so many degrees of freedom is t or more."""
    tail = lambda s: 0.5 * incomplete_beta(s["v"] / 2, F.lit(0.5), s["v"] / (s["v"] + s["t"] * s["t"]))
    return let(F.struct(t.alias("t"), freedom.alias("v")), lambda s: let(tail(s), lambda p: F.when(s["t"] >= 0, p).otherwise(1 - p)))


def student_quantile(upper: float, freedom: Column, steps: int = 60) -> Column:
    """The t >= 0 that a Student variable reaches with the chance `upper` (0.5 at most), by bisection of t / (1 + t)."""
    value = lambda u: u / (1 - u)
    middle = lambda s: (s["lo"] + s["hi"]) / 2
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        over = let(student_upper(value(middle(s)), freedom), lambda p: p > upper)
        return let(F.struct(over.alias("over"), s["lo"].alias("lo"), s["hi"].alias("hi"), middle(s).alias("mid")), lambda r: F.struct(
            F.when(r["over"], r["mid"]).otherwise(r["lo"]).alias("lo"), F.when(r["over"], r["hi"]).otherwise(r["mid"]).alias("hi"),
        ))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halved), lambda s: value(middle(s)))


def equivalence(matched: DataFrame, margin: float, level: float = 0.05) -> DataFrame:
    """(n, delta, se, p_low, p_high, low, high, m80, verdict): two one-sided t tests that the mean difference is within the margin.

    p_low: of a mean of -margin or less, p_high: of margin or more; low and high: the interval of confidence 1 - 2 level,
    which lies within the margins just when both tests pass. A margin below m80 (2.8 standard errors) is too narrow for
    80 % power, and the verdict says so. Null figures for fewer than two pairs; differences without spread are judged as they are.
    """
    d = F.col("va") - F.col("vb")
    c = matched.where("status = 'matched'").agg(F.count(d).alias("n"), F.avg(d).alias("delta"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"))
    freedom = (F.col("n") - 1).cast("double")
    test = lambda t, flat: F.when(F.col("se") > 0, student_upper(t, freedom)).when(F.col("se") == 0, F.when(flat, 0.0).otherwise(1.0))
    made = c.withColumns({
        "p_low": test((F.col("delta") + margin) / F.col("se"), F.col("delta") > -margin),
        "p_high": test((margin - F.col("delta")) / F.col("se"), F.col("delta") < margin),
        "__w": F.when(F.col("se") == 0, 0.0).otherwise(F.col("se") * student_quantile(level, freedom)), "m80": 2.8 * F.col("se"),
    })
    passed = F.when(F.greatest("p_low", "p_high") < level, F.lit("equivalent")).when(F.col("se").isNotNull(), F.lit("not equivalent"))
    narrow = F.when(F.lit(margin) < F.col("m80"), F.concat(passed, F.lit(", underpowered"))).otherwise(passed)
    return made.select("n", "delta", "se", "p_low", "p_high", (F.col("delta") - F.col("__w")).alias("low"), (F.col("delta") + F.col("__w")).alias("high"), "m80", narrow.alias("verdict"))


def flat_entities(records: DataFrame) -> DataFrame:
    """Entities on which the arms do not differ, by range."""
    return records.groupBy("entity").agg((F.max("value") - F.min("value")).alias("spread"), (F.max("value") - F.min("value") < 1e-9).cast("int").alias("flat"))


def best_arm(records: DataFrame) -> DataFrame:
    """The best arm of each entity, where all arms are there; the first by name of equals."""
    n = records.select("arm").distinct().agg(F.count("*").alias("n_arms"))  # one number
    each = records.groupBy("entity", "arm").agg(F.avg("value").alias("value"))
    best = each.groupBy("entity").agg(F.max("value").alias("best"), F.count("*").alias("c"))
    named = each.join(best, "entity").where("value = best").groupBy("entity", "best", "c").agg(F.min("arm").alias("arm"))
    return named.crossJoin(F.broadcast(n)).where("c = n_arms").select("entity", "arm", "best")


def spread(records: DataFrame) -> DataFrame:
    """Mean, median, deviation (population), extremes, count and MAD of each arm."""
    mid = records.groupBy("arm").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    return records.join(mid, "arm").groupBy("arm", "median").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"),
        F.percentile(F.abs(F.col("value") - F.col("median")), F.lit(0.5)).alias("mad"),
    )
