"""Quality rules and robust multivariate outliers, with DataFrame functions alone.

Base rules reject short and self-repeating texts. The statistics of the rest, transformed to roughly symmetric
scales, are judged by a minimum covariance determinant (MCD) estimate per language and source: concentration steps
take the HALF of a group's rows nearest to the present centre and scatter, and fit these again, from three
deterministic starts; the start whose scatter has the least determinant goes on. A row is rejected where its squared
Mahalanobis distance, made consistent for normal data, passes CUTOFF. FLOORS are added to the scatter's diagonal (as
squares), so that statistics that are all but constant do not reject small departures.

Every step is one aggregate over all rows: equal vectors are counted once with their weight, quantiles come from
histograms of fixed steps, and the nearest rows are taken by whole histogram bins of the distance's logarithm. A
group has at most a few thousand bins however many rows it has, and no key's rows have to meet in one task.

Estimates are made for each language and source, for each language, and for all rows. A language's sums gain those of
all rows at the weight of PRIOR rows, and a language and source's gain those of its language likewise. So each row is
judged by its own group, which counts the more the more rows it has; there is no size at which the rule changes.

Cases: a null text has no words and fails the base; a null language or source is a group of its own; repeated rows
each come back; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.llm.common import SPACE, cut, let

WINDOW = 8
HALF, PRIOR, STEPS_ALL, STEPS_BEST = 0.75, 100, 2, 3
FLOORS = (0.5, 0.12, 0.12, 0.06, 0.12)
DIMS = len(FLOORS)
#: Bins of a histogram of values, and of logarithms of distances, in one unit.
VALUE_BINS, DISTANCE_BINS = 64, 16
WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"
WORD_CHAR = "[^ \\t\\n\\x0B\\f\\r]"


def chi2_cdf(x: float, k: int) -> float:
    """The chi-squared distribution function, by the series of the incomplete gamma function."""
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= half / n
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


#: The share of normal data beyond it is 1e-4.
CUTOFF = chi2_quantile(1 - 1e-4, DIMS)
#: A normal sample's nearest HALF has a scatter smaller by this factor.
CONSISTENT = HALF / chi2_cdf(chi2_quantile(HALF, DIMS), DIMS + 2)


def repeat_words(words: Column) -> Column:
    """The number of words in windows of WINDOW words that the text has twice or more.

    Windows are compared by XXH64 of their words. Texts without an equal pair stop there; in the others equal windows
    are neighbours after sorting, and the words under them are counted from their sorted places.
    """

    def under(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twin = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(pairs, places), covered)).otherwise(F.lit(0))

    def windows(h: Column) -> Column:  # by index: slice() would copy the whole array for each window
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= WINDOW, let(hashed, lambda h: let(windows(h), under))).otherwise(F.lit(0))


def statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, lang, source, the base statistics of every whole text, and more."""
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP, -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR))
    stats = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return docs.select(
        "doc_id", "lang", "source", stats.alias("s"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), *more,
    ).select("*", "s.n_words", "s.word_chars", "s.n_repeat_words").drop("s")


def failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """The statistics on roughly symmetric scales: length, word length, and the roots of three shares."""
    n = F.greatest("n_words", F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(F.greatest("word_chars", F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


X = [f"x{k}" for k in range(DIMS)]
MU = [f"mu{k}" for k in range(DIMS)]
LOW = [(i, j) for i in range(DIMS) for j in range(i + 1)]


SUMS = ["n", *(f"t{k}" for k in range(DIMS)), *(f"p{i}{j}" for i, j in LOW)]
#: A group's name begins with its level: language and source, language, all.
LEVELS = ("s", "l", "*")


def quantiles(cells: DataFrame) -> DataFrame:
    """g, mu (medians) and s (spreads, from quartiles) of each group's vectors, from histograms."""
    long = cells.select("g", "n", F.posexplode(F.array(*X)).alias("j", "v"))
    bins = long.groupBy("g", "j", F.floor(F.col("v") * VALUE_BINS).alias("b")).agg(F.sum("n").alias("n"))
    upto = W.partitionBy("g", "j").orderBy("b")
    ranked = bins.withColumn("c", F.sum("n").over(upto)).withColumn("t", F.sum("n").over(W.partitionBy("g", "j")))
    at = lambda q: (F.min(F.when(F.col("c") >= q * F.col("t"), F.col("b"))) + 0.5) / VALUE_BINS
    by_dim = ranked.groupBy("g", "j").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    pick = lambda k, c: F.max(F.when(F.col("j") == k, c))
    return by_dim.groupBy("g").agg(
        *(pick(k, F.col("mid")).alias(MU[k]) for k in range(DIMS)),
        *(F.greatest(pick(k, (F.col("hi") - F.col("lo")) / 1.349), F.lit(FLOORS[k])).alias(f"s{k}") for k in range(DIMS)),
    )


def distance() -> Column:
    """The squared Mahalanobis distance of x by mu and the Cholesky factor l, by forward substitution."""
    z: list[Column] = []
    for i in range(DIMS):
        rest = F.col(X[i]) - F.col(MU[i])
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def shape(sums: DataFrame) -> DataFrame:
    """sums with centre, Cholesky factor and log determinant of the rows that they count."""
    fit = sums
    for k in range(DIMS):
        fit = fit.withColumn(MU[k], F.col(f"t{k}") / F.col("n"))
    for i, j in LOW:
        spread = F.col(f"p{i}{j}") / F.col("n") - F.col(MU[i]) * F.col(MU[j])
        fit = fit.withColumn(f"a{i}{j}", F.greatest(spread, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else spread)
    for i, j in LOW:
        rest = F.col(f"a{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        fit = fit.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-8))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = sum((F.log(f"l{i}{i}") for i in range(1, DIMS)), F.log("l00"))
    return fit.withColumn("log_det", 2 * log_det).drop(*(f"a{i}{j}" for i, j in LOW))


def refit(measured: DataFrame) -> DataFrame:
    """The sums and shape of the nearest HALF of each group and start; measured has g, start, n, x and d2."""
    sums = [F.sum("n").alias("n")] + [F.sum(F.col("n") * F.col(x)).alias(f"t{k}") for k, x in enumerate(X)]
    sums += [F.sum(F.col("n") * F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in LOW]
    bins = measured.groupBy("g", "start", F.floor(F.log(F.col("d2") + 1e-9) * DISTANCE_BINS).alias("b")).agg(*sums)
    whole = W.partitionBy("g", "start")
    near = bins.withColumn("c", F.sum("n").over(whole.orderBy("b")) - F.col("n")).withColumn("t", F.sum("n").over(whole))
    near = near.where(F.col("c") < F.ceil(HALF * F.col("t")))  # bins before the one that fills HALF, and that one
    return shape(near.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in SUMS)))


def estimates(cells: DataFrame) -> DataFrame:
    """The MCD estimate of each group of cells(g, x, n), with the sums of the rows that it rests on."""
    begun = cells.join(cut(quantiles(cells), "quality-quantiles"), "g")
    z = [F.abs(F.col(x) - F.col(m)) / F.col(f"s{k}") for k, (x, m) in enumerate(zip(X, MU, strict=True))]
    square = sum((v * v for v in z[1:]), z[0] * z[0])
    starts = F.array(square, F.pow(F.greatest(*z), F.lit(2.0)), sum(z[1:], z[0]))  # round, square and pointed neighbourhoods
    fit = cut(refit(begun.select("g", "n", *X, F.posexplode(starts).alias("start", "d2"))), "mcd")
    for step in range(STEPS_ALL + STEPS_BEST):
        if step == STEPS_ALL:
            best = F.row_number().over(W.partitionBy("g").orderBy("log_det", "start"))  # a handful of starts a group
            fit = cut(fit.withColumn("k", best).where("k = 1").drop("k"), "mcd-best")
        placed = fit.drop(*SUMS, "log_det")
        fit = cut(refit(cells.join(placed, "g").withColumn("d2", distance())), "mcd")
    return fit.select("g", *SUMS)


def limits(cells: DataFrame) -> DataFrame:
    """(ls, centre, Cholesky factor) of each language and source of cells(ls, l, x, n), upheld by its language's and all rows' sums."""
    names = F.array(*(F.concat(F.lit(level), name) for level, name in zip(LEVELS, ("ls", "l", F.lit("")), strict=True)))
    levels = cells.select(F.explode(names).alias("g"), "n", *X).groupBy("g", *X).agg(F.sum("n").alias("n"))
    fits = estimates(cut(levels, "quality-levels"))
    held = cells.select("ls", "l").distinct().select("ls", *(F.get(names, i).alias(f"g{i}") for i in range(len(LEVELS))))
    for i in range(len(LEVELS)):
        held = held.join(fits.select(F.col("g").alias(f"g{i}"), F.struct(*SUMS).alias(f"f{i}")), f"g{i}")
    upper = {c: F.col(f"f2.{c}") for c in SUMS}
    for i in (1, 0):
        share = PRIOR / upper["n"]
        upper = {c: F.col(f"f{i}.{c}") + share * v for c, v in upper.items()}
        held = held.select("*", F.struct(*(v.alias(c) for c, v in upper.items())).alias(f"h{i}"))
        upper = {c: F.col(f"h{i}.{c}") for c in SUMS}
    return shape(held.select("ls", "h0.*")).select("ls", *MU, *(f"l{i}{j}" for i, j in LOW))


def judged(stats: DataFrame) -> DataFrame:
    """stats with base_failed, kept and distance2, the robust distance (null where the base rules reject)."""
    named = stats.withColumn("ls", F.to_json(F.struct("lang", "source"))).withColumn("l", F.to_json(F.struct("lang")))
    for x, v in zip(X, vector(), strict=True):
        named = named.withColumn(x, v)
    cells = cut(named.where(~failed()).groupBy("ls", "l", *X).agg(F.count("*").alias("n")), "quality-cells")
    d2 = F.when(~failed(), distance() / CONSISTENT)
    return named.join(cut(limits(cells), "quality-limits"), "ls", "left").select(
        *stats.columns, failed().alias("base_failed"), (~failed() & F.coalesce(d2 <= CUTOFF, F.lit(False))).alias("kept"), F.round(d2, 6).alias("distance2")
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the robust distance (null where the base rules reject) of every document."""
    return judged(cut(statistics(docs), "quality-statistics")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"
    )


def keep(docs: DataFrame) -> DataFrame:
    """docs without the rows that judge rejects. Each row is written beside its statistics and judged there, whatever its doc_id."""
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("__doc")
    return judged(cut(statistics(docs, whole), "quality-documents")).where("kept").select("__doc.*")
