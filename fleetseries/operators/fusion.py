"""Several scorers of one series: fused scores, and what fusing gains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.functions.frames import correlation

from fleetseries.operators.detect import auprc
from fleetseries.operators.prep import average_rank


def long_scores(wide: DataFrame, heads: list[str]) -> DataFrame:
    """(entity, t, label, head, score) from one column a head."""
    return wide.unpivot(["entity", "t", "label"], heads, "head", "score")


def standardised(long: DataFrame) -> DataFrame:
    """long with z (population deviation, 1 where it is 0) and f, the average rank over the number of points."""
    stats = long.groupBy("entity", "head").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count("*").alias("n"))
    ranked = average_rank(long, ["entity", "head"], "score", "r").join(stats, ["entity", "head"])
    z = (F.col("score") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0))
    return ranked.select("entity", "t", "label", "head", "score", z.alias("z"), (F.col("r") / F.col("n")).alias("f"))


def fuse(scores: DataFrame) -> DataFrame:
    """By step: mean, median and trimmed (without least and greatest, of three or more) z, and mean rank, over the scorers."""
    g = scores.groupBy("entity", "t", "label").agg(F.array_sort(F.collect_list("z")).alias("s"), F.avg("z").alias("mean_z"), F.percentile("z", F.lit(0.5)).alias("median_z"), F.avg("f").alias("mean_rank"))
    n = F.size("s")
    inner = F.aggregate(F.slice("s", F.lit(2), F.greatest(n - 2, F.lit(0))), F.lit(0.0), lambda a, x: a + x) / (n - 2)
    return g.select("entity", "t", "label", "mean_z", "median_z", F.when(n > 2, inner).otherwise(F.col("mean_z")).alias("trimmed_z"), "mean_rank")


def gains(scores: DataFrame) -> DataFrame:
    """By entity: average precision of the scorers (mean, best), of the mean z, and what it gains on both."""
    each = auprc(scores.select("entity", "head", "label", F.col("z").alias("score")), ["entity", "head"]).groupBy("entity").agg(F.avg("auprc").alias("mean_auprc"), F.max("auprc").alias("best_auprc"))
    fused = auprc(fuse(scores).select("entity", "label", F.round("mean_z", 9).alias("score")), ["entity"]).select("entity", F.col("auprc").alias("fused"))
    return each.join(fused, "entity").withColumns({"gain_vs_mean": F.col("fused") - F.col("mean_auprc"), "gain_vs_best": F.col("fused") - F.col("best_auprc")})


def correlations(wide: DataFrame, heads: list[str]) -> DataFrame:
    """By entity: mean and least correlation between two scorers."""
    pairs = [correlation(a, b) for k, a in enumerate(heads) for b in heads[k + 1 :]]
    found = wide.groupBy("entity").agg(F.array(*pairs).alias("c"))
    return found.select("entity", (F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / F.size("c")).alias("corr_mean"), F.array_min("c").alias("corr_min"))
