"""Which channel: ranking metrics of channel scores against channel labels. A step has few channels, so they meet in one row group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import runs
from fleetseries.operators.prep import collapse_channels


def localisation(scores: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Precision and recall of the k best channels, over steps with a labelled channel, and of as many as are labelled.

    Equal scores go by channel number. A table with one channel has no such metric: rows need two channels or more at a step.
    """
    at = W.partitionBy("entity", "t")
    ranked = scores.withColumns({
        "r": F.row_number().over(at.orderBy(F.desc("score"), "channel")),
        "g": F.sum("channel_label").over(at), "c": F.count("*").over(at),
    }).where("g > 0 and c > 1")
    hit = lambda upto: F.sum(F.when(F.col("r") <= upto, F.col("channel_label")).otherwise(0))
    steps = ranked.groupBy(*dict.fromkeys([*keys, "entity", "t"]), "g").agg(*(hit(F.lit(k)).alias(f"h{k}") for k in ks), hit(F.col("g")).alias("hg"))
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n_steps"),
        *(F.avg(F.col(f"h{k}") / k).alias(f"precision_at_{k}") for k in ks),
        *(F.avg(F.col(f"h{k}") / F.col("g")).alias(f"recall_at_{k}") for k in ks),
        F.avg(F.col("hg") / F.col("g")).alias("at_oracle"),
    )


def segment_hits(scores: DataFrame) -> DataFrame:
    """ips by entity: for each labelled segment the share of its channels among as many channels of highest segment score, weighted by length."""
    inside = runs(collapse_channels(scores), F.col("label") == 1, ("entity",)).select("entity", "t", "run_id")
    peaks = scores.join(inside, ["entity", "t"]).groupBy("entity", "run_id", "channel").agg(
        F.max("score").alias("peak"), F.max("channel_label").alias("y"), F.count("*").alias("steps")
    )
    seg = W.partitionBy("entity", "run_id")
    ranked = peaks.withColumns({
        "r": F.row_number().over(seg.orderBy(F.desc("peak"), "channel")), "g": F.sum("y").over(seg), "length": F.max("steps").over(seg),
    })
    each = ranked.groupBy("entity", "run_id", "g", "length").agg((F.sum(F.when(F.col("r") <= F.col("g"), F.col("y")).otherwise(0)) / F.col("g")).alias("hit"))
    return each.groupBy("entity").agg((F.sum(F.col("length") * F.col("hit")) / F.sum("length")).alias("ips"), F.count("*").alias("n_segments"))


def macro_weighted(metrics: DataFrame, names: list[str], weight: str) -> DataFrame:
    """A row a metric: its mean over rows that have it, and its mean weighted by `weight`."""
    long = metrics.unpivot([weight], names, "metric", "value").where("value is not null")
    return long.groupBy("metric").agg(
        F.avg("value").alias("macro"), F.try_divide(F.sum(F.col("value") * F.col(weight)), F.sum(weight)).alias("weighted"), F.count("*").alias("n")
    )
