"""Labelled fault injection: series changed inside an interval table, and the mask of what changed.

Intervals are half-open (start, stop) and those of one series may not overlap. Everything random comes from md5 of
the interval's name, so a run can be repeated and checked in any engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseries.operators.prep import KEYS

#: Sizes of the kinds of faults.
SPIKE, SHIFT, RAMP, GROUP_SPIKE, GROUP_RAMP, NOISE, TONE, DROP, BURST, PERIOD = 6.0, 3.0, 3.0, 4.0, 2.0, 1.5, 1.8, 0.25, 3.0, 32.0


def uniform(name: Column) -> Column:
    """A number in (0, 1) from the first eight hexadecimal digits of name's md5."""
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(name: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(F.concat(name, F.lit("|r"))))) * F.cos(2 * math.pi * uniform(F.concat(name, F.lit("|a"))))


def within(points: DataFrame, spans: DataFrame, keys: list[str], step: int = 1024) -> DataFrame:
    """points with the columns of the span that holds them, null outside. Spans meet points in buckets of the time axis."""
    own = [c for c in spans.columns if c not in keys]
    dealt = spans.where("stop > start").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("stop") - 1) / step))))
    at = points.withColumn("__b", F.floor(F.col("t") / step)).alias("p")
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "__b"]]
    hit = at.join(dealt.alias("s"), [*same, F.col("p.t") >= F.col("s.start"), F.col("p.t") < F.col("s.stop")], "left")
    return hit.select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"s.{c}") for c in own))


def inject(series: DataFrame, faults: DataFrame, value: str = "value") -> DataFrame:
    """series with its clean value, the faulty one, kind, start and stop. faults: keys, start, stop, kind."""
    marked = within(series.withColumn("clean", F.col(value)), faults, KEYS)
    stats = marked.where("kind is not null").groupBy(*KEYS, "start").agg(F.avg("clean").alias("__mean"))
    whole = series.groupBy(*KEYS).agg(F.avg(value).alias("__all"))
    before = series.select(*KEYS, (F.col("t") + 1).alias("start"), F.col(value).alias("__held"))
    first = series.where("t = 0").select(*KEYS, F.col(value).alias("__first"))
    known = faults.select(*KEYS, "start").join(stats, [*KEYS, "start"]).join(before, [*KEYS, "start"], "left").join(whole, KEYS).join(first, KEYS, "left")
    met = marked.join(known, [*KEYS, "start"], "left")
    x, mean, k, width = F.col("clean"), F.col("__mean"), F.col("t") - F.col("start"), F.col("stop") - F.col("start")
    name = F.concat_ws("|", F.col("entity"), F.col("start"), F.col("kind"))
    u, noise = uniform(name), normal(F.concat_ws("|", name, F.col("t")))
    slope = F.when(width > 1, k / (width - 1)).otherwise(0.0)
    wave = lambda period, phase: F.sin(2 * math.pi * k / period + phase)
    zero = F.lit(0.0)
    by_kind = {
        "spike": x + F.when(u < 0.5, -SPIKE).otherwise(SPIKE), "level_shift": x + SHIFT * (0.8 + 0.4 * u), "ramp": x + RAMP * slope,
        "group_spike": x + GROUP_SPIKE, "group_drift": x + GROUP_RAMP * slope, "noise_burst": x + NOISE * noise, "frequency_shift": x + TONE * wave(8.0, zero),
        "amplitude_drop": mean + DROP * (x - mean), "amplitude_burst": mean + BURST * (x - mean),
        "flatline": F.coalesce("__held", "__first"), "missed_beat": F.coalesce("__held", zero), "contextual_point": F.col("__all"),
        "phase_jump": mean + 1.2 * wave(PERIOD, math.pi * (0.5 + u)), "period_break": mean + wave(PERIOD / (1.5 + 0.7 * u), zero),
        "waveform_swap": mean + 1.4 * 2 * (k / PERIOD - F.floor(0.5 + k / PERIOD)), "double_beat": x + 1.5 * wave(PERIOD / 2, zero),
    }
    changed = F.coalesce(*(F.when(F.col("kind") == n, c) for n, c in by_kind.items()), F.when(F.col("kind").isNotNull(), F.raise_error(F.lit("unknown kind of fault")).cast("double")), x)
    return met.withColumn("faulty", changed).select(*series.columns, "clean", "faulty", "kind", "start", "stop")


def borrow(series: DataFrame, faults: DataFrame, value: str = "value") -> DataFrame:
    """Cross-channel faults: inside an interval a channel takes sign times the value of channel `source`, rolled by `shift` steps.

    faults: entity, split, channel, start, stop, source, shift, sign. A negated copy breaks a correlation, a roll of the
    channel itself shifts its lag, a permutation breaks dependency, one source for all makes a group correlate.
    """
    marked = within(series.withColumn("clean", F.col(value)), faults, ["entity", "split", "channel"])
    at = F.col("start") + F.pmod(F.col("t") - F.col("start") - F.col("shift"), F.col("stop") - F.col("start"))
    other = series.select("entity", "split", F.col("channel").alias("source"), F.col("t").alias("__from"), F.col(value).alias("__v"))
    met = marked.withColumn("__from", at).join(other, ["entity", "split", "source", "__from"], "left")
    return met.withColumn("faulty", F.when(F.col("sign").isNull(), F.col("clean")).otherwise(F.col("sign") * F.col("__v"))).select(*series.columns, "clean", "faulty", "start", "stop")


def one_hot(series: DataFrame, faults: DataFrame, value: str = "value") -> DataFrame:
    """Categorical faults: inside an interval the channels in `active` are 1 and all others 0 (two: invalid; none: invalid; one: stuck)."""
    marked = within(series.withColumn("clean", F.col(value)), faults, ["entity", "split"])
    forced = F.when(F.array_contains("active", F.col("channel").cast("int")), 1.0).otherwise(0.0)
    return marked.withColumn("faulty", F.when(F.col("active").isNull(), F.col("clean")).otherwise(forced))


def change_mask(injected: DataFrame, eps: float = 1e-9) -> DataFrame:
    """injected with mask: 1 where the value really changed."""
    return injected.withColumn("mask", F.coalesce((F.abs(F.col("faulty") - F.col("clean")) > eps).cast("int"), F.lit(0)))


def change_events(injected: DataFrame, keys: list[str]) -> DataFrame:
    """One row an interval: its bounds, and how many of its steps and channels changed."""
    m = change_mask(injected).where("start is not null")
    return m.groupBy(*keys, "start", "stop").agg(F.sum("mask").alias("n_changed"), F.count_distinct(F.when(F.col("mask") == 1, F.col("channel"))).alias("n_channels"))
