"""Whole spectra and autocorrelations of series, and the seasonal periods that both agree on.

A transform of N = N1 x N2 places takes two steps, each over pieces of about PIECE numbers: first over the places that
leave the same remainder by N2, then, after a turn of the phase, over the results of the same first frequency. The
inverse transform of the power spectrum begins with just the pieces in which the second step ends, so the
autocorrelation takes two exchanges of blocks, and no task ever holds a series.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseries.functions.frames import framed, settled

PIECE, STRETCH = 1 << 18, 4096
#: Lags below this are noise; a period must be seen so many times; both estimates are within this share of the larger; the least autocorrelation there; the least prominence of a peak.
LEAST_LAG, CYCLES, AGREE, STRENGTH, PROMINENCE = 30, 2.0, 0.15, 0.20, 1e-4


def halves(bits: int, piece: int) -> tuple[int, int, int, int]:
    """N1, N2, and how many columns of length N1 and rows of length N2 make a piece."""
    one, two = 1 << bits // 2, 1 << bits - bits // 2
    return one, two, max(1, min(two, piece // one)), max(1, min(one, piece // two))


def sized(series: DataFrame, keys: list[str], value: str, pad: int) -> DataFrame:
    """(keys, t, x, n, bits): t from 0, missing values as zeros, the number of steps, and the logarithm of the places of a transform of pad * n at least."""
    ends = series.groupBy(*keys).agg(F.min("t").alias("__first"), (F.max("t") - F.min("t") + 1).alias("n"))
    bits = F.greatest(F.ceil(F.log2(F.col("n") * pad)).cast("int"), F.lit(1))
    shifted = series.join(ends, keys)
    return shifted.select(*keys, (F.col("t") - F.col("__first")).cast("long").alias("t"), F.coalesce(F.col(value), F.lit(0.0)).alias("x"), F.col("n").cast("long").alias("n"), bits.alias("bits"))


def part(block: int, size: int, most: int) -> slice:
    return slice(block * size, min(most, (block + 1) * size))


def power_blocks(rows: DataFrame, keys: list[str], most_lag: Column, piece: int = PIECE) -> DataFrame:
    """(keys, n, bits, block, column, re, im, power, place, sum) from sized rows.

    With column not null: a block of the half-done inverse transform of the power spectrum. Else: the highest power in
    this block among periods LEAST_LAG to most_lag, its place, and the sum of all such powers.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    low = F.shiftright("bits", 1)
    two = F.pow(F.lit(2), F.col("bits") - low).cast("long")
    wide = F.greatest(F.lit(1), F.least(two, F.floor(F.lit(piece) / F.pow(F.lit(2), low)))).cast("long")  # as halves has it
    dealt = rows.withColumn("limit", most_lag).withColumn("block", F.floor(F.pmod("t", two) / wide))

    def same(table: pa.Table, count: int) -> dict:
        return {k: pa.array([table[k][0].as_py()] * count, table[k].type) for k in [*keys, "n", "bits", "limit"]}

    def first(table: pa.Table) -> pa.Table:
        bits, block = table["bits"][0].as_py(), int(table["block"][0].as_py())
        one, two, wide, tall = halves(bits, piece)
        own = part(block, wide, two)
        t = table["t"].to_numpy()
        x = np.zeros((one, own.stop - own.start))
        x[t // two, t % two - own.start] = table["x"].to_numpy()
        y = np.fft.fft(x, axis=0) * np.exp(-2j * np.pi / (one * two) * np.outer(np.arange(one), np.arange(own.start, own.stop)))
        blocks = range(-(-one // tall))
        pieces = [y[part(b, tall, one)].ravel() for b in blocks]
        return pa.table(same(table, len(pieces)) | {
            "block": pa.array(blocks, pa.int64()), "column": pa.array([block] * len(pieces), pa.int64()),
            "re": pa.array([p.real for p in pieces], pa.list_(pa.float64())), "im": pa.array([p.imag for p in pieces], pa.list_(pa.float64())),
        })

    def second(table: pa.Table) -> pa.Table:
        bits, block, limit = table["bits"][0].as_py(), table["block"][0].as_py(), table["limit"][0].as_py()
        one, two, wide, tall = halves(bits, piece)
        own = part(block, tall, one)
        y = np.zeros((own.stop - own.start, two), complex)
        for column, re, im in zip(table["column"].to_pylist(), table["re"], table["im"], strict=True):
            y[:, part(column, wide, two)] = (re.values.to_numpy() + 1j * im.values.to_numpy()).reshape(len(y), -1)
        spectrum = np.fft.fft(y, axis=1)  # of the place k1 + one * k2
        power = spectrum.real**2 + spectrum.imag**2
        place = np.arange(own.start, own.stop)[:, None] + one * np.arange(two)
        period = one * two / np.maximum(place, 1)
        fit = (place > 0) & (2 * place <= one * two) & (period >= LEAST_LAG) & (period <= limit)
        best = int(np.where(fit, power, -1).argmax())
        back = np.fft.ifft(power, axis=1) * np.exp(2j * np.pi / (one * two) * np.outer(np.arange(own.start, own.stop), np.arange(two)))
        blocks = range(-(-two // wide))
        pieces = [back[:, part(b, wide, two)].ravel() for b in blocks]
        more = len(pieces)
        return pa.table(same(table, more + 1) | {
            "block": pa.array([*blocks, 0], pa.int64()), "column": pa.array([block] * more + [None], pa.int64()),
            "re": pa.array([*(p.real for p in pieces), None], pa.list_(pa.float64())), "im": pa.array([*(p.imag for p in pieces), None], pa.list_(pa.float64())),
            "power": pa.array([None] * more + [power.ravel()[best] if fit.any() else None], pa.float64()),
            "place": pa.array([None] * more + [place.ravel()[best] if fit.any() else None], pa.int64()), "sum": pa.array([None] * more + [power[fit].sum()], pa.float64()),
        })

    common = f"{schema}, n long, bits int, limit double, block long, column long, re array<double>, im array<double>"
    half = dealt.select(*keys, "n", "bits", "limit", "t", "x", "block").groupBy(*keys, "block").applyInArrow(first, common)
    return half.groupBy(*keys, "block").applyInArrow(second, common + ", power double, place long, sum double")


def lags_of(blocks: DataFrame, keys: list[str], piece: int = PIECE) -> DataFrame:
    """(keys, lag, s): sums of x(t) x(t + lag) for lags up to half the length, from the blocks of power_blocks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)

    def last(table: pa.Table) -> pa.Table:
        bits, block, n = table["bits"][0].as_py(), table["block"][0].as_py(), table["n"][0].as_py()
        one, two, wide, tall = halves(bits, piece)
        own = part(block, wide, two)
        y = np.zeros((one, own.stop - own.start), complex)
        for column, re, im in zip(table["column"].to_pylist(), table["re"], table["im"], strict=True):
            y[part(column, tall, one)] = (re.values.to_numpy() + 1j * im.values.to_numpy()).reshape(-1, y.shape[1])
        s = np.fft.ifft(y, axis=0).real
        lag = np.arange(own.start, own.stop) + two * np.arange(one)[:, None]
        keep = lag <= n // 2
        return pa.table({k: pa.array([table[k][0].as_py()] * int(keep.sum()), table[k].type) for k in keys} | {"lag": pa.array(lag[keep], pa.int64()), "s": pa.array(s[keep])})

    return blocks.where("column IS NOT NULL").groupBy(*keys, "block").applyInArrow(last, f"{schema}, lag long, s double")


def acf_short(rows: DataFrame, keys: list[str]) -> DataFrame:
    """acf_full from sized rows of series whose transform is one piece: a task works it out whole, and nothing but the points is shuffled."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def whole(table: pa.Table) -> pa.Table:
        n, places = table["n"][0].as_py(), 1 << table["bits"][0].as_py()
        x = np.zeros(places)
        x[table["t"].to_numpy()] = table["x"].to_numpy()
        s = np.fft.irfft(np.abs(np.fft.rfft(x)) ** 2, places)[: n // 2 + 1]
        acf = pa.array(s / s[0]) if s[0] > 1e-9 else pa.nulls(len(s), pa.float64())
        return pa.table({k: pa.array([table[k][0].as_py()], table[k].type).take(pa.array(np.zeros(len(s), np.int64))) for k in keys} | {"lag": pa.array(np.arange(len(s))), "acf": acf})

    return rows.select(*keys, "n", "bits", "t", "x").groupBy(*keys).applyInArrow(whole, f"{schema}, lag long, acf double")


def acf_full(series: DataFrame, keys: list[str], value: str, piece: int = PIECE) -> DataFrame:
    """(keys, lag, acf) for all lags up to half the length (steps from the first to the last); null for a series of zeros.

    Series of up to `piece` places are worked out whole, longer ones by blocks.
    """
    rows = sized(series, keys, value, 2)
    one = F.pow(F.lit(2), F.col("bits")) <= piece
    long = relative(lags_of(power_blocks(rows.where(~one), keys, F.lit(0.0), piece), keys, piece), keys)
    return acf_short(rows.where(one), keys).unionByName(long)


def relative(sums: DataFrame, keys: list[str]) -> DataFrame:
    zero = sums.where("lag = 0").select(*keys, F.col("s").alias("__zero"))
    return sums.join(zero, keys).select(*keys, "lag", F.when(F.col("__zero") > 1e-9, F.col("s") / F.col("__zero")).alias("acf"))


def prominences(points: DataFrame, keys: list[str], at: str, value: str, step: int = STRETCH) -> DataFrame:
    """(keys, at, value, prominence) of the peaks: points higher than both neighbours (a flat top is none).

    Prominence is the height over the higher of the two lowest values on the way to a higher point, or to the end, on
    each side. `at` is dense. A peak looks through its own stretch of `step` points; where that holds no higher one,
    the stretches' greatest and least values, a short list a key, name the one stretch that does, and that is looked
    through.
    """
    near = framed(points.select(*keys, at, value), 1, 1, {"__b": lambda w: F.lag(value).over(w), "__a": lambda w: F.lead(value).over(w)}, tuple(keys), at)
    tops = near.where((F.col(value) > F.col("__b")) & (F.col(value) > F.col("__a"))).select(*keys, at, value, F.floor(F.col(at) / step).alias("__c"))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))))
    stretches = settled(points.groupBy(*keys, F.floor(F.col(at) / step).alias("__c")).agg(F.transform(sorted_, lambda e: e["v"]).alias("__v"), F.min(at).alias("__first")))
    lists = stretches.groupBy(*keys).agg(F.collect_list(F.struct(F.col("__c").alias("c"), F.array_max("__v").alias("hi"), F.array_min("__v").alias("lo"))).alias("__s"))

    def through(values: Column) -> Column:
        """(found, low): whether values, in this order, hold one higher than the peak, and the least before that."""
        higher = F.array_position(F.transform(values, lambda x: x > F.col(value)), F.lit(True)).cast("int")
        return F.struct((higher > 0).alias("found"), F.array_min(F.when(higher > 0, F.slice(values, 1, F.greatest(higher - 1, F.lit(0)))).otherwise(values)).alias("low"))

    place = (F.col(at) - F.col("__first")).cast("int")
    own = tops.join(stretches, [*keys, "__c"]).select(
        *keys, at, value, "__c", through(F.slice("__v", place + 2, F.size("__v"))).alias("after"), through(F.reverse(F.slice("__v", F.lit(1), place))).alias("before")
    )
    listed = settled(own.join(lists, keys))

    def beyond(name: str, sign: int) -> DataFrame:
        """What one side gives, with the stretch that ends it if its own does not."""
        far = F.filter("__s", lambda s: (s["c"] - F.col("__c")) * sign > 0)
        ends = F.transform(F.filter(far, lambda s: s["hi"] > F.col(value)), lambda s: s["c"] * sign)
        goal = F.when(~F.col(f"{name}.found"), F.array_min(ends) * sign)
        between = F.array_min(F.transform(F.filter(far, lambda s: goal.isNull() | ((s["c"] - goal) * sign < 0)), lambda s: s["lo"]))
        open_ = listed.select(*keys, at, value, goal.alias("__g"), F.when(F.col(f"{name}.found"), F.col(f"{name}.low")).otherwise(F.least(F.col(f"{name}.low"), between)).alias("__low"))
        goals = open_.where("__g IS NOT NULL").join(stretches.withColumnRenamed("__c", "__g"), [*keys, "__g"])
        ordered = F.col("__v") if sign > 0 else F.reverse("__v")
        closed = goals.select(*keys, at, F.least(F.col("__low"), through(ordered)["low"]).alias(name))
        return closed.unionByName(open_.where("__g IS NULL").select(*keys, at, F.col("__low").alias(name)))

    met = tops.select(*keys, at, value).join(beyond("after", 1).withColumnRenamed("after", "__r"), [*keys, at]).join(beyond("before", -1).withColumnRenamed("before", "__l"), [*keys, at])
    return met.select(*keys, at, value, (F.col(value) - F.greatest("__l", "__r")).alias("prominence"))


def seasonal_periods(series: DataFrame, keys: list[str], value: str, day: int | None = None) -> DataFrame:
    """(keys, n, period_acf, strength, period_fft, share, acf_at_day, agree, period) of detrended, standardised series.

    period_acf: the lag, from LEAST_LAG to n / CYCLES, of the autocorrelation's most prominent peak (the height would
    only show smoothness); strength: the value there. period_fft: the period of the highest power in the same range of
    a periodogram padded to eight times the length; share: its share of the power in the range. They agree if they are
    within AGREE of the larger, and strength is STRENGTH or more; with `day`, only series of CYCLES days or more can.
    """
    rows = sized(series, keys, value, 8)
    most = F.floor(F.col("n") / CYCLES)
    blocks = settled(power_blocks(rows, keys, most.cast("double")))
    acf = settled(relative(lags_of(blocks, keys), keys))
    n = blocks.groupBy(*keys).agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    peaks = prominences(acf.join(n.select(*keys, "n"), keys).where((F.col("lag") >= LEAST_LAG) & (F.col("lag") <= most)), keys, "lag", "acf").where(F.col("prominence") >= PROMINENCE)
    best = peaks.groupBy(*keys).agg(F.max_by(F.struct("lag", "acf"), F.struct(F.round("prominence", 12), -F.col("lag"))).alias("b"))
    power = blocks.where("column IS NULL").groupBy(*keys).agg(
        F.max_by("place", F.struct("power", -F.col("place"))).alias("place"), F.max("power").alias("power"), F.sum("sum").alias("sum")
    )
    at_day = acf.where(F.col("lag") == F.lit(day)).select(*keys, F.col("acf").alias("acf_at_day"))
    met = reduce(lambda a, b: a.join(b, keys, "left"), [n, best, power, at_day])
    met = met.select(
        *keys, "n", F.col("b.lag").alias("period_acf"), F.col("b.acf").alias("strength"), F.rint(F.pow(F.lit(2.0), "bits") / F.col("place")).cast("long").alias("period_fft"),
        (F.col("power") / (F.col("sum") + 1e-12)).alias("share"), "acf_at_day",
    )
    close = F.abs(F.col("period_acf") - F.col("period_fft")) <= AGREE * F.greatest("period_acf", "period_fft")
    long_enough = F.lit(True) if day is None else F.col("n") >= CYCLES * day
    agree = F.coalesce(close & (F.col("strength") >= STRENGTH) & long_enough, F.lit(False))
    return met.withColumn("agree", agree).withColumn("period", F.when(F.col("agree"), F.col("period_acf")))
