"""Ordered computations that do not put a whole series into one task.

A window over one entity would sort all of its points in a single task. These helpers cut the time axis into chunks
of CHUNK steps: moving frames get a halo of the neighbours' rows, running sums and dense indices add the chunks'
totals, which are a small table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

CHUNK = 1 << 16
SERIES_KEYS = ("entity", "split", "channel")


def r6(value: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation, an aggregate; null where either side is constant (F.corr divides by zero there)."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def bankers(value: Column) -> Column:
    """Rounded half to even, as a long."""
    return F.bround(value, 0).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row: inside a lambda Spark would work it out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def framed(
    df: DataFrame,
    before: int,
    after: int,
    made: dict[str, Callable[[WindowSpec], Column]],
    keys: tuple[str, ...] = SERIES_KEYS,
    t: str = "t",
    size: int = CHUNK,
) -> DataFrame:
    """df with columns whose frames reach `before` steps back and `after` ahead of a row.

    Each function gets a window ordered by t; frames, lags and leads within the reach are exact.
    """
    low, high = F.floor((F.col(t) - after) / size), F.floor((F.col(t) + before) / size)
    dealt = df.withColumn("__chunk", F.explode(F.sequence(low, high)))
    window = W.partitionBy(*keys, "__chunk").orderBy(t)
    kept = dealt.withColumn("__own", F.col("__chunk") == F.floor(F.col(t) / size))
    return kept.withColumns({name: f(window) for name, f in made.items()}).where("__own").drop("__chunk", "__own")


def running_sum(
    df: DataFrame, value: Column, name: str, keys: tuple[str, ...] = SERIES_KEYS, t: str = "t", size: int = CHUNK
) -> DataFrame:
    """df with the running total of value up to and including each row, in the order of t."""
    chunked = df.withColumn("__v", value).withColumn("__chunk", F.floor(F.col(t) / size))
    totals = chunked.groupBy(*keys, "__chunk").agg(F.sum("__v").alias("__total"))
    earlier = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__chunk", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    within = W.partitionBy(*keys, "__chunk").orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    joined = chunked.join(offsets.hint("shuffle_hash"), [*keys, "__chunk"])  # the window needs that shuffle too, and no table grows on the driver
    return joined.withColumn(name, F.col("__offset") + F.sum("__v").over(within)).drop("__v", "__chunk", "__offset")


def beside(df: DataFrame, keys: list[str], at: str, before: dict[str, str], after: dict[str, str], step: float) -> DataFrame:
    """df with columns of the row before and of the row after, by key in the order of `at` (new name: column).

    Rows meet in stretches of `step`; a stretch's first and last row find their neighbours in a table of a row a
    stretch, so no task holds all rows of a key.
    """
    dealt = df.withColumn("__b", F.floor(F.col(at) / step))
    own = W.partitionBy(*keys, "__b").orderBy(at)
    near = dealt.withColumns({n: F.lag(c).over(own) for n, c in before.items()} | {n: F.lead(c).over(own) for n, c in after.items()})
    near = near.withColumns({"__f": F.row_number().over(own) == 1, "__l": F.lead(F.lit(1)).over(own).isNull()})
    tips = dealt.groupBy(*keys, "__b").agg(
        *(F.max_by(c, at).alias(f"__h_{n}") for n, c in before.items()), *(F.min_by(c, at).alias(f"__t_{n}") for n, c in after.items())
    )
    line = W.partitionBy(*keys).orderBy("__b")
    named = tips.select(*keys, "__b", *(F.lag(f"__h_{n}").over(line).alias(f"__h_{n}") for n in before), *(F.lead(f"__t_{n}").over(line).alias(f"__t_{n}") for n in after))
    both = near.join(named, [*keys, "__b"])
    out = {n: F.when(F.col("__f"), F.col(f"__h_{n}")).otherwise(F.col(n)) for n in before} | {n: F.when(F.col("__l"), F.col(f"__t_{n}")).otherwise(F.col(n)) for n in after}
    return both.withColumns(out).select(*df.columns, *before, *after)


def carried(df: DataFrame, keys: list[str], value: str, before: str, after: str, t: str = "t", step: int = CHUNK) -> DataFrame:
    """df with two structs (t, value): the nearest known value at or before a row, and at or after it, however far; null where there is none.

    Rows meet in stretches of `step`; what a stretch lacks comes from a table of a row a stretch. What comes after is read
    in falling order: a frame up to the end of a partition would be walked anew for every row.
    """
    dealt = df.withColumn("__t", F.when(F.col(value).isNotNull(), F.col(t))).withColumn("__b", F.floor(F.col(t) / step))
    own, line = W.partitionBy(*keys, "__b"), W.partitionBy(*keys)
    last = lambda name, window, order, upto: F.last(name, True).over(window.orderBy(order).rowsBetween(W.unboundedPreceding, upto))
    tips = dealt.groupBy(*keys, "__b").agg(F.max("__t").alias("__ht"), F.max_by(value, "__t").alias("__hv"), F.min("__t").alias("__tt"), F.min_by(value, "__t").alias("__tv"))
    far = tips.select(*keys, "__b", *(last(f"__{e}{c}", line, order("__b"), -1).alias(f"__far_{e}{c}") for e, order in (("h", F.asc), ("t", F.desc)) for c in "tv"))
    near = dealt.withColumns({f"__near_{e}{c}": last(name, own, order(t), 0) for e, order in (("h", F.asc), ("t", F.desc)) for c, name in (("t", "__t"), ("v", value))})
    pair = lambda at: F.when(F.col(f"{at}t").isNotNull(), F.struct(F.col(f"{at}t").alias("t"), F.col(f"{at}v").alias("value")))
    return near.join(far, [*keys, "__b"]).withColumns({name: F.coalesce(pair(f"__near_{e}"), pair(f"__far_{e}")) for name, e in ((before, "h"), (after, "t"))}).select(*df.columns, before, after)


def dense_index(df: DataFrame, keys: tuple[str, ...], bucket: Column, order: list[str], name: str) -> DataFrame:
    """df with a 0-based index by key in the given order. bucket must rise with the order; it deals a key to many tasks."""
    dealt = df.withColumn("__bucket", bucket)
    counts = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    return dealt.join(offsets, [*keys, "__bucket"]).withColumn(name, F.col("__offset") + rank).drop("__bucket", "__offset")


def value_bucket(value: Column, per_e: int = 64) -> Column:
    """A long that never falls as value rises: 64 buckets a factor of e on each side of zero; NaN, the greatest, last; null stays null."""
    depth = F.floor(F.least(F.log(F.abs(value)), F.lit(1e4)) * per_e).cast("long") + 746 * per_e
    return F.when(F.isnan(value), F.lit(1 << 40)).when(value == 0, F.lit(0)).when(value > 0, depth).otherwise(-depth)


def value_sums(
    df: DataFrame, keys: list[str], value: str, sums: dict[str, Column], falling: bool = False, bucket: Callable[[Column], Column] = value_bucket
) -> DataFrame:
    """df with running sums by key in the order of value, up to and including a row; equal values must be one row.

    A key is dealt to many tasks by buckets of the value; their totals, a row a bucket, give the offsets.
    """
    order = F.desc if falling else F.asc
    dealt = df.withColumn("__bucket", bucket(F.col(value))).withColumns({f"__{n}": c for n, c in sums.items()})
    totals = dealt.groupBy(*keys, "__bucket").agg(*(F.sum(f"__{n}").alias(f"__t_{n}") for n in sums))
    earlier = W.partitionBy(*keys).orderBy(order("__bucket")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__bucket").alias("__b"), *(F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums)
    )
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = W.partitionBy(*keys, "__bucket").orderBy(order(value)).rowsBetween(W.unboundedPreceding, 0)
    return dealt.join(offsets, same).select(*df.columns, *((F.col(f"__o_{n}") + F.sum(f"__{n}").over(within)).alias(n) for n in sums))


def quantiles(df: DataFrame, keys: list[str], value: str, made: dict[str, float]) -> DataFrame:
    """Exact quantiles by key, with linear interpolation between the order statistics next to each; nulls don't count.

    Values are counted, and their places found by value_sums, so no task holds all values of a key.
    """
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    size = known.groupBy(*keys).agg(F.count("*").alias("__n"))
    upto = value_sums(counts, keys, value, {"__upto": F.col("__c")})
    placed = upto.join(size, keys) if keys else upto.crossJoin(F.broadcast(size))  # one row
    at = lambda q: F.lit(q) * (F.col("__n") - 1)
    holds = lambda k: F.max(F.when((F.col("__upto") - F.col("__c") <= k) & (k < F.col("__upto")), F.col(value)))
    ends = placed.groupBy(*keys, "__n").agg(*(holds(f(at(q))).alias(f"__{e}_{name}") for name, q in made.items() for e, f in (("a", F.floor), ("b", F.ceil))))
    return ends.select(*keys, *((F.col(f"__a_{n}") + (F.col(f"__b_{n}") - F.col(f"__a_{n}")) * (at(q) - F.floor(at(q)))).alias(n) for n, q in made.items()))


def runs(df: DataFrame, flag: Column, keys: tuple[str, ...] = SERIES_KEYS, t: str = "t") -> DataFrame:
    """Rows where flag holds, each with run_id: the number of its maximal run of consecutive rows."""
    marked = framed(df.withColumn("__f", F.coalesce(flag, F.lit(False))), 1, 0, {"__p": lambda w: F.lag("__f").over(w)}, keys, t)
    start = (F.col("__f") & ~F.coalesce("__p", F.lit(False))).cast("long")
    return running_sum(marked, start, "run_id", keys, t).where("__f").drop("__f", "__p")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir; under one of our own only where that is unset and all runs on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetseries-"))
        place = spark.sparkContext.getCheckpointDir()
    return f"{place}/fleetseries/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: what follows reads it as often as it likes.

    Lineage ends there, and a lost executor loses nothing.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
