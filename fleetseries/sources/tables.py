"""Readers, writers and adapters: how tables become series, vectors, tokens and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseries.functions.frames import bankers, carried, dense_index

SERIES = (
    T.StructType()
    .add("entity", T.StringType())
    .add("cluster", T.StringType())
    .add("split", T.StringType())
    .add("channel", T.IntegerType())
    .add("t", T.LongType())
    .add("value", T.DoubleType())
    .add("label", T.IntegerType())
)
SPLITS = ("train", "val", "test")


def series_from_events(events: DataFrame) -> DataFrame:
    """One univariate series per user group, in event order: half for training (its last fifth for validation), the rest for testing."""
    named = events.select(
        F.concat(F.lit("u"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")).alias("entity"),
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("cluster"),
        "ts",
        "event_id",
        F.col("value").cast("double").alias("value"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )
    placed = dense_index(named, ("entity",), F.date_trunc("day", "ts"), ["ts", "event_id"], "i")
    sizes = named.groupBy("entity").agg(F.count("*").alias("n"))
    half = F.floor(F.col("n") / 2)
    cut = sizes.select("entity", half.alias("half"), (half - bankers(0.2 * half)).alias("fit"))
    joined = placed.join(cut, "entity")
    split = F.when(F.col("i") < F.col("fit"), "train").when(F.col("i") < F.col("half"), "val").otherwise("test")
    first = F.when(F.col("i") < F.col("fit"), 0).when(F.col("i") < F.col("half"), F.col("fit")).otherwise(F.col("half"))
    return joined.select(
        "entity", "cluster", split.alias("split"), F.lit(0).alias("channel"), (F.col("i") - first).cast("long").alias("t"), "value", "label"
    )


#: The same in SQL, for oracles: a CTE named series.
SERIES_SQL = """
ev AS (SELECT 'u' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS entity, 'c' || CAST(user_id % 4 AS VARCHAR) AS cluster, value,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id % 16) // 2 AS half FROM events),
cuts AS (SELECT *, half - CAST(round_even(CAST(0.2 AS DOUBLE) * half, 0) AS BIGINT) AS fit FROM ev),
series AS (SELECT entity, cluster, CASE WHEN i < fit THEN 'train' WHEN i < half THEN 'val' ELSE 'test' END AS split, 0 AS channel,
             i - CASE WHEN i < fit THEN 0 WHEN i < half THEN fit ELSE half END AS t, value, label FROM cuts)"""


def multichannel_from_events(events: DataFrame, above: float = 150.0) -> DataFrame:
    """Hourly means by user group, one channel per event type (numbered by name), gaps filled forward; a channel is labelled where its maximum passes `above`."""
    hourly = events.groupBy(
        F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("entity"), F.date_trunc("hour", "ts").alias("hour"), "event_type"
    ).agg(F.avg("value").alias("value"), F.max("value").alias("top"))
    kinds = hourly.select("event_type").distinct()
    channels = kinds.withColumn("channel", F.expr("cast(rank() over (order by event_type) - 1 as int)"))  # a handful of kinds
    span = hourly.agg(F.min("hour").alias("low"), F.max("hour").alias("high"))
    grid = (
        span.select(F.explode(F.sequence("low", "high", F.expr("interval 1 hour"))).alias("hour"), "low")
        .withColumn("t", ((F.unix_timestamp("hour") - F.unix_timestamp("low")) / 3600).cast("long"))
        .drop("low")
        .crossJoin(F.broadcast(channels))
        .crossJoin(F.broadcast(hourly.select("entity").distinct()))  # four groups
    )
    joined = grid.join(hourly, ["entity", "hour", "event_type"], "left")
    filled = carried(joined, ["entity", "channel"], "value", "__p", "__n").withColumn("filled", F.col("__p.value"))
    return filled.where(F.col("filled").isNotNull()).select(
        "entity", F.lit("test").alias("split"), "channel", "t", F.col("filled").alias("value"),
        F.coalesce((F.col("top") > above).cast("int"), F.lit(0)).alias("channel_label"),
    )


MULTI_SQL = """
hourly AS (SELECT 'g' || CAST(user_id % 4 AS VARCHAR) AS entity, date_trunc('hour', ts) AS hour, event_type, avg(value) AS value, max(value) AS top
           FROM events GROUP BY ALL),
kinds AS (SELECT event_type, rank() OVER (ORDER BY event_type) - 1 AS channel FROM (SELECT DISTINCT event_type FROM hourly)),
span AS (SELECT min(hour) AS low, max(hour) AS high FROM hourly),
grid AS (SELECT unnest(generate_series(low, high, INTERVAL 1 HOUR)) AS hour, low FROM span),
cells AS (SELECT g.hour, CAST(date_diff('hour', g.low, g.hour) AS BIGINT) AS t, k.event_type, k.channel, e.entity
          FROM grid AS g CROSS JOIN kinds AS k CROSS JOIN (SELECT DISTINCT entity FROM hourly) AS e),
filled AS (SELECT c.entity, c.channel, c.t, h.top, last_value(h.value IGNORE NULLS) OVER (PARTITION BY c.entity, c.channel ORDER BY c.t
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM cells AS c LEFT JOIN hourly AS h USING (entity, hour, event_type)),
multi AS (SELECT entity, channel, t, value, coalesce(CASE WHEN top > 150 THEN 1 ELSE 0 END, 0) AS channel_label FROM filled WHERE value IS NOT NULL)"""


#: Days of the dense calendar that one task should hold, about.
DENSE = 1 << 20


def daily_from_lineitem(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Daily revenue by supplier over a dense calendar, 0 where nothing was shipped; the cluster is the supplier's nation.

    Only the days of sales are shuffled, a row a supplier and day; each then brings the empty days up to the next one.
    The result is dealt by entity in parts of about DENSE rows, so what works by entity on it needs no other shuffle.
    """
    name = lambda key: F.concat(F.lit("s"), F.col(key).cast("string"))
    items = lineitem.select(name("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").cast("double").alias("price"))
    span = items.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    ends = span.select(F.coalesce(F.date_diff("high", "low") + 1, F.lit(0)).alias("days")).first()
    parts = max(supplier.sparkSession.sparkContext.defaultParallelism, -(-supplier.count() * ends.days // DENSE))
    days = items.where("entity IS NOT NULL").groupBy("entity", "day").agg(F.sum("price").alias("sold")).repartition(parts, "entity")
    named = supplier.select(name("s_suppkey").alias("entity"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("cluster"))
    w = W.partitionBy("entity").orderBy("day")  # as many rows as the calendar has days; a null day comes first
    place = lambda day: F.date_diff(day, "low").cast("long")
    met = days.crossJoin(F.broadcast(span)).withColumn("at", place("day"))  # one row of bounds
    gaps = met.withColumns({
        "from": F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("at")).cast("long"), "to": F.coalesce(F.lead("at").over(w) - 1, place("high")),
    }).where("`from` <= `to`")
    dense = gaps.join(named.hint("shuffle_hash"), "entity").withColumn("t", F.explode(F.sequence("from", "to")))
    return dense.select(
        "entity", "cluster", F.lit("train").alias("split"), F.lit(0).alias("channel"), "t", F.date_add("low", F.col("t").cast("int")).alias("day"),
        F.coalesce(F.when(F.col("t") == F.col("at"), F.col("sold")), F.lit(0.0)).alias("value"),
    )


DAILY_SQL = """
sold AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS dy, sum(CAST(l_extendedprice AS DOUBLE)) AS sold FROM lineitem GROUP BY ALL),
bounds AS (SELECT min(dy) AS low, max(dy) AS high FROM sold),
dense AS (SELECT k.l_suppkey, CAST(unnest(generate_series(b.low, b.high, INTERVAL 1 DAY)) AS DATE) AS dy, b.low
          FROM (SELECT DISTINCT l_suppkey FROM sold) AS k CROSS JOIN bounds AS b),
daily AS (SELECT 's' || CAST(d.l_suppkey AS VARCHAR) AS entity, 'n' || CAST(s_nationkey AS VARCHAR) AS cluster,
            CAST(date_diff('day', d.low, d.dy) AS BIGINT) AS t, coalesce(sold.sold, 0.0) AS value
          FROM dense AS d LEFT JOIN sold ON sold.l_suppkey = d.l_suppkey AND sold.dy = d.dy JOIN supplier ON s_suppkey = d.l_suppkey)"""


def vectors_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """(client, vec_id, v): embeddings as vectors of doubles; the label is the client."""
    return embeddings.select(F.col("label").alias("client"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))


def quantise(value: Column, levels: int = 16, low: float = -3.0, high: float = 3.0) -> Column:
    """The number of value's equal-width bin, clipped to the range."""
    place = F.floor((value - low) / ((high - low) / levels))
    return F.least(F.greatest(place, F.lit(0)), F.lit(levels - 1)).cast("int")


# -- readers and writers -------------------------------------------------------------------------------


def load_split(spark: SparkSession, path: str, dataset: str, split: str, entities: list[str] | None = None) -> DataFrame:
    """One split of a series table partitioned by dataset and split. A wrong split or an unknown entity is an error; a missing validation split is empty."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {', '.join(SPLITS)}, not {split!r}")
    table = spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("split") == split))
    if entities is None:
        return table
    known = {r.entity for r in spark.read.parquet(path).where(F.col("dataset") == dataset).where(F.col("entity").isin(entities)).select("entity").distinct().collect()}
    if unknown := sorted(set(entities) - known):
        raise ValueError(f"unknown entities: {', '.join(unknown)}")
    return table.where(F.col("entity").isin(entities))


def save_series(series: DataFrame, path: str, dataset: str) -> None:
    """A series table on disk, partitioned by dataset and split."""
    series.withColumn("dataset", F.lit(dataset)).write.mode("append").partitionBy("dataset", "split").parquet(path)


#: A file's name without its folder and last suffix.
FILE_STEM = r"([^/]*?)(\.[^./]*)?$"


def read_raw_csv(spark: SparkSession, path: str, name: str = FILE_STEM) -> DataFrame:
    """Raw metric files (timestamp, value, label), named by the first group of `name` in their path: NaN values become null, null labels 0."""
    raw = spark.read.schema("timestamp long, value double, label int").option("header", True).csv(path)
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("entity"), "timestamp",
        F.when(~F.isnan("value"), F.col("value")).alias("value"), F.coalesce("label", F.lit(0)).alias("label"),
    )


def read_value_text(spark: SparkSession, path: str, name: str = FILE_STEM) -> DataFrame:
    """Text series, a value a line or all on one line; the name <entity>_<train end>_<first>_<last anomaly> gives the bounds."""
    whole = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("file"))
    bound = lambda k: F.regexp_extract("file", r"_(\d+)_(\d+)_(\d+)$", k).cast("long")
    values = whole.select(
        F.regexp_extract("file", r"^(.*)_\d+_\d+_\d+$", 1).alias("entity"), bound(1).alias("train_end"), bound(2).alias("first"), bound(3).alias("last"),
        F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("t", "raw"),
    )
    inside = F.col("t").between(F.col("first"), F.col("last"))
    return values.select("entity", "train_end", F.col("t").cast("long").alias("t"), F.col("raw").cast("double").alias("value"), inside.cast("int").alias("label"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result records, a JSON object a line; torn lines are left out, and the run is named by its folder."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_training_log(spark: SparkSession, path: str, name: str = FILE_STEM) -> DataFrame:
    """Epoch, step and losses of log lines that have them, by run (the first group of `name` in the file's path)."""
    line = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("run"))
    part = lambda key: F.regexp_extract("value", rf"{key}\s*[=:]\s*([-+0-9.eE]+)", 1)
    rows = line.select("run", *(part(n).alias(n) for n in ("epoch", "step", "train_loss", "val_loss"))).where("epoch <> ''")
    return rows.select("run", F.expr("try_cast(epoch as int)").alias("epoch"), *(F.expr(f"try_cast({n} as double)").alias(n) for n in ("step", "train_loss", "val_loss")))


def last_steps(log: DataFrame) -> DataFrame:
    """The losses of the last step of each run and epoch."""
    best = F.max_by(F.struct("step", "train_loss", "val_loss"), "step").alias("r")
    return log.groupBy("run", "epoch").agg(best).select("run", "epoch", "r.*")


def manifest(spark: SparkSession, path: str, name: str = FILE_STEM) -> DataFrame:
    """(name, bytes, sha256) of each file that is not empty (Spark lists no empty ones). A file is one row, so it must be below 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", name, 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where("name <> ''")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, status, bytes_changed) of the files of two manifests: ok, drift (other content), missing (in old alone) or extra (in new alone)."""
    side = lambda df, s: df.select("name", F.col("bytes").alias(f"bytes_{s}"), F.col("sha256").alias(f"sha_{s}"))
    both = side(old, "old").join(side(new, "new"), "name", "full")
    status = F.when(F.col("sha_new").isNull(), "missing").when(F.col("sha_old").isNull(), "extra").when(F.col("sha_old") == F.col("sha_new"), "ok").otherwise("drift")
    return both.select("name", status.alias("status"), (F.col("bytes_new") - F.col("bytes_old")).alias("bytes_changed"))


def wide(records: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A result matrix: one row and column a name; the first value where there are more."""
    return records.groupBy(row).pivot(column).agg(F.first(value))
