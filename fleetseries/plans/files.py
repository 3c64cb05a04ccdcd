"""Registered queries that write files from the given tables and read them again. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseries.functions.frames import shared_folder
from fleetseries.operators import detect
from fleetseries.plans.queries import HEAD_K, RECORD_SQL, SCORED_SQL, STRIDE, WIDTH, query, records, rounded, scaled, series
from fleetseries.sources import tables

RECORD = "arm string, entity string, cluster string, seed long, value double"


def folder_name(column):
    """The pattern of a folder that partitionBy(column) makes."""
    return rf"/{column}=([^/]+)/"


@query("a2_raw_csv", "SELECT entity, t AS timestamp, CASE WHEN t % 7 > 0 THEN value END AS value, CASE WHEN t % 5 > 0 THEN label ELSE 0 END AS label FROM series WHERE split = 'test'")
def a2(spark, d):
    path = shared_folder(spark)
    rows = series(spark, d).where("split = 'test'")
    gaps = F.when(F.col("t") % 7 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    out = rows.select("entity", F.col("t").alias("timestamp"), gaps.alias("value"), F.when(F.col("t") % 5 > 0, F.col("label")).alias("label"))
    out.write.partitionBy("entity").option("header", True).csv(path)
    got = tables.read_raw_csv(spark, f"{path}/*", folder_name("entity"))
    return got.select("entity", "timestamp", "value", F.col("label").cast("long").alias("label"))


@query("a3_value_text", """r AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY t) - 1 AS t, value, label FROM series WHERE split = 'test'),
b AS (SELECT entity, count(*) // 2 AS train_end, coalesce(min(CASE WHEN label = 1 THEN t END), 0) AS first, coalesce(max(CASE WHEN label = 1 THEN t END), 0) AS last FROM r GROUP BY entity)
SELECT entity, train_end, t, value, CASE WHEN t BETWEEN first AND last THEN 1 ELSE 0 END AS label FROM r JOIN b USING (entity)""")
def a3(spark, d):
    path = shared_folder(spark)
    rows = series(spark, d).where("split = 'test'")  # t runs from 0 without gaps
    at = F.when(F.col("label") == 1, F.col("t"))
    bounds = rows.groupBy("entity").agg(F.floor(F.count("*") / 2).alias("n"), F.coalesce(F.min(at), F.lit(0)).alias("first"), F.coalesce(F.max(at), F.lit(0)).alias("last"))
    named = rows.join(bounds, "entity").select(F.concat_ws("_", "entity", "n", "first", "last").alias("file"), "t", F.col("value").cast("string").alias("value"))
    named.repartition("file").sortWithinPartitions("file", "t").select("file", "value").write.partitionBy("file").text(path)  # a series is one file
    got = tables.read_value_text(spark, f"{path}/*", folder_name("file"))
    return got.select("entity", "train_end", "t", "value", F.col("label").cast("long").alias("label"))


@query("a4_records", RECORD_SQL + ", x AS (SELECT 1) SELECT arm AS run, entity, cluster, seed, round(value, 6) AS value FROM rec")
def a4(spark, d):
    path = shared_folder(spark)
    r = records(spark, d).select("arm", F.to_json(F.struct("arm", "entity", "cluster", "seed", "value")).alias("line"))
    torn = r.where(F.pmod(F.xxhash64("line"), F.lit(3)) == 0).withColumn("line", F.expr("substring(line, 1, length(line) - 9)"))
    lines = r.unionByName(torn)
    for arm in ("centred", "causal"):
        lines.where(F.col("arm") == arm).select("line").write.text(f"{path}/{arm}")
    got = tables.read_records(spark, f"{path}/*", RECORD)
    return rounded(got.select("run", "entity", "cluster", "seed", "value"), "value")


@query("a5_training_log", """l AS (SELECT entity AS run, CAST(t // 20 AS BIGINT) AS epoch, CAST(t AS DOUBLE) AS step, round(value, 6) AS train_loss, CAST(label AS DOUBLE) AS val_loss FROM series WHERE split = 'test')
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY run, epoch ORDER BY step DESC) = 1""")
def a5(spark, d):
    path = shared_folder(spark)
    rows = series(spark, d).where("split = 'test'").withColumn("run", F.col("entity"))
    line = F.format_string("epoch=%d step: %d train_loss=%.6f val_loss = %d", F.floor(F.col("t") / 20), "t", "value", "label")
    both = rows.select("run", F.explode(F.array(line, F.lit("a line without figures"))).alias("line"))
    both.write.partitionBy("run").text(path)
    got = tables.last_steps(tables.read_training_log(spark, f"{path}/*", folder_name("run")))
    return rounded(got.withColumn("epoch", F.col("epoch").cast("long")), "train_loss")


@query("a6_saved_split", "SELECT entity, cluster, channel, t, round(value, 6) AS value, label FROM series WHERE split = 'val'")
def a6(spark, d):
    path = shared_folder(spark)
    tables.save_series(series(spark, d), path, "hourly")
    return rounded(tables.load_split(spark, path, "hourly", "val").select("entity", "cluster", "channel", "t", "value", "label"), "value")


@query("a7_wide_matrix", RECORD_SQL + ", x AS (SELECT 1) SELECT entity, round(avg(CASE WHEN arm = 'centred' THEN value END), 6) AS centred, round(avg(CASE WHEN arm = 'causal' THEN value END), 6) AS causal FROM rec GROUP BY entity")
def a7(spark, d):
    path = shared_folder(spark)
    means = records(spark, d).groupBy("entity", "arm").agg(F.avg("value").alias("value"))
    tables.wide(means, "entity", "arm", "value").select("entity", "centred", "causal").write.option("header", True).csv(path)
    return rounded(spark.read.schema("entity string, centred double, causal double").option("header", True).csv(path), "centred", "causal")


def snapshot_sql(without: str, more: str) -> str:
    return f"SELECT entity, sum(length(l))::BIGINT AS b, sha256(string_agg(l, '' ORDER BY t)) AS h FROM (SELECT entity, t, t || ',' || (label{more}) || chr(10) AS l FROM series WHERE split = 'test' AND cluster <> '{without}') GROUP BY entity"


@query("g4_manifest_drift", f"""o AS ({snapshot_sql("c0", "")}), n AS ({snapshot_sql("c1", " + CASE WHEN cluster = 'c2' THEN 10 ELSE 0 END")})
SELECT coalesce(o.entity, n.entity) AS name, CASE WHEN n.h IS NULL THEN 'missing' WHEN o.h IS NULL THEN 'extra' WHEN o.h = n.h THEN 'ok' ELSE 'drift' END AS status, n.b - o.b AS bytes_changed FROM o FULL JOIN n USING (entity)""")
def g4(spark, d):
    rows, made = series(spark, d).where("split = 'test'"), []
    for without, changed in (("c0", None), ("c1", "c2")):
        path = shared_folder(spark)
        label = F.col("label") + F.when(F.col("cluster") == changed, 10).otherwise(0) if changed else F.col("label")
        lines = rows.where(F.col("cluster") != without).select("entity", "t", F.concat_ws(",", F.col("t").cast("string"), label.cast("string")).alias("line"))
        lines.repartition("entity").sortWithinPartitions("entity", "t").select("entity", "line").write.partitionBy("entity").text(path)
        made.append(tables.manifest(spark, path, folder_name("entity")))
    return tables.drift(*made)


@query("s2_mean_coverage", "SELECT entity, split, t, cov, round(s0, 6) AS score FROM covered WHERE cov > 0", SCORED_SQL)
def s2(spark, d):
    return rounded(detect.assemble(detect.ma_centred(scaled(spark, d), HEAD_K), WIDTH, STRIDE).where("cov > 0").select("entity", "split", "t", "cov", "score"), "score")
