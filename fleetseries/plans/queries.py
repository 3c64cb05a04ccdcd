"""The registered queries: each operator applied to the given tables, with the same in SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.functions.frames import quantiles, r6, running_sum, settled
from fleetseries.operators import detect, models, prep, reports
from fleetseries.operators.prep import KEYS
from fleetseries.sources import tables
from fleetseries.sources.tables import DAILY_SQL, MULTI_SQL, SERIES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WIDTH, STRIDE, HEAD_K, QUANTILE, TOKENS = 16, 2, 10, 0.95, 16


def query(name: str, sql: str | None = None, base: str = SERIES_SQL) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {base}{',' if sql.lstrip().split()[0].lower() not in ('select',) else ''} {sql}" if base else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.series_from_events(read(spark, sf_dir, "events"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.daily_from_lineitem(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier"))


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.multichannel_from_events(read(spark, sf_dir, "events"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


ENTITY = ["entity", "channel"]
SCALED_SQL = f"""{SERIES_SQL},
stats AS (SELECT entity, avg(value) AS mu, greatest(stddev_pop(value), 1e-4) AS sd FROM series WHERE split = 'train' GROUP BY entity),
scaled AS (SELECT s.*, (s.value - mu) / sd AS x FROM series AS s JOIN stats USING (entity))"""
SCORED_SQL = f"""{SCALED_SQL},
head AS (SELECT *, pow(x - avg(x) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN {HEAD_K // 2} PRECEDING AND {HEAD_K // 2 - 1} FOLLOWING), 2) AS s0,
           count(*) OVER (PARTITION BY entity, split) AS n FROM scaled),
covered AS (SELECT *, greatest(0, least(t, n - {WIDTH}) // {STRIDE} - CAST(ceil(greatest(0, t - {WIDTH} + 1) / {STRIDE}) AS BIGINT) + 1) AS cov FROM head WHERE n >= {WIDTH}),
filled AS (SELECT *, coalesce(last_value(CASE WHEN cov > 0 THEN s0 END IGNORE NULLS) OVER (PARTITION BY entity, split ORDER BY t),
             first_value(CASE WHEN cov > 0 THEN s0 END IGNORE NULLS) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS s1 FROM covered),
scored AS (SELECT *, 0.5 * (s1 + avg(s1) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN {WIDTH // 2} PRECEDING AND {WIDTH // 2 - 1} FOLLOWING)) AS score FROM filled)"""
PRED_SQL = f"""{SCORED_SQL},
thr AS (SELECT entity, quantile_cont(score, {QUANTILE}) AS thr FROM scored WHERE split = 'train' GROUP BY entity),
pred AS (SELECT s.*, thr, CASE WHEN score > thr THEN 1 ELSE 0 END AS pred FROM scored AS s JOIN thr USING (entity) WHERE split = 'test'),
marked AS (SELECT *, sum(CASE WHEN label = 1 AND coalesce(before, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t) AS seg
           FROM (SELECT *, lag(label) OVER (PARTITION BY entity ORDER BY t) AS before FROM pred)),
segs AS (SELECT entity, seg, min(t) AS a, max(t) AS b, count(*) AS length FROM marked WHERE label = 1 GROUP BY ALL)"""


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return prep.scale(s, prep.scale_stats(s, ENTITY), ENTITY)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship path: scaling, centred moving-average head, rolling assembly, impulse term. Written once, as what follows reads it again and again."""
    return settled(detect.impulse(detect.assemble(detect.ma_centred(scaled(spark, sf_dir), HEAD_K), WIDTH, STRIDE), WIDTH))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test points with their score, and whether it passes the training scores' quantile."""
    s = scored(spark, sf_dir)
    return settled(detect.predict(s.where("split = 'test'"), detect.quantile_threshold(s.where("split = 'train'"), ENTITY, QUANTILE), ENTITY))


# -- sources, selection, labels ------------------------------------------------------------------------


@query("a1_series", "SELECT entity, cluster, split, channel, t, round(value, 6) AS value, label FROM series")
def a1(spark, d):
    return rounded(series(spark, d), "value")


@query("b1_entities", "SELECT entity, cluster, split, count(*) AS n, sum(label)::BIGINT AS n_pos FROM series GROUP BY ALL")
def b1(spark, d):
    return series(spark, d).groupBy("entity", "cluster", "split").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


@query("b5_collapse_channels", "SELECT entity, t, max(CASE WHEN channel_label > 0 THEN 1 ELSE 0 END) AS label FROM multi GROUP BY ALL", MULTI_SQL)
def b5(spark, d):
    return prep.collapse_channels(multi(spark, d))


SEGMENT_SQL = """runs AS (SELECT entity, split, channel, t, t - row_number() OVER (PARTITION BY entity, split ORDER BY t) AS g FROM series WHERE label = 1),
seg AS (SELECT entity, split, channel, min(t) AS start, max(t) AS stop, count(*) AS length FROM runs GROUP BY entity, split, channel, g)
"""


@query("b6_segments", SEGMENT_SQL + "SELECT entity, split, channel, start, stop, length FROM seg")
def b6(spark, d):
    return prep.segments(series(spark, d)).drop("run_id")


@query("b3_labels_from_segments", "SELECT entity, split, channel, t, label FROM series")
def b3(spark, d):
    s = series(spark, d)
    return prep.labels_from_segments(s, prep.segments(s)).select(*KEYS, "t", "label")


@query(
    "b7_relative_segments",
    SEGMENT_SQL + "SELECT entity, split, greatest(start - 10, 0) AS rel_start, least(stop - 10, 199) AS rel_stop FROM seg WHERE greatest(start - 10, 0) <= least(stop - 10, 199)",
)
def b7(spark, d):
    cut = prep.relative_segments(prep.segments(series(spark, d)), F.lit(10), F.lit(200))
    return cut.select("entity", "split", "rel_start", "rel_stop")


@query(
    "b8_align_tail",
    """lab AS (SELECT entity, t, label, count(*) OVER (PARTITION BY entity) AS n FROM series WHERE split = 'test'),
sc AS (SELECT entity, t, count(*) OVER (PARTITION BY entity) AS n FROM lab WHERE t >= 5)
SELECT sc.entity, sc.t - 5 AS t, lab.label FROM sc JOIN lab ON lab.entity = sc.entity AND lab.t = sc.t - 5 + lab.n - sc.n""",
)
def b8(spark, d):
    s = series(spark, d).where("split = 'test'")
    return prep.align_tail(s.where("t >= 5").select("entity", (F.col("t") - 5).alias("t")), s.select("entity", "t", "label"), ["entity"]).select("entity", "t", "label")


# -- cleaning and splits -------------------------------------------------------------------------------

@query(
    "c2_value_runs",
    """gap AS (SELECT entity, t FROM daily WHERE t % 97 >= 3),
isl AS (SELECT entity, t, t - row_number() OVER (PARTITION BY entity ORDER BY t) AS g FROM gap)
SELECT entity, min(t) AS start, max(t) + 1 AS stop, count(*) AS length FROM isl GROUP BY entity, g""",
    DAILY_SQL,
)
def c2(spark, d):
    found = prep.segments(daily(spark, d).withColumn("value", F.when(F.col("t") % 97 >= 3, F.col("value"))), F.col("value").isNotNull())
    return found.select("entity", "start", (F.col("stop") + 1).alias("stop"), "length")


@query(
    "c1_mask_straight",
    """a AS (SELECT entity, t, value, CASE WHEN abs(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w) <= 1e-9 THEN 1 ELSE 0 END AS flat
           FROM daily WINDOW w AS (PARTITION BY entity ORDER BY t)),
b AS (SELECT entity, t, t - row_number() OVER (PARTITION BY entity ORDER BY t) AS g FROM a WHERE flat = 1),
c AS (SELECT entity, min(t) - 2 AS lo, max(t) AS hi FROM b GROUP BY entity, g HAVING max(t) - min(t) + 3 >= 8)
SELECT daily.entity, count(*) AS masked FROM daily JOIN c ON c.entity = daily.entity AND daily.t BETWEEN lo AND hi GROUP BY ALL""",
    DAILY_SQL,
)
def c1(spark, d):
    s = daily(spark, d).withColumn("label", F.lit(0))
    return prep.mask_straight(s, 8).where("value is null").groupBy("entity").agg(F.count("*").alias("masked"))


@query(
    "c5_split_tail",
    """m AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM series WHERE split = 'train'),
v AS (SELECT *, CASE WHEN n - 50 >= 10 THEN least(greatest(10, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT)), n - 50) ELSE 0 END AS v FROM m)
SELECT entity, t, CASE WHEN t >= n - v THEN 'val' ELSE 'train' END AS part FROM v""",
)
def c5(spark, d):
    return prep.split_tail(series(spark, d).where("split = 'train'"), 0.2, 10, 50).select("entity", "t", "part")


@query("c7_fill_empty_val", "SELECT entity, split, count(*) AS n FROM (SELECT entity, split FROM series WHERE entity <> 'u03' OR split <> 'val' UNION ALL SELECT entity, 'val' FROM series WHERE entity = 'u03' AND split = 'train') GROUP BY ALL")
def c7(spark, d):
    s = series(spark, d).where("entity <> 'u03' or split <> 'val'")
    return prep.fill_empty_val(s).groupBy("entity", "split").agg(F.count("*").alias("n"))


@query(
    "c8_shards",
    """m AS (SELECT entity, t, count(*) OVER (PARTITION BY entity) AS n FROM series WHERE split = 'train')
SELECT entity, t, CASE WHEN t < n * 10 // 90 THEN 0 WHEN t < n * 20 // 90 THEN 1 WHEN t < n * 40 // 90 THEN 2 WHEN t < n * 60 // 90 THEN 3 ELSE 4 END AS shard FROM m""",
)
def c8(spark, d):
    return prep.shards(series(spark, d).where("split = 'train'"), (10, 10, 20, 20, 30)).select("entity", "t", "shard")


@query(
    "c14_reveal_events",
    SEGMENT_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY entity, split ORDER BY start) AS k, count(*) OVER (PARTITION BY entity, split) AS c FROM seg)
SELECT s.entity, s.split, s.t FROM series AS s JOIN r ON r.entity = s.entity AND r.split = s.split AND k = 3 AND c > 3 WHERE s.t > r.stop""",
)
def c14(spark, d):
    s = series(spark, d)
    return prep.reveal_events(s, prep.segments(s), 3).select("entity", "split", "t")


# -- scaling and windows -------------------------------------------------------------------------------


@query("n1_scale", "SELECT entity, split, t, round(x, 6) AS x FROM scaled", SCALED_SQL)
def n1(spark, d):
    return rounded(scaled(spark, d).select("entity", "split", "t", "x"), "x")


@query(
    "n2_pooled_scale",
    """SELECT cluster, count(*) AS n, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS sd FROM series WHERE split = 'train' GROUP BY cluster""",
)
def n2(spark, d):
    return rounded(prep.scale_stats(series(spark, d), ["cluster"]), "mu", "sd")


WINDOW_SQL = f"""win AS (SELECT s.entity, s.split, s.t AS w_start, list(p.value ORDER BY p.t) AS w FROM series AS s JOIN series AS p
ON p.entity = s.entity AND p.split = s.split AND p.t BETWEEN s.t AND s.t + {WIDTH - 1} WHERE s.t % {STRIDE} = 0 GROUP BY ALL HAVING count(*) = {WIDTH})"""


@query("w1_windows", WINDOW_SQL + " SELECT entity, split, w_start, round(list_sum(w), 6) AS total, round(w[1], 6) AS first, round(w[-1], 6) AS last FROM win")
def w1(spark, d):
    w = prep.sliding_windows(series(spark, d), WIDTH, STRIDE)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return w.select("entity", "split", "w_start", r6(total).alias("total"), r6(F.get("w", F.lit(0))).alias("first"), r6(F.element_at("w", -1)).alias("last"))


@query("n3_window_znorm", WINDOW_SQL + " SELECT entity, split, w_start, round((w[1] - list_avg(w)) / greatest(list_stddev_samp(w), 1e-4), 6) AS z_first FROM win")
def n3(spark, d):
    w = prep.sliding_windows(series(spark, d), WIDTH, STRIDE)
    return w.select("entity", "split", "w_start", r6(F.get(prep.standardise_window(F.col("w")), F.lit(0))).alias("z_first"))


@query("n4_window_minmax", WINDOW_SQL + " SELECT entity, split, w_start, round((w[1] - list_min(w)) / greatest(list_max(w) - list_min(w), 1e-6), 6) AS m_first FROM win")
def n4(spark, d):
    w = prep.sliding_windows(series(spark, d), WIDTH, STRIDE)
    return w.select("entity", "split", "w_start", r6(F.get(prep.minmax_window(F.col("w")), F.lit(0))).alias("m_first"))


@query("w2_window_count", f"SELECT entity, split, CASE WHEN count(*) < {WIDTH} THEN 0 ELSE (count(*) - {WIDTH}) // {STRIDE} + 1 END AS n_windows FROM series GROUP BY ALL")
def w2(spark, d):
    return series(spark, d).groupBy("entity", "split").agg(prep.n_windows(F.count("*"), WIDTH, STRIDE).alias("n_windows"))


@query("w4_centred_average", "SELECT entity, split, t, round(avg(value) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS m FROM series")
def w4(spark, d):
    return prep.centred_average(series(spark, d), 10, "m").select("entity", "split", "t", r6("m").alias("m"))


@query("w5_causal_average", "SELECT entity, split, t, round(coalesce(avg(value) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), value), 6) AS m FROM series")
def w5(spark, d):
    return prep.causal_average(series(spark, d), 10, "m").select("entity", "split", "t", r6("m").alias("m"))


DETREND_SQL = """line AS (SELECT entity, regr_slope(value, t) AS m, regr_intercept(value, t) AS c FROM daily GROUP BY entity),
flat AS (SELECT entity, t, value - m * t - c AS r FROM daily JOIN line USING (entity)),
det AS (SELECT flat.entity, t, (r - a) / (s + 1e-9) AS z FROM flat JOIN (SELECT entity, avg(r) AS a, stddev_pop(r) AS s FROM flat GROUP BY entity) AS q USING (entity))"""


@query("n5_detrend", DETREND_SQL + " SELECT entity, round(sum(z * z), 4) AS energy, round(max(z), 4) AS top, count(*) AS n FROM det GROUP BY entity", DAILY_SQL)
def n5(spark, d):
    z = prep.detrend(daily(spark, d), ["entity"])
    return z.groupBy("entity").agg(F.round(F.sum(F.col("d") * F.col("d")), 4).alias("energy"), F.round(F.max("d"), 4).alias("top"), F.count("*").alias("n"))


@query(
    "w8_acf_at_lag",
    DETREND_SQL + """, nxt AS (SELECT entity, z, lead(z, 7) OVER (PARTITION BY entity ORDER BY t) AS y FROM det)
SELECT entity, round(sum(z * y) / sum(z * z), 6) AS acf FROM nxt GROUP BY entity""",
    DAILY_SQL,
)
def w8(spark, d):
    return rounded(prep.detrended_acf_at(daily(spark, d), 7, ["entity"]), "acf")


@query("w11_envelope", "SELECT entity, (t * 50) // n AS bucket, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 4) AS mean FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM daily) GROUP BY ALL", DAILY_SQL)
def w11(spark, d):
    e = prep.envelope(daily(spark, d), 50, ["entity"])
    return rounded(e.withColumns({"mean": F.round("mean", 4), "bucket": F.col("bucket").cast("long")}), "low", "high")


@query(
    "n8_rank_fraction",
    """h AS (SELECT *, rank() OVER (PARTITION BY entity, split ORDER BY round(value, 1)) AS r, count(*) OVER (PARTITION BY entity, split, round(value, 1)) AS c, count(*) OVER (PARTITION BY entity, split) AS n FROM series)
SELECT entity, split, t, round((r + (c - 1) / 2.0) / n, 6) AS f FROM h""",
)
def n8(spark, d):
    s = series(spark, d).withColumn("v", F.round("value", 1))
    n = s.groupBy("entity", "split").agg(F.count("*").alias("n"))
    return prep.average_rank(s, ["entity", "split"], "v", "r").join(n, ["entity", "split"]).select("entity", "split", "t", r6(F.col("r") / F.col("n")).alias("f"))


# -- heads and assembly --------------------------------------------------------------------------------


@query("h1_ma_centred", "SELECT entity, split, t, round(s0, 6) AS score FROM head", SCORED_SQL)
def h1(spark, d):
    return rounded(detect.ma_centred(scaled(spark, d), HEAD_K).select("entity", "split", "t", "score"), "score")


@query("h2_ma_causal", "SELECT entity, split, t, round(pow(x - coalesce(avg(x) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), x), 2), 6) AS score FROM scaled", SCALED_SQL)
def h2(spark, d):
    return rounded(detect.ma_causal(scaled(spark, d), 10).select("entity", "split", "t", "score"), "score")


@query("h3_diff1", "SELECT entity, split, t, round(pow(coalesce(x - lag(x) OVER w, lead(x) OVER w - x, 0), 2), 6) AS score FROM scaled WINDOW w AS (PARTITION BY entity, split ORDER BY t)", SCALED_SQL)
def h3(spark, d):
    return rounded(detect.diff1(scaled(spark, d)).select("entity", "split", "t", "score"), "score")


@query("h4_random")
def h4(spark, d):
    return rounded(detect.random_head(series(spark, d)).select("entity", "split", "t", "score"), "score")


@query("h5_autoregression")
def h5(spark, d):
    s = scaled(spark, d)
    models_ = detect.ar_solve(detect.ar_stats(s.where("split = 'train'"), ["entity"]), ["entity"])
    return rounded(detect.ar_score(s, models_, ["entity"]).select("entity", "split", "t", "score"), "score")


@query("h9_autoregression_by_cluster")
def h9(spark, d):
    s = scaled(spark, d)
    models_ = detect.ar_solve(detect.ar_stats(s.where("split = 'train'"), ["cluster"]), ["cluster"])
    return rounded(detect.ar_score(s, models_, ["cluster"]).select("entity", "split", "t", "score"), "score")


@query(
    "h6_window_moments",
    f"""win AS (SELECT s.entity, s.t, p.t - s.t AS i, p.x FROM scaled AS s JOIN scaled AS p ON p.entity = s.entity AND p.split = s.split AND p.t BETWEEN s.t AND s.t + {WIDTH - 1}
        WHERE s.split = 'train' AND s.t % {STRIDE} = 0),
ok AS (SELECT *, count(*) OVER (PARTITION BY entity, t) AS c FROM win)
SELECT entity, i, round(sum(x), 4) AS s, count(*) AS n FROM ok WHERE c = {WIDTH} GROUP BY entity, i""",
    SCALED_SQL,
)
def h6(spark, d):
    w = prep.sliding_windows(scaled(spark, d).where("split = 'train'"), WIDTH, STRIDE, "x")
    g = detect.gram(w, ["entity"], "w")
    return g.select("entity", "n", F.posexplode("s").alias("i", "s")).select("entity", F.col("i").cast("long").alias("i"), (F.round("s", 4) + 0.0).alias("s"), "n")


def window_scores(spark, d, matrix):
    s = scaled(spark, d)
    w = prep.sliding_windows(s, WIDTH, STRIDE, "x")
    fitted = detect.subspace_models(detect.gram(w.where("split = 'train'"), ["entity"], "w"), ["entity"])
    return rounded(detect.overlap_add(detect.apply_matrix(w, fitted, ["entity"], matrix)), "score")


@query("h7_pca_residual")
def h7(spark, d):
    return window_scores(spark, d, "residual")


@query("h8_gauss_whitened")
def h8(spark, d):
    return window_scores(spark, d, "white")


@query("s1_coverage_sum", "SELECT entity, split, t, cov, round(s0 * cov, 6) AS score FROM covered WHERE cov > 0", SCORED_SQL)
def s1(spark, d):
    return rounded(detect.assemble(detect.ma_centred(scaled(spark, d), HEAD_K), WIDTH, STRIDE, "sum").where("cov > 0").select("entity", "split", "t", "cov", "score"), "score")


@query("s3_fill_uncovered", "SELECT entity, split, t, round(s1, 6) AS score FROM filled", SCORED_SQL)
def s3(spark, d):
    return rounded(detect.assemble(detect.ma_centred(scaled(spark, d), HEAD_K), WIDTH, STRIDE).select("entity", "split", "t", "score"), "score")


@query("s4_impulse", "SELECT entity, split, t, round(score, 6) AS score FROM scored", SCORED_SQL)
def s4(spark, d):
    return rounded(scored(spark, d).select("entity", "split", "t", "score"), "score")


@query(
    "s5_channel_aggregates",
    """g AS (SELECT entity, t, list_sort(list(value / 100)) AS s, avg(value / 100) AS mean, max(value / 100) AS top, quantile_cont(value / 100, 0.5) AS mid, quantile_cont(value / 100, 0.9) AS high,
       sum(value / 100) AS total, sqrt(sum(value * value / 10000)) AS l2, count(*) AS n, sum(CASE WHEN value / 100 > 1 THEN 1 ELSE 0 END) AS above FROM multi GROUP BY entity, t),
e AS (SELECT *, list_transform(s, lambda x: exp(x - top)) AS w, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS INTEGER) AS c FROM g)
SELECT entity, t, round(mean, 9) AS mean, round(top, 9) AS max, round(total, 9) AS sum, round(mid, 9) AS median, round(l2 / sqrt(n), 9) AS rms, round(l2, 9) AS l2,
 round(pow(list_sum(list_transform(s, lambda x: pow(abs(x), 3))), 1 / CAST(3 AS DOUBLE)), 9) AS lp_norm, round(top + ln(list_sum(w)), 9) AS logsumexp,
 round(CASE WHEN n = 1 THEN s[-1] ELSE (s[-1] + s[-2]) / 2 END, 9) AS topk, round(high, 9) AS quantile,
 round(list_sum(s[c + 1:n - c]) / (n - 2 * c), 9) AS trimmed_mean, round(list_sum(list_transform(s, lambda x: least(greatest(x, s[c + 1]), s[n - c]))) / n, 9) AS winsorized_mean,
 round(list_sum(list_transform(s, lambda x: x * exp(x - top))) / list_sum(w), 9) AS softmax, round(0.5 * (mean + top), 9) AS mean_max_mix, round(above / n, 9) AS fraction_above FROM e""",
    MULTI_SQL,
)
def s5(spark, d):
    a = detect.channel_aggregates(multi(spark, d).withColumn("score", F.col("value") / 100), ["entity", "t"])
    return a.withColumns({c: F.round(c, 9) + 0.0 for c in a.columns if c not in ("entity", "t")})


# -- thresholds and metrics ----------------------------------------------------------------------------


@query("t1_quantile_threshold", "SELECT entity, round(thr, 6) AS thr FROM thr", PRED_SQL)
def t1(spark, d):
    s = scored(spark, d).where("split = 'train'")
    return rounded(detect.quantile_threshold(s, ["entity"], QUANTILE), "thr")


@query("t8_cluster_threshold", "SELECT cluster, round(quantile_cont(score, 0.99), 6) AS q99, round(quantile_cont(score, 0.995), 6) AS q995 FROM scored WHERE split = 'train' GROUP BY cluster", SCORED_SQL)
def t8(spark, d):
    s = scored(spark, d).where("split = 'train'")
    return rounded(quantiles(s, ["cluster"], "score", {"q99": 0.99, "q995": 0.995}), "q99", "q995")


@query(
    "t4_grid_threshold",
    """e AS (SELECT entity, min(score) AS lo, max(score) AS hi, sum(label) AS pos FROM pred GROUP BY entity),
g AS (SELECT entity, k, lo + k * ((hi - lo) / 399) AS thr, pos FROM e CROSS JOIN (SELECT unnest(generate_series(0, 399)) AS k)),
f AS (SELECT g.entity, g.k, g.thr, 2 * sum(CASE WHEN p.score > g.thr THEN p.label ELSE 0 END) / (sum(CASE WHEN p.score > g.thr THEN 1 ELSE 0 END) + any_value(g.pos)) AS f1
      FROM g JOIN pred AS p USING (entity) GROUP BY g.entity, g.k, g.thr)
SELECT entity, round(thr, 6) AS thr, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY f1 DESC, k) AS r FROM f) WHERE r = 1""",
    PRED_SQL,
)
def t4(spark, d):
    return rounded(detect.grid_threshold(scored(spark, d).where("split = 'test'"), ["entity"]), "thr", "f1")


CONFUSION_SQL = """SELECT entity, sum(pred * label)::BIGINT AS tp, sum(pred * (1 - label))::BIGINT AS fp, sum((1 - pred) * label)::BIGINT AS fn, sum((1 - pred) * (1 - label))::BIGINT AS tn,
round(coalesce(sum(pred * label) / nullif(sum(pred), 0), 0), 6) AS precision, round(coalesce(sum(pred * label) / nullif(sum(label), 0), 0), 6) AS recall,
round(coalesce(2 * sum(pred * label) / nullif(sum(pred) + sum(label), 0), 0), 6) AS f1, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
round(coalesce(sum(pred * (1 - label)) / nullif(sum(1 - label), 0), 0), 6) AS fpr FROM {0} GROUP BY entity"""
RATES = ("precision", "recall", "f1", "accuracy", "fpr")


@query("j1_confusion", CONFUSION_SQL.format("pred"), PRED_SQL)
def j1(spark, d):
    return rounded(detect.confusion(predicted(spark, d), ["entity"]), *RATES)


@query(
    "j2_point_adjusted",
    "adj AS (SELECT m.entity, m.label, CASE WHEN m.label = 1 THEN max(m.pred) OVER (PARTITION BY m.entity, m.label, m.seg) ELSE m.pred END AS pred FROM marked AS m) " + CONFUSION_SQL.format("adj"),
    PRED_SQL,
)
def j2(spark, d):
    return rounded(detect.confusion(detect.point_adjust(predicted(spark, d), "pred"), ["entity"]), *RATES)


@query("j3_adjusted_scores", "SELECT entity, t, round(CASE WHEN label = 1 THEN max(score) OVER (PARTITION BY entity, label, seg) ELSE score END, 6) AS score FROM marked", PRED_SQL)
def j3(spark, d):
    return rounded(detect.point_adjust(predicted(spark, d), "score").select("entity", "t", "score"), "score")


@query(
    "j4_auroc",
    """r AS (SELECT entity, label, rank() OVER (PARTITION BY entity ORDER BY score) + (count(*) OVER (PARTITION BY entity, score) - 1) / 2.0 AS r FROM pred)
SELECT entity, round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0), 6) AS auroc FROM r GROUP BY entity""",
    PRED_SQL,
)
def j4(spark, d):
    return rounded(detect.auroc(predicted(spark, d), ["entity"]), "auroc")


CURVE_SQL = """g AS (SELECT entity, score, sum(label) AS pos, count(*) AS n FROM pred GROUP BY entity, score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY entity) AS al FROM g WINDOW w AS (PARTITION BY entity ORDER BY score DESC)),
f AS (SELECT *, tp / seen AS p, tp / al AS r, 2 * tp / (seen + al) AS f1 FROM c)
"""


@query("j5_average_precision", CURVE_SQL + "SELECT entity, round(sum(pos / al * p), 6) AS auprc FROM f GROUP BY entity", PRED_SQL)
def j5(spark, d):
    return rounded(detect.auprc(predicted(spark, d), ["entity"]).select("entity", "auprc"), "auprc")


@query("j6_best_f1", CURVE_SQL + "SELECT entity, round(max(f1), 6) AS best_f1 FROM f GROUP BY entity", PRED_SQL)
def j6(spark, d):
    return rounded(detect.auprc(predicted(spark, d), ["entity"]).select("entity", "best_f1"), "best_f1")


@query(
    "j7_event_overlap",
    """pr AS (SELECT entity, t - row_number() OVER (PARTITION BY entity ORDER BY t) AS g, t FROM pred WHERE pred = 1),
ps AS (SELECT entity, g, min(t) AS c, max(t) AS d FROM pr GROUP BY entity, g),
ht AS (SELECT entity, count(*) AS n_true, sum(CASE WHEN EXISTS (SELECT 1 FROM ps WHERE ps.entity = segs.entity AND ps.c <= segs.b AND segs.a <= ps.d) THEN 1 ELSE 0 END) AS hit_true FROM segs GROUP BY entity),
hp AS (SELECT entity, count(*) AS n_pred, sum(CASE WHEN EXISTS (SELECT 1 FROM segs WHERE ps.entity = segs.entity AND ps.c <= segs.b AND segs.a <= ps.d) THEN 1 ELSE 0 END) AS hit_pred FROM ps GROUP BY entity)
SELECT entity, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(hit_true, 0)::BIGINT AS hit_true, coalesce(hit_pred, 0)::BIGINT AS hit_pred,
 round(coalesce(hit_pred / n_pred, 0), 6) AS precision, round(coalesce(hit_true / n_true, 0), 6) AS recall,
 round(coalesce(2 * (hit_pred / n_pred) * (hit_true / n_true) / nullif(hit_pred / n_pred + hit_true / n_true, 0), 0), 6) AS f1 FROM ht FULL JOIN hp USING (entity)""",
    PRED_SQL,
)
def j7(spark, d):
    p = predicted(spark, d)
    return rounded(detect.event_overlap(prep.segments(p), prep.segments(p, F.col("pred") == 1), ["entity"]), "precision", "recall", "f1")


@query(
    "j8_detection_delay",
    """e AS (SELECT entity, seg, min(CASE WHEN pred = 1 THEN t END) - min(t) AS hit, count(*) AS length FROM marked WHERE label = 1 GROUP BY ALL)
SELECT entity, round(avg(coalesce(hit, length)), 6) AS mean_delay, count(hit) AS found, count(*) AS n_segments FROM e GROUP BY entity""",
    PRED_SQL,
)
def j8(spark, d):
    return rounded(detect.detection_delay(predicted(spark, d), ["entity"]), "mean_delay")


@query(
    "j14_top1_hit",
    """b AS (SELECT entity, t AS t_top FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, t) AS r FROM pred) WHERE r = 1)
SELECT b.entity, b.t_top, CASE WHEN min(abs(p.t - b.t_top)) <= 5 THEN 1 WHEN count(p.t) > 0 THEN 0 END AS top1 FROM b LEFT JOIN pred AS p ON p.entity = b.entity AND p.label = 1 GROUP BY ALL""",
    PRED_SQL,
)
def j14(spark, d):
    return detect.score_extremes(predicted(spark, d), ["entity"], 5)


@query(
    "j17_segment_profile",
    SEGMENT_SQL
    + """, q AS (SELECT entity, split, count(*) AS n_segments, round(quantile_cont(length, 0.5), 6) AS mid, round(quantile_cont(length, 0.9), 6) AS p90, max(length) AS longest FROM seg GROUP BY ALL)
SELECT s.entity, s.split, s.n, s.rate, q.n_segments, q.mid, q.p90, q.longest FROM (SELECT entity, split, count(*) AS n, round(avg(label), 6) AS rate FROM series GROUP BY ALL) AS s LEFT JOIN q USING (entity, split)""",
)
def j17(spark, d):
    s = series(spark, d)
    lengths = prep.segments(s).groupBy("entity", "split").agg(F.count("*").alias("n_segments"), F.percentile("length", F.lit(0.5)).alias("mid"), F.percentile("length", F.lit(0.9)).alias("p90"), F.max("length").alias("longest"))
    return rounded(s.groupBy("entity", "split").agg(F.count("*").alias("n"), F.avg("label").alias("rate")).join(lengths, ["entity", "split"], "left"), "rate", "mid", "p90")


# -- codebooks and tokens ------------------------------------------------------------------------------

K = 16
ASSIGN_SQL = f"""vec AS (SELECT label AS client, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
book AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS code, v AS c FROM (SELECT * FROM vec ORDER BY vec_id LIMIT {K})),
dist AS (SELECT client, vec_id, v, code, list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(v[i] - c[i], 2))) AS d2 FROM vec CROSS JOIN book),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, code) AS r FROM dist),
asg AS (SELECT a.client, a.vec_id, a.v, a.code, a.d2, b.d2 AS d2_next FROM near AS a JOIN near AS b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2),
st AS (SELECT client, code, dim, count(*) AS n, sum(v[dim + 1]) AS m FROM asg CROSS JOIN (SELECT unnest(range(0, 64)) AS dim) GROUP BY ALL)"""


def assigned(spark, d):
    v = tables.vectors_from_embeddings(read(spark, d, "embeddings"))
    return models.assign(v, models.first_codebook(v, K))


@query("l1_nearest_code", "SELECT vec_id, code, round(d2, 6) AS d2 FROM asg", ASSIGN_SQL)
def l1(spark, d):
    return rounded(assigned(spark, d).select("vec_id", F.col("code").cast("long").alias("code"), "d2"), "d2")


@query("l3_round_stats", "SELECT client, code, dim, n, round(m, 6) AS m FROM st", ASSIGN_SQL)
def l3(spark, d):
    s = models.round_stats(assigned(spark, d))
    return rounded(s.withColumns({"code": F.col("code").cast("long"), "dim": F.col("dim").cast("long")}), "m")


@query("l4_merge", f"g AS (SELECT code, dim, sum(n) AS n, sum(m) AS m FROM st GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY dim) AS al FROM g) SELECT code, dim, round(m / ((n + 1e-5) / (al + {K} * 1e-5) * al), 6) AS x FROM t", ASSIGN_SQL)
def l4(spark, d):
    m = models.merge_stats(models.round_stats(assigned(spark, d)), K)
    return rounded(m.withColumns({"code": F.col("code").cast("long"), "dim": F.col("dim").cast("long")}), "x")


@query("l7_merge_uniform", "SELECT code, dim, round(avg(m / n), 6) AS x, count(*) AS n_clients FROM st GROUP BY ALL", ASSIGN_SQL)
def l7(spark, d):
    m = models.merge_uniform(models.round_stats(assigned(spark, d)))
    return rounded(m.withColumns({"code": F.col("code").cast("long"), "dim": F.col("dim").cast("long")}), "x")


@query("l12_usage", f"c AS (SELECT code, count(*) AS n FROM asg GROUP BY code), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT count(*) AS active, {K} - count(*) AS dead, round(exp(-sum(p * ln(p))), 6) AS perplexity, round(max(p), 6) AS top_share FROM p", ASSIGN_SQL)
def l12(spark, d):
    return rounded(models.usage(assigned(spark, d), K), "perplexity", "top_share")


@query("l15_margin", "SELECT code, count(*) AS n, round(avg((sqrt(d2_next) - sqrt(d2)) / (sqrt(d2_next) + sqrt(d2))), 6) AS margin FROM asg GROUP BY code", ASSIGN_SQL)
def l15(spark, d):
    a, b = F.sqrt("d2"), F.sqrt("d2_next")
    return rounded(assigned(spark, d).groupBy(F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n"), F.avg((b - a) / (b + a)).alias("margin")), "margin")


TOKEN_SQL = f"""{SCALED_SQL},
tok AS (SELECT entity, split, t // {WIDTH} AS win, t % {WIDTH} AS pos, CAST(least(greatest(floor((x + 3) / 0.375), 0), 15) AS INTEGER) AS token FROM scaled),
uni AS (SELECT entity, token, count(*) AS n FROM tok WHERE split = 'train' GROUP BY ALL)"""


def tokens(spark, d):
    s = scaled(spark, d)
    return s.select("entity", "split", F.floor(F.col("t") / WIDTH).alias("win"), (F.col("t") % WIDTH).alias("pos"), tables.quantise(F.col("x"), TOKENS).alias("token"))


def train_counts(spark, d):
    return models.unigrams(tokens(spark, d).where("split = 'train'"))


@query("p1_unigrams", "SELECT entity, token, n FROM uni", TOKEN_SQL)
def p1(spark, d):
    return train_counts(spark, d)


@query("p2_position_counts", "SELECT pos, token, count(*) AS n FROM tok WHERE split = 'train' GROUP BY ALL", TOKEN_SQL)
def p2(spark, d):
    return tokens(spark, d).where("split = 'train'").groupBy("pos", "token").agg(F.count("*").alias("n"))


@query("p3_ngrams", "h AS (SELECT lag(token, 2) OVER w AS a, lag(token, 1) OVER w AS b, token FROM tok WINDOW w AS (PARTITION BY entity, split, win ORDER BY pos)) SELECT a, b, token, count(*) AS n FROM h GROUP BY ALL", TOKEN_SQL)
def p3(spark, d):
    return models.ngrams(tokens(spark, d))


@query("p10_vocabulary_agreement", """gr AS (SELECT e.entity, v.token, coalesce(u.n, 0) AS n FROM (SELECT DISTINCT entity FROM uni) AS e CROSS JOIN (SELECT DISTINCT token FROM uni) AS v LEFT JOIN uni AS u USING (entity, token)),
pp AS (SELECT *, (n + 1.0) / (sum(n) OVER (PARTITION BY entity) + 16.0) AS p FROM gr)
SELECT a.entity AS ea, b.entity AS eb, round(sum(0.5 * (a.p * ln(a.p / ((a.p + b.p) / 2)) + b.p * ln(b.p / ((a.p + b.p) / 2)))), 6) AS js,
 round(sum(CASE WHEN a.n > 0 AND b.n > 0 THEN 1 ELSE 0 END) / sum(CASE WHEN a.n > 0 OR b.n > 0 THEN 1 ELSE 0 END), 6) AS jaccard FROM pp AS a JOIN pp AS b USING (token) WHERE a.entity < b.entity GROUP BY ALL""", TOKEN_SQL)
def p10(spark, d):
    return rounded(models.js_divergence(train_counts(spark, d), TOKENS), "js", "jaccard")


@query("p11_mutual_information", """q AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY entity) / sum(n) OVER () AS pe, sum(n) OVER (PARTITION BY token) / sum(n) OVER () AS pt FROM uni)
SELECT round(sum(p * ln(p / (pe * pt))), 6) AS mi, round(-sum(p * ln(pt)), 6) AS h, round(sum(p * ln(p / (pe * pt))) / -sum(p * ln(pt)), 6) AS normalised FROM q""", TOKEN_SQL)
def p11(spark, d):
    return rounded(models.mutual_information(train_counts(spark, d)), "mi", "h", "normalised")


@query("p15_leave_one_out", """al AS (SELECT token, sum(n) AS al FROM uni GROUP BY token),
o AS (SELECT e.entity, al.token, al.al - coalesce(u.n, 0) AS others FROM (SELECT DISTINCT entity FROM uni) AS e CROSS JOIN al LEFT JOIN uni AS u USING (entity, token))
SELECT entity, token, others::BIGINT AS others, round((others + 1.0) / (sum(others) OVER (PARTITION BY entity) + 16.0), 6) AS p FROM o""", TOKEN_SQL)
def p15(spark, d):
    return rounded(models.leave_one_out(train_counts(spark, d), TOKENS), "p")


# -- fleet, reports, quality ---------------------------------------------------------------------------


@query("f1_pooled_moments", """m AS (SELECT entity, cluster, count(*) AS n, avg(value) AS mean, var_pop(value) AS var FROM series GROUP BY ALL)
SELECT cluster, round(sum(n * mean) / sum(n), 6) AS mean, round(sum(n * (var + mean * mean)) / sum(n) - pow(sum(n * mean) / sum(n), 2), 4) AS var, round(sum(n * var) / sum(n), 4) AS inner FROM m GROUP BY cluster""".replace("AS inner", 'AS "inner"'))
def f1(spark, d):
    m = series(spark, d).groupBy("entity", "cluster").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return models.pooled_moments(m, ["cluster"]).select("cluster", r6("mean").alias("mean"), F.round("var", 4).alias("var"), F.round("inner", 4).alias("inner"))


@query("f2_weighted_mean", "m AS (SELECT entity, split, count(*) AS n, avg(value) AS v FROM series GROUP BY ALL) SELECT split AS name, 0 AS idx, round(sum(n * v) / sum(n), 6) AS value FROM m GROUP BY split")
def f2(spark, d):
    m = series(spark, d).groupBy("entity", F.col("split").alias("name")).agg(F.count("*").alias("weight"), F.avg("value").alias("value")).withColumn("idx", F.lit(0))
    return rounded(models.weighted_mean(m), "value")


@query("f4_robust_rates", """m AS (SELECT entity, split, avg(label) AS v FROM series GROUP BY ALL), g AS (SELECT split, list_sort(list(v)) AS s, avg(v) AS mean, count(*) AS n FROM m GROUP BY split)
SELECT split, round(mean, 6) AS mean, round(s[(n + 1) // 2], 6) AS median, round(list_sum(s[2:n - 1]) / (n - 2), 6) AS trimmed FROM g""")
def f4(spark, d):
    m = series(spark, d).groupBy("entity", "split").agg(F.avg("label").alias("rate"))
    return rounded(models.robust_rates(m, ["split"], "rate"), "mean", "median", "trimmed")


RECORD_SQL = """r0 AS (SELECT entity, cluster, t % 2 AS seed, value, label, avg(value) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS c,
        coalesce(avg(value) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), value) AS k FROM series),
rec AS (SELECT 'centred' AS arm, entity, cluster, seed, avg(abs(value - c)) AS value FROM r0 GROUP BY ALL UNION ALL
        SELECT 'causal', entity, cluster, seed, avg(abs(value - k)) FROM r0 GROUP BY ALL),
pr AS (SELECT a.seed, a.entity, a.value AS va, b.value AS vb, a.value - b.value AS d FROM rec AS a JOIN rec AS b ON a.arm = 'centred' AND b.arm = 'causal' AND a.seed = b.seed AND a.entity = b.entity)
"""


#: Of the equivalence test: about the mean difference of the two arms, so that neither verdict is sure.
MARGIN = 2.0


def records(spark, d):
    """Mean absolute errors of two moving averages as arms, by entity and parity of the step as seed."""
    s = prep.causal_average(prep.centred_average(series(spark, d), 10, "c"), 10, "k").withColumn("seed", F.col("t") % 2)
    arm = lambda name, c: s.groupBy(F.lit(name).alias("arm"), "entity", "cluster", "seed").agg(F.avg(F.abs(F.col("value") - F.col(c))).alias("value"))
    return arm("centred", "c").unionByName(arm("causal", "k"))


def paired(spark, d):
    return reports.pairs(records(spark, d), "centred", "causal")


@query("r2_micro_mean", RECORD_SQL + ", x AS (SELECT 1) SELECT arm, cluster, round(avg(value), 6) AS value, count(*) AS n FROM rec GROUP BY GROUPING SETS ((arm), (arm, cluster))")
def r2(spark, d):
    return rounded(reports.micro_mean(records(spark, d)), "value")


@query("r3_two_level", RECORD_SQL + ", s AS (SELECT arm, seed, avg(value) AS m, min(value) AS worst FROM rec GROUP BY ALL) SELECT arm, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS sd, round(avg(worst), 6) AS worst, count(*) AS n_seeds FROM s GROUP BY arm")
def r3(spark, d):
    return rounded(reports.two_level(records(spark, d)), "mean", "sd", "worst")


@query("r4_contrast", RECORD_SQL + """, x AS (SELECT 1) SELECT count(*) AS n, round(avg(d), 6) AS delta, round(stddev_samp(d), 6) AS sd, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::BIGINT AS wins, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)::BIGINT AS losses,
sum(CASE WHEN d = 0 THEN 1 ELSE 0 END)::BIGINT AS ties, round(quantile_cont(d, 0.5), 6) AS median_delta, round(1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS ci95, round(2.8 * stddev_samp(d) / sqrt(count(*)), 6) AS m80 FROM pr""")
def r4(spark, d):
    return rounded(reports.contrast(paired(spark, d)), "delta", "sd", "median_delta", "ci95", "m80")


@query("r6_matched_pairs", RECORD_SQL + ", x AS (SELECT 1) SELECT seed, entity, round(va, 6) AS va, round(vb, 6) AS vb, 'matched' AS status FROM pr")
def r6_(spark, d):
    return rounded(paired(spark, d), "va", "vb")


@query("r7_wilcoxon", RECORD_SQL + """, a AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM pr WHERE d <> 0),
t AS (SELECT sum(m * m * m - m) AS tie FROM (SELECT count(*) AS m FROM a GROUP BY abs(d)))
SELECT count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 6) AS w_plus,
 round((sum(CASE WHEN d > 0 THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - any_value(t.tie) / 48.0), 6) AS z FROM a CROSS JOIN t""")
def r7(spark, d):
    return rounded(reports.wilcoxon(paired(spark, d)), "w_plus", "z")


@query("r8_sign_test")
def r8(spark, d):
    return rounded(reports.sign_test(paired(spark, d)), "p")


@query("r10_hodges_lehmann", RECORD_SQL + ", x AS (SELECT 1) SELECT round(quantile_cont((a.d + b.d) / 2, 0.5), 6) AS hl, count(*) AS n_walsh FROM pr AS a JOIN pr AS b ON a.seed || '/' || a.entity <= b.seed || '/' || b.entity")
def r10(spark, d):
    return rounded(reports.hodges_lehmann(paired(spark, d)), "hl")


@query("r13_equivalence", RECORD_SQL + f""", c AS (SELECT count(*) AS n, avg(d) AS delta, stddev_samp(d) / sqrt(count(*)) AS se FROM pr), t AS (SELECT *, (delta + {MARGIN}) / se AS t1, ({MARGIN} - delta) / se AS t2, exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) AS k FROM c),
up AS (SELECT *, 0.5 - k * t1 / 30000 * list_sum(list_transform(range(0, 10001), lambda i: CASE WHEN i IN (0, 10000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t1 * i / 10000, 2) / (n - 1), -n / 2))) AS p_low,
  0.5 - k * t2 / 30000 * list_sum(list_transform(range(0, 10001), lambda i: CASE WHEN i IN (0, 10000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t2 * i / 10000, 2) / (n - 1), -n / 2))) AS p_high FROM t)
SELECT n, round(delta, 6) AS delta, round(se, 6) AS se, round(p_low, 6) AS p_low, round(p_high, 6) AS p_high, round(2.8 * se, 6) AS m80,
  CASE WHEN greatest(p_low, p_high) < 0.05 THEN 'equivalent' ELSE 'not equivalent' END || CASE WHEN {MARGIN} < 2.8 * se THEN ', underpowered' ELSE '' END AS verdict FROM up""")
def r13(spark, d):
    return rounded(reports.equivalence(paired(spark, d), MARGIN).select("n", "delta", "se", "p_low", "p_high", "m80", "verdict"), "delta", "se", "p_low", "p_high", "m80")


@query("r15_flat_entities", RECORD_SQL + ", x AS (SELECT 1) SELECT entity, round(max(value) - min(value), 6) AS spread, CASE WHEN max(value) - min(value) < 1e-9 THEN 1 ELSE 0 END AS flat FROM rec GROUP BY entity")
def r15(spark, d):
    return rounded(reports.flat_entities(records(spark, d)), "spread")


@query("h15_best_head", RECORD_SQL + ", e AS (SELECT entity, arm, avg(value) AS v FROM rec GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v DESC, arm) AS k, count(*) OVER (PARTITION BY entity) AS c FROM e) SELECT entity, arm, round(v, 6) AS best FROM b WHERE k = 1 AND c = 2")
def h15(spark, d):
    return rounded(reports.best_arm(records(spark, d)), "best")


@query("r26_spread", RECORD_SQL + ", m AS (SELECT arm, quantile_cont(value, 0.5) AS median FROM rec GROUP BY arm) SELECT arm, round(any_value(median), 6) AS median, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS n, round(quantile_cont(abs(value - median), 0.5), 6) AS mad FROM rec JOIN m USING (arm) GROUP BY arm")
def r26(spark, d):
    return rounded(reports.spread(records(spark, d)), "median", "mean", "sd", "low", "high", "mad")


@query("q1_approximation", """p AS (SELECT entity, split, value AS x, avg(value) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS y FROM series)
SELECT entity, split, round(avg(abs(x - y)), 6) AS mae, round(avg((x - y) * (x - y)), 4) AS mse, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine,
 round(corr(x, y), 6) AS pearson, round(avg((x - y) * (x - y)) / var_pop(x), 6) AS nmse, round(var_pop(y) / var_pop(x), 6) AS variance_ratio FROM p GROUP BY ALL""")
def q1(spark, d):
    p = prep.centred_average(series(spark, d), 10, "y").withColumnRenamed("value", "x")
    return rounded(models.approximation(p, ["entity", "split"]).withColumn("mse", F.round("mse", 4)), "mae", "rmse", "cosine", "pearson", "nmse", "variance_ratio")


@query("d2_running_total", "SELECT entity, split, t, sum(label) OVER (PARTITION BY entity, split ORDER BY t)::BIGINT AS seen FROM series")
def running(spark, d):
    return running_sum(series(spark, d), F.col("label"), "seen").select("entity", "split", "t", "seen")


@query("g1_invariants", "SELECT entity, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null, sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END)::BIGINT AS n_val, sum(CASE WHEN label NOT IN (0, 1) THEN 1 ELSE 0 END)::BIGINT AS n_bad, round(avg(CASE WHEN split = 'test' THEN label END), 6) AS test_rate FROM series GROUP BY entity")
def g1(spark, d):
    s = series(spark, d)
    return rounded(s.groupBy("entity").agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(~F.col("label").isin(0, 1)).alias("n_bad"), F.avg(F.when(F.col("split") == "test", F.col("label"))).alias("test_rate")), "test_rate")
