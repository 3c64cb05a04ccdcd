"""Registered queries of channels, thresholds, token priors, fusion and transfer. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseries.functions.frames import r6
from fleetseries.operators import attribution, detect, fusion, models, prep, priors
from fleetseries.plans.queries import (
    MULTI_SQL, PRED_SQL, RECORD_SQL, SCALED_SQL, SCORED_SQL, SERIES_SQL, TOKEN_SQL, TOKENS, WIDTH, WINDOW_SQL,
    multi, predicted, query, read, records, rounded, scaled, scored, series, tokens, train_counts,
)
from fleetseries.sources import tables

# -- selection, windows, scaling -----------------------------------------------------------------------


@query("b2_cluster_entities", "SELECT DISTINCT cluster, entity FROM series WHERE cluster IN ('c1', 'c3') AND entity <> 'u03'")
def b2(spark, d):
    return series(spark, d).where(F.col("cluster").isin("c1", "c3") & (F.col("entity") != "u03")).select("cluster", "entity").distinct()


@query("c9_eligibility", """n AS (SELECT entity, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS tr, sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS va, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS te FROM series GROUP BY entity)
SELECT entity, CASE WHEN tr < 240 THEN 'short_train' WHEN va < 57 THEN 'short_val' WHEN te < 320 THEN 'short_test' ELSE 'eligible' END AS reason FROM n""")
def c9(spark, d):
    return prep.eligibility(series(spark, d), {"train": 240, "val": 57, "test": 320})


@query("c10_caps", "h AS (SELECT *, dense_rank() OVER (ORDER BY entity) AS k FROM series) SELECT entity, split, t FROM h WHERE k <= 5 AND t < 300")
def c10(spark, d):
    return prep.capped(series(spark, d), 5, 300).select("entity", "split", "t")


@query("n7_token_shift", """cs AS (SELECT cluster, avg(value) AS cm, greatest(stddev_pop(value), 1e-4) AS cd FROM series WHERE split = 'train' GROUP BY cluster),
q AS (SELECT entity, least(greatest(floor((x + 3) / 0.375), 0), 15) AS a, least(greatest(floor(((value - cm) / cd + 3) / 0.375), 0), 15) AS b FROM scaled JOIN cs USING (cluster) WHERE split = 'test')
SELECT entity, round(avg(CASE WHEN a <> b THEN 1 ELSE 0 END), 6) AS shift, count(*) AS n FROM q GROUP BY entity""", SCALED_SQL)
def n7(spark, d):
    s = scaled(spark, d).withColumn("a", tables.quantise(F.col("x"), TOKENS)).drop("x")
    both = prep.scale(s, prep.scale_stats(series(spark, d), ["cluster"]), ["cluster"]).withColumn("b", tables.quantise(F.col("x"), TOKENS))
    return rounded(both.where("split = 'test'").groupBy("entity").agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("shift"), F.count("*").alias("n")), "shift")


@query("w12_richness", WINDOW_SQL + f""", e AS (SELECT entity, split, w_start, list_stddev_samp(w) AS sd, list_transform(range(2, {WIDTH}), lambda i: CASE WHEN sign(w[i] - w[i - 1]) <> sign(w[i + 1] - w[i]) THEN 1 ELSE 0 END) AS f FROM win)
SELECT entity, split, w_start, round(sd + 3 * list_sum(f) / {WIDTH - 2}.0, 6) AS richness FROM e""")
def w12(spark, d):
    return rounded(prep.richness(prep.sliding_windows(series(spark, d), WIDTH, 2)).select("entity", "split", "w_start", "richness"), "richness")


@query("w14_label_density", f"""w AS (SELECT entity, split, t - t % {WIDTH} AS w_start, count(*) AS n, sum(label)::BIGINT AS n_pos FROM series GROUP BY ALL)
SELECT entity, split, w_start, n_pos, round(n_pos / n, 6) AS density, CASE WHEN n_pos / n <= 0.9 THEN 1 ELSE 0 END AS has_context FROM w WHERE n = {WIDTH}""")
def w14(spark, d):
    return rounded(prep.label_density(series(spark, d), WIDTH).select("entity", "split", "w_start", "n_pos", "density", "has_context"), "density")


# -- thresholds ----------------------------------------------------------------------------------------


def channel_scores(spark, d):
    return multi(spark, d).withColumn("score", F.col("value"))


@query("t3_channel_threshold", "SELECT channel, round(quantile_cont(value, 0.9), 6) AS thr FROM multi GROUP BY channel", MULTI_SQL)
def t3(spark, d):
    return rounded(detect.quantile_threshold(channel_scores(spark, d), ["channel"], 0.9), "thr")


RATIO_SQL = " UNION ALL ".join(f"SELECT entity, CAST({r} AS DOUBLE) AS ratio, quantile_cont(score, {1 - r / 100}) AS thr, sum(label) AS pos FROM pred GROUP BY entity" for r in detect.RATIOS)


@query("t5_ratio_threshold", f"""g AS ({RATIO_SQL}),
f AS (SELECT g.entity, g.ratio, g.thr, coalesce(2 * sum(CASE WHEN p.score > g.thr THEN p.label ELSE 0 END) / nullif(sum(CASE WHEN p.score > g.thr THEN 1 ELSE 0 END) + any_value(g.pos), 0), 0) AS f1
      FROM g JOIN pred AS p ON p.entity = g.entity GROUP BY g.entity, g.ratio, g.thr)
SELECT entity, round(thr, 6) AS thr, ratio, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY f1 DESC, ratio) AS r FROM f) WHERE r = 1""", PRED_SQL)
def t5(spark, d):
    return rounded(detect.ratio_threshold(scored(spark, d).where("split = 'test'"), ["entity"]), "thr", "f1")


@query("t9_base_rate_threshold", """b AS (SELECT entity, avg(label) AS rate, count(*) AS n, list_sort(list(score)) AS s FROM pred GROUP BY entity), p AS (SELECT *, (1 - rate) * (n - 1) AS k FROM b)
SELECT entity, round(rate, 6) AS rate, round(s[CAST(floor(k) AS BIGINT) + 1] + (s[CAST(ceil(k) AS BIGINT) + 1] - s[CAST(floor(k) AS BIGINT) + 1]) * (k - floor(k)), 6) AS thr FROM p""", PRED_SQL)
def t9(spark, d):
    return rounded(detect.base_rate_threshold(scored(spark, d).where("split = 'test'"), ["entity"]), "rate", "thr")


@query("t10_source_threshold", """m AS (SELECT p.entity, s.entity AS source, p.label, CASE WHEN p.score > s.thr THEN 1 ELSE 0 END AS pred FROM pred AS p JOIN (SELECT DISTINCT entity, cluster FROM series) AS c ON c.entity = p.entity
 JOIN (SELECT thr.entity, thr, cluster FROM thr JOIN (SELECT DISTINCT entity, cluster FROM series) USING (entity)) AS s ON s.cluster = c.cluster)
SELECT source, entity AS target, round(coalesce(2 * sum(pred * label) / nullif(sum(pred) + sum(label), 0), 0), 6) AS f1 FROM m GROUP BY ALL""", PRED_SQL)
def t10(spark, d):
    s = scored(spark, d)
    made = detect.quantile_threshold(s.where("split = 'train'"), ["cluster", "entity"], 0.95).withColumnRenamed("entity", "source")
    return rounded(detect.frozen_thresholds(s.where("split = 'test'"), made), "f1")


# -- metrics by channel and over the fleet -------------------------------------------------------------


@query("k1_channel_localisation", """rk AS (SELECT *, row_number() OVER (PARTITION BY entity, t ORDER BY value DESC, channel) AS r, sum(channel_label) OVER (PARTITION BY entity, t) AS g, count(*) OVER (PARTITION BY entity, t) AS c FROM multi),
st AS (SELECT entity, t, any_value(g) AS g, sum(CASE WHEN r <= 1 THEN channel_label ELSE 0 END) AS h1, sum(CASE WHEN r <= 3 THEN channel_label ELSE 0 END) AS h3, sum(CASE WHEN r <= g THEN channel_label ELSE 0 END) AS hg FROM rk WHERE g > 0 AND c > 1 GROUP BY entity, t)
SELECT entity, count(*) AS n_steps, round(avg(h1), 6) AS precision_at_1, round(avg(h3 / 3), 6) AS precision_at_3, round(avg(h1 / g), 6) AS recall_at_1, round(avg(h3 / g), 6) AS recall_at_3, round(avg(hg / g), 6) AS at_oracle FROM st GROUP BY entity""", MULTI_SQL)
def k1(spark, d):
    return rounded(attribution.localisation(channel_scores(spark, d), ["entity"]), "precision_at_1", "precision_at_3", "recall_at_1", "recall_at_3", "at_oracle")


@query("k6_pooled_localisation", """rk AS (SELECT *, row_number() OVER (PARTITION BY entity, t ORDER BY value DESC, channel) AS r, sum(channel_label) OVER (PARTITION BY entity, t) AS g, count(*) OVER (PARTITION BY entity, t) AS c FROM multi),
st AS (SELECT entity, t, any_value(g) AS g, sum(CASE WHEN r <= 1 THEN channel_label ELSE 0 END) AS h1, sum(CASE WHEN r <= 3 THEN channel_label ELSE 0 END) AS h3, sum(CASE WHEN r <= g THEN channel_label ELSE 0 END) AS hg FROM rk WHERE g > 0 AND c > 1 GROUP BY entity, t)
SELECT count(*) AS n_steps, round(avg(h1), 6) AS precision_at_1, round(avg(h3 / 3), 6) AS precision_at_3, round(avg(h1 / g), 6) AS recall_at_1, round(avg(h3 / g), 6) AS recall_at_3, round(avg(hg / g), 6) AS at_oracle FROM st""", MULTI_SQL)
def k6(spark, d):
    return rounded(attribution.localisation(channel_scores(spark, d), []), "precision_at_1", "precision_at_3", "recall_at_1", "recall_at_3", "at_oracle")


@query("k2_segment_hits", """y AS (SELECT entity, t, max(channel_label) AS y FROM multi GROUP BY ALL),
i AS (SELECT entity, t, y, row_number() OVER (PARTITION BY entity ORDER BY t) - row_number() OVER (PARTITION BY entity, y ORDER BY t) AS g FROM y),
pk AS (SELECT m.entity, g, channel, max(value) AS peak, max(channel_label) AS y, count(*) AS steps FROM multi AS m JOIN i ON i.entity = m.entity AND i.t = m.t AND i.y = 1 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY entity, g ORDER BY peak DESC, channel) AS r, sum(y) OVER (PARTITION BY entity, g) AS n, max(steps) OVER (PARTITION BY entity, g) AS len FROM pk),
s AS (SELECT entity, g, any_value(len) AS len, sum(CASE WHEN r <= n THEN y ELSE 0 END) / any_value(n) AS hit FROM rk GROUP BY entity, g)
SELECT entity, round(sum(len * hit) / sum(len), 6) AS ips, count(*) AS n_segments FROM s GROUP BY entity""", MULTI_SQL)
def k2(spark, d):
    return rounded(attribution.segment_hits(channel_scores(spark, d)), "ips")


CHANNEL_SQL = MULTI_SQL + """,
ct AS (SELECT channel, quantile_cont(value, 0.9) AS thr FROM multi GROUP BY channel),
cp AS (SELECT {0}, value AS score, channel_label AS label, CASE WHEN value > thr THEN 1 ELSE 0 END AS pred FROM multi JOIN ct USING (channel)),
c1 AS (SELECT g, sum(label)::BIGINT AS n_pos, coalesce(sum(pred * label) / nullif(sum(pred), 0), 0) AS precision, coalesce(sum(pred * label) / nullif(sum(label), 0), 0) AS recall, coalesce(2 * sum(pred * label) / nullif(sum(pred) + sum(label), 0), 0) AS f1 FROM cp GROUP BY g),
c2 AS (SELECT g, (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) AS auroc
       FROM (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0 AS r FROM cp) GROUP BY g),
c3 AS (SELECT g, sum(pos / nullif(al, 0) * tp / seen) AS auprc FROM (SELECT g, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY g) AS al
       FROM (SELECT g, score, sum(label) AS pos, count(*) AS n FROM cp GROUP BY ALL) WINDOW w AS (PARTITION BY g ORDER BY score DESC)) GROUP BY g),
cm AS (SELECT c1.*, auroc, auprc FROM c1 JOIN c2 USING (g) JOIN c3 USING (g))"""
CHANNEL_METRICS = ["precision", "recall", "f1", "auroc", "auprc"]
CHANNEL_COLUMNS = ", ".join(f"round({m}, 6) AS {m}" for m in CHANNEL_METRICS)


def channel_points(spark, d):
    s = channel_scores(spark, d)
    made = detect.predict(s, detect.quantile_threshold(s, ["channel"], 0.9), ["channel"])
    return made.select("channel", F.lit(0).alias("joint"), "score", F.col("channel_label").alias("label"), "pred")


def channel_metrics(points, key):
    counts = detect.confusion(points, [key]).select(key, (F.col("tp") + F.col("fn")).alias("n_pos"), "precision", "recall", "f1")
    return counts.join(detect.auroc(points, [key]), key).join(detect.auprc(points, [key]).select(key, "auprc"), key)


@query("k3_channel_metrics", f"SELECT g AS channel, n_pos, {CHANNEL_COLUMNS} FROM cm", CHANNEL_SQL.format("channel AS g"))
def k3(spark, d):
    return rounded(channel_metrics(channel_points(spark, d), "channel"), *CHANNEL_METRICS)


@query("k4_macro_weighted", "l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, n_pos, {m} AS value FROM cm" for m in CHANNEL_METRICS) + ") SELECT metric, round(avg(value), 6) AS macro, round(sum(value * n_pos) / nullif(sum(n_pos), 0), 6) AS weighted, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY metric", CHANNEL_SQL.format("channel AS g"))
def k4(spark, d):
    return rounded(attribution.macro_weighted(channel_metrics(channel_points(spark, d), "channel"), CHANNEL_METRICS, "n_pos"), "macro", "weighted")


@query("k5_joint_micro", f"SELECT n_pos, {CHANNEL_COLUMNS} FROM cm", CHANNEL_SQL.format("0 AS g"))
def k5(spark, d):
    return rounded(channel_metrics(channel_points(spark, d), "joint").drop("joint"), *CHANNEL_METRICS)


ENTITY_METRICS = ["precision", "recall", "f1", "accuracy", "fpr"]
ENTITY_SQL = PRED_SQL + """, em AS (SELECT entity, coalesce(sum(pred * label) / nullif(sum(pred), 0), 0) AS precision, coalesce(sum(pred * label) / nullif(sum(label), 0), 0) AS recall, coalesce(2 * sum(pred * label) / nullif(sum(pred) + sum(label), 0), 0) AS f1,
 avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy, coalesce(sum(pred * (1 - label)) / nullif(sum(1 - label), 0), 0) AS fpr FROM pred GROUP BY entity),
lm AS (""" + " UNION ALL ".join(f"SELECT entity, '{m}' AS metric, {m} AS value FROM em" for m in ENTITY_METRICS) + ")"


def entity_metrics(spark, d):
    return detect.confusion(predicted(spark, d), ["entity"]).unpivot(["entity"], ENTITY_METRICS, "metric", "value")


@query("j15_metric_summary", "SELECT metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high, count(value) AS n FROM lm GROUP BY metric", ENTITY_SQL)
def j15(spark, d):
    v = entity_metrics(spark, d).groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))
    return rounded(v, "mean", "median", "sd", "low", "high")


@query("j16_pooled_and_macro", """p AS (SELECT round(coalesce(2 * sum(pred * label) / nullif(sum(pred) + sum(label), 0), 0), 6) AS pooled_f1, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS pooled_accuracy FROM pred)
SELECT pooled_f1, pooled_accuracy, round((SELECT avg(f1) FROM em), 6) AS macro_f1, round((SELECT avg(accuracy) FROM em), 6) AS macro_accuracy FROM p""", ENTITY_SQL)
def j16(spark, d):
    each = detect.confusion(predicted(spark, d), ["entity"])
    tp, fp, fn, tn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))
    pooled = [F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("pooled_f1"), F.try_divide(tp + tn, tp + fp + fn + tn).alias("pooled_accuracy")]
    return rounded(each.agg(*pooled, F.avg("f1").alias("macro_f1"), F.avg("accuracy").alias("macro_accuracy")), "pooled_f1", "pooled_accuracy", "macro_f1", "macro_accuracy")


# -- token priors --------------------------------------------------------------------------------------

CONTEXT_SQL = TOKEN_SQL + """,
h AS (SELECT *, lag(token, 2) OVER w AS a, lag(token, 1) OVER w AS b FROM tok WINDOW w AS (PARTITION BY entity, split, win ORDER BY pos)),
tr AS (SELECT * FROM h WHERE split = 'train')"""
BACKOFF_SQL = CONTEXT_SQL + """,
n1 AS (SELECT token, count(*) AS n1 FROM tr GROUP BY token), n2 AS (SELECT b, token, count(*) AS n2 FROM tr WHERE b IS NOT NULL GROUP BY ALL), n3 AS (SELECT a, b, token, count(*) AS n3 FROM tr WHERE a IS NOT NULL GROUP BY ALL),
c2 AS (SELECT b, sum(n2) AS c2 FROM n2 GROUP BY b), c3 AS (SELECT a, b, sum(n3) AS c3 FROM n3 GROUP BY ALL),
e AS (SELECT h.*, (coalesce(n1, 0) + 1) / ((SELECT sum(n1) FROM n1) + 16.0) AS p1, (coalesce(n2, 0) + 1) / (coalesce(c2, 0) + 16.0) AS p2, (coalesce(n3, 0) + 1) / (coalesce(c3, 0) + 16.0) AS p3
      FROM h LEFT JOIN n1 USING (token) LEFT JOIN n2 USING (b, token) LEFT JOIN c2 USING (b) LEFT JOIN n3 USING (a, b, token) LEFT JOIN c3 USING (a, b)),
i AS (SELECT *, CASE WHEN b IS NULL THEN p1 ELSE 0.7 * p2 + 0.3 * p1 END AS p2i FROM e),
bo AS (SELECT *, CASE WHEN a IS NULL THEN p2i ELSE 0.6 * p3 + 0.4 * p2i END AS p FROM i)"""


def with_prior(spark, d, part):
    t = priors.in_context(tokens(spark, d))
    return priors.backoff(t.where("split = 'train'"), t.where(F.col("split") == part), TOKENS)


@query("p4_backoff_tables", "SELECT DISTINCT a, b, token, round(p, 6) AS p FROM bo WHERE split = 'train'", BACKOFF_SQL)
def p4(spark, d):
    return rounded(with_prior(spark, d, "train").select("a", "b", "token", "p"), "p").distinct()


@query("p6_token_nll", "SELECT entity, win, pos, token, round(-ln(p), 6) AS nll FROM bo WHERE split = 'test'", BACKOFF_SQL)
def p6(spark, d):
    return with_prior(spark, d, "test").select("entity", "win", "pos", "token", r6(-F.log("p")).alias("nll"))


@query("p5_position_prior", "n AS (SELECT pos, token, count(*) AS n FROM tr GROUP BY ALL) SELECT pos, token, n, round(ln((n + 1) / (sum(n) OVER (PARTITION BY pos) + 16.0)), 6) AS logp FROM n", CONTEXT_SQL)
def p5(spark, d):
    return rounded(priors.position_log_prob(tokens(spark, d).where("split = 'train'"), TOKENS), "logp")


PRIOR_SQL = CONTEXT_SQL + """,
grid0 AS (SELECT e.entity, v.token, coalesce(u.n, 0) AS n FROM (SELECT DISTINCT entity FROM uni) AS e CROSS JOIN (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS token) AS v LEFT JOIN uni AS u ON u.entity = e.entity AND u.token = v.token),
lp AS (SELECT *, ln((n + 1) / (sum(n) OVER (PARTITION BY entity) + 16.0)) AS logp FROM grid0),
po AS (SELECT token, sum(n) AS n, ln((sum(n) + 1) / ((SELECT sum(n) FROM uni) + 16.0)) AS logp FROM grid0 GROUP BY token),
te AS (SELECT entity, token, count(*) AS n FROM tok WHERE split = 'test' GROUP BY ALL),
tg AS (SELECT lp.entity AS source, te.entity AS target, sum(te.n * logp) / sum(te.n) AS value FROM te JOIN lp USING (token) GROUP BY ALL),
cl AS (SELECT DISTINCT entity, cluster FROM series)"""


def test_counts(spark, d):
    return models.unigrams(tokens(spark, d).where("split = 'test'"))


@query("p7_mixed_priors", """j AS (SELECT te.entity, te.n, -lp.logp AS own, -po.logp AS pooled FROM te JOIN lp USING (entity, token) JOIN po USING (token))
SELECT entity, round(sum(n * own) / sum(n), 6) AS own, round(sum(n * pooled) / sum(n), 6) AS pooled, round(sum(n * -ln(0.7 * exp(-own) + 0.3 * exp(-pooled))) / sum(n), 6) AS mixed FROM j GROUP BY entity""", PRIOR_SQL)
def p7(spark, d):
    own = train_counts(spark, d)
    local = priors.full_table(own, TOKENS).select("entity", "token", (-F.col("logp")).alias("own"))
    pooled = priors.full_table(own.groupBy(F.lit("all").alias("entity"), "token").agg(F.sum("n").alias("n")), TOKENS).select("token", (-F.col("logp")).alias("pooled"))
    met = test_counts(spark, d).join(local, ["entity", "token"]).join(pooled, "token").withColumn("mixed", priors.mixed_nll(F.col("own"), F.col("pooled"), 0.7))
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
    return rounded(met.groupBy("entity").agg(mean("own"), mean("pooled"), mean("mixed")), "own", "pooled", "mixed")


@query("p8_usage_aware", "w AS (SELECT token, n, CASE WHEN n = 0 THEN 0.01 ELSE n + 1 END AS w FROM po) SELECT token, n::BIGINT AS n, round(-ln(w / sum(w) OVER ()), 6) AS nll FROM w", PRIOR_SQL)
def p8(spark, d):
    return rounded(priors.usage_aware(train_counts(spark, d), TOKENS), "nll")


PAIR_SQL = PRIOR_SQL + """,
alive AS (SELECT DISTINCT token FROM uni), ag AS (SELECT g.*, (g.n + 1) / (sum(g.n) OVER (PARTITION BY g.entity) + 16.0) AS p FROM grid0 AS g JOIN alive USING (token)),
pw AS (SELECT a.entity, b.entity AS other, sum(0.5 * (a.p * ln(a.p / ((a.p + b.p) / 2)) + b.p * ln(b.p / ((a.p + b.p) / 2)))) AS js,
  sum(CASE WHEN a.n > 0 AND b.n > 0 THEN 1 ELSE 0 END) / sum(CASE WHEN a.n > 0 OR b.n > 0 THEN 1 ELSE 0 END) AS jaccard FROM ag AS a JOIN ag AS b USING (token) WHERE a.entity <> b.entity GROUP BY ALL)"""


@query("p9_usage_report", """ac AS (SELECT entity, count(*) AS active FROM uni GROUP BY entity), nr AS (SELECT entity, avg(jaccard) AS mean_jaccard, arg_min(other, js) AS nearest FROM pw GROUP BY entity)
SELECT entity, active, 16 - active AS dead, (SELECT count(*) FROM alive) - active AS dead_here_only, round(mean_jaccard, 6) AS mean_jaccard, nearest FROM ac JOIN nr USING (entity)""", PAIR_SQL)
def p9(spark, d):
    n = train_counts(spark, d)
    return rounded(priors.usage_report(n, models.js_divergence(n, TOKENS), TOKENS), "mean_jaccard")


@query("p12_rarity_weights", "w AS (SELECT entity, token, sqrt(sum(n) OVER (PARTITION BY entity) / n) AS w FROM uni) SELECT entity, token, round(w / avg(w) OVER (PARTITION BY entity), 6) AS weight FROM w", TOKEN_SQL)
def p12(spark, d):
    return rounded(priors.rarity_weights(train_counts(spark, d)), "weight")


@query("p13_starvation", """u AS (SELECT entity, count(*) AS active, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median, CAST(floor(quantile_cont(n, 0.1)) AS BIGINT) AS p10, sum(CASE WHEN n < 10 THEN 1 ELSE 0 END)::BIGINT AS starved FROM uni GROUP BY entity),
b AS (SELECT entity, count(*) AS pairs, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS singleton, avg(CASE WHEN n < 10 THEN 1.0 ELSE 0.0 END) AS sp FROM (SELECT entity, b, token, count(*) AS n FROM tr WHERE b IS NOT NULL GROUP BY ALL) GROUP BY entity)
SELECT entity, active, median, p10, starved, pairs, round(singleton, 6) AS singleton, round(sp, 6) AS starved_pairs FROM u JOIN b USING (entity)""", CONTEXT_SQL)
def p13(spark, d):
    return rounded(priors.starvation(priors.in_context(tokens(spark, d)).where("split = 'train'"), 10), "singleton", "starved_pairs")


@query("p14_mergeability", """nk AS (SELECT entity, b, token, count(*) AS n FROM tr WHERE b IS NOT NULL GROUP BY ALL), ck AS (SELECT entity, b, sum(n) AS c FROM nk GROUP BY ALL),
g AS (SELECT e.entity, x.b, v.token, coalesce(nk.n, 0) AS n, coalesce(ck.c, 0) AS c FROM (SELECT DISTINCT entity FROM tr) AS e CROSS JOIN (SELECT DISTINCT b FROM nk) AS x CROSS JOIN (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS token) AS v
      LEFT JOIN nk ON nk.entity = e.entity AND nk.b = x.b AND nk.token = v.token LEFT JOIN ck ON ck.entity = e.entity AND ck.b = x.b),
pa AS (SELECT b, token, avg((n + 1) / (c + 16.0)) AS p, (sum(n) + 1) / (sum(c) + 16.0) AS o, sum(c) AS c FROM g GROUP BY b, token),
kl AS (SELECT b, any_value(c) AS c, sum(p * ln(p / o)) AS kl FROM pa GROUP BY b)
SELECT round(sum(kl * c) / sum(c), 6) AS kl, count(*) AS contexts FROM kl""", CONTEXT_SQL)
def p14(spark, d):
    return rounded(priors.mergeability(priors.in_context(tokens(spark, d)).where("split = 'train'"), TOKENS), "kl")


def grid(spark, d):
    return priors.transfer_grid(priors.full_table(train_counts(spark, d), TOKENS), test_counts(spark, d))


def clusters(spark, d):
    return series(spark, d).select("entity", "cluster").distinct()


@query("r19_transfer_reduction", """v AS (SELECT tg.*, s.cluster AS cs, t.cluster AS ct FROM tg JOIN cl AS s ON s.entity = source JOIN cl AS t ON t.entity = target),
m AS (SELECT target, ct AS cluster, max(CASE WHEN source = target THEN value END) AS se, avg(CASE WHEN source <> target THEN value END) AS ma, max(CASE WHEN source <> target THEN value END) AS ba, min(CASE WHEN source <> target THEN value END) AS wa,
 avg(CASE WHEN source <> target AND cs = ct THEN value END) AS mw, max(CASE WHEN source <> target AND cs = ct THEN value END) AS bw FROM v GROUP BY ALL)
SELECT target, cluster, round(se, 6) AS self_value, round(ma, 6) AS mean_all, round(ba, 6) AS best_all, round(wa, 6) AS worst_all, round(mw, 6) AS mean_within, round(bw, 6) AS best_within,
 round(se - ma, 6) AS tau_all, round(se - mw, 6) AS tau_within, round(ba - se, 6) AS kappa_all, round(bw - se, 6) AS kappa_within FROM m""", PRIOR_SQL)
def r19(spark, d):
    out = priors.reduce_grid(grid(spark, d), clusters(spark, d))
    return rounded(out, *out.columns[2:])


@query("p17_routed_source", """nr AS (SELECT entity, arg_min(other, js) AS nearest FROM pw GROUP BY entity), f AS (SELECT target, max(value) AS best, avg(value) AS mean FROM tg WHERE source <> target GROUP BY target)
SELECT f.target, nearest, round(tg.value, 6) AS routed, round(best, 6) AS best, round(mean, 6) AS mean FROM f JOIN nr ON nr.entity = f.target JOIN tg ON tg.target = f.target AND tg.source = nearest""", PAIR_SQL)
def p17(spark, d):
    n = train_counts(spark, d)
    near = priors.usage_report(n, models.js_divergence(n, TOKENS), TOKENS).select(F.col("entity").alias("target"), "nearest")
    foreign = grid(spark, d).where("source <> target").join(near, "target")
    routed = F.max(F.when(F.col("source") == F.col("nearest"), F.col("value"))).alias("routed")
    return rounded(foreign.groupBy("target", "nearest").agg(routed, F.max("value").alias("best"), F.avg("value").alias("mean")), "routed", "best", "mean")


@query("l18_codes_per_window", "c AS (SELECT entity, split, win, count(DISTINCT token) AS k FROM tok GROUP BY ALL) SELECT entity, split, round(avg(k), 6) AS mean, round(quantile_cont(k, 0.5), 6) AS median, round(quantile_cont(k, 0.1), 6) AS p10, round(quantile_cont(k, 0.9), 6) AS p90 FROM c GROUP BY ALL", TOKEN_SQL)
def l18(spark, d):
    k = tokens(spark, d).groupBy("entity", "split", "win").agg(F.count_distinct("token").alias("k")).groupBy("entity", "split")
    return rounded(k.agg(F.avg("k").alias("mean"), *(F.percentile("k", F.lit(q)).alias(n) for n, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9)))), "mean", "median", "p10", "p90")


@query("f3_drift", """w AS (SELECT entity, sum(n) AS w FROM grid0 GROUP BY entity), c AS (SELECT token, sum(w * exp(logp)) / sum(w) AS m FROM lp JOIN w USING (entity) GROUP BY token)
SELECT entity, round(sqrt(sum(pow(exp(logp) - m, 2))), 6) AS drift, round(sqrt(sum(pow(exp(logp) - m, 2))) / sqrt(sum(m * m)), 6) AS relative FROM lp JOIN c USING (token) GROUP BY entity""", PRIOR_SQL)
def f3(spark, d):
    n = train_counts(spark, d)
    weights = n.groupBy("entity").agg(F.sum("n").alias("weight"))
    params = priors.full_table(n, TOKENS).join(weights, "entity").select("entity", "weight", F.col("token").alias("idx"), F.exp("logp").alias("value"))
    return rounded(priors.drift(params), "drift", "relative")


@query("f7_client_weights", f"n AS (SELECT entity, count(*) AS n FROM series WHERE split = 'train' GROUP BY entity), w AS (SELECT entity, CASE WHEN n < {WIDTH} THEN 0 ELSE (n - {WIDTH}) // 2 + 1 END AS n_windows FROM n) SELECT entity, n_windows, round(n_windows / sum(n_windows) OVER (), 6) AS weight FROM w")
def f7(spark, d):
    n = series(spark, d).where("split = 'train'").groupBy("entity").agg(prep.n_windows(F.count("*"), WIDTH, 2).alias("n_windows"))
    return rounded(n.join(F.broadcast(n.agg(F.sum("n_windows").alias("w")))).select("entity", "n_windows", (F.col("n_windows") / F.col("w")).alias("weight")), "weight")


# -- fusion --------------------------------------------------------------------------------------------

HEADS = ["centred", "causal", "step", "level"]
FUSION_SQL = SCALED_SQL + """,
wide AS (SELECT entity, t, label, split, round(pow(x - avg(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 2), 9) AS centred, round(pow(x - coalesce(avg(x) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), x), 2), 9) AS causal,
 round(pow(coalesce(x - lag(x) OVER w, lead(x) OVER w - x, 0), 2), 9) AS step, round(x * x, 9) AS level FROM scaled WINDOW w AS (PARTITION BY entity, split ORDER BY t)),
lng AS (""" + " UNION ALL ".join(f"SELECT entity, t, label, '{h}' AS head, {h} AS score FROM wide WHERE split = 'test'" for h in HEADS) + """),
z AS (SELECT *, (score - avg(score) OVER e) / CASE WHEN stddev_pop(score) OVER e > 0 THEN stddev_pop(score) OVER e ELSE 1 END AS z,
  (rank() OVER (PARTITION BY entity, head ORDER BY score) + (count(*) OVER (PARTITION BY entity, head, score) - 1) / 2.0) / count(*) OVER e AS f FROM lng WINDOW e AS (PARTITION BY entity, head)),
fu AS (SELECT entity, t, label, avg(z) AS mean_z, quantile_cont(z, 0.5) AS median_z, (sum(z) - min(z) - max(z)) / (count(*) - 2) AS trimmed_z, avg(f) AS mean_rank FROM z GROUP BY ALL)"""


def head_scores(spark, d):
    s = scaled(spark, d).where("split = 'test'")
    for name, head in (("centred", detect.ma_centred), ("causal", lambda x: detect.ma_causal(x, 10)), ("step", detect.diff1)):
        s = head(s).withColumn(name, F.round("score", 9)).drop("score")
    return s.withColumn("level", F.round(F.col("x") * F.col("x"), 9)).select("entity", "t", "label", *HEADS)


@query("u2_fused_scores", "SELECT entity, t, label, round(mean_z, 5) AS mean_z, round(median_z, 5) AS median_z, round(trimmed_z, 5) AS trimmed_z, round(mean_rank, 5) AS mean_rank FROM fu", FUSION_SQL)
def u2(spark, d):
    fused = fusion.fuse(fusion.standardised(fusion.long_scores(head_scores(spark, d), HEADS)))
    return fused.select("entity", "t", "label", *((F.round(c, 5) + 0.0).alias(c) for c in ("mean_z", "median_z", "trimmed_z", "mean_rank")))


@query("u3_fusion_gain", """al AS (SELECT entity, head, z AS score, label FROM z UNION ALL SELECT entity, '', round(mean_z, 9), label FROM fu),
g AS (SELECT entity, head, score, sum(label) AS pos, count(*) AS n FROM al GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY entity, head) AS al FROM g WINDOW w AS (PARTITION BY entity, head ORDER BY score DESC)),
ap AS (SELECT entity, head, sum(pos / al * tp / seen) AS v FROM c GROUP BY ALL),
s AS (SELECT entity, avg(CASE WHEN head <> '' THEN v END) AS m, max(CASE WHEN head <> '' THEN v END) AS b, max(CASE WHEN head = '' THEN v END) AS f FROM ap GROUP BY entity)
SELECT entity, round(m, 6) AS mean_auprc, round(b, 6) AS best_auprc, round(f, 6) AS fused, round(f - m, 6) AS gain_vs_mean, round(f - b, 6) AS gain_vs_best FROM s""", FUSION_SQL)
def u3(spark, d):
    return rounded(fusion.gains(fusion.standardised(fusion.long_scores(head_scores(spark, d), HEADS))), "mean_auprc", "best_auprc", "fused", "gain_vs_mean", "gain_vs_best")


CORR_LIST = ", ".join(f"corr({a}, {b})" for k, a in enumerate(HEADS) for b in HEADS[k + 1 :])


@query("u3_score_correlation", f"k AS (SELECT entity, [{CORR_LIST}] AS c FROM wide WHERE split = 'test' GROUP BY entity) SELECT entity, round(list_avg(c), 6) AS corr_mean, round(list_min(c), 6) AS corr_min FROM k", FUSION_SQL)
def u3c(spark, d):
    return rounded(fusion.correlations(head_scores(spark, d), HEADS), "corr_mean", "corr_min")


# -- report reducers -----------------------------------------------------------------------------------


@query("r5_seed_collapse", RECORD_SQL + ", x AS (SELECT 1) SELECT arm, cluster, entity, round(avg(value), 6) AS value, count(*) AS n_seeds FROM rec GROUP BY ALL")
def r5(spark, d):
    return rounded(records(spark, d).groupBy("arm", "cluster", "entity").agg(F.avg("value").alias("value"), F.count("*").alias("n_seeds")), "value")


PAIR_RECORDS = RECORD_SQL + ", x AS (SELECT a.cluster, a.entity, a.seed, a.value - b.value AS d FROM rec AS a JOIN rec AS b ON a.arm = 'centred' AND b.arm = 'causal' AND a.seed = b.seed AND a.entity = b.entity)"


def differences(spark, d):
    side = lambda arm, name: records(spark, d).where(F.col("arm") == arm).select("cluster", "entity", "seed", F.col("value").alias(name))
    return side("centred", "a").join(side("causal", "b"), ["cluster", "entity", "seed"]).select("cluster", "entity", "seed", (F.col("a") - F.col("b")).alias("d"))


@query("r9_win_loss", PAIR_RECORDS + ", m AS (SELECT cluster, avg(d) AS m FROM x GROUP BY cluster) SELECT cluster, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::BIGINT AS wins, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)::BIGINT AS losses, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END)::BIGINT AS ties, round(sum(CASE WHEN sign(d) = sign(m) AND d <> 0 THEN 1 ELSE 0 END) / count(*), 6) AS agreement FROM x JOIN m USING (cluster) GROUP BY cluster")
def r9(spark, d):
    x = differences(spark, d)
    met = x.join(x.groupBy("cluster").agg(F.avg("d").alias("m")), "cluster")
    same = (F.signum("d") == F.signum("m")) & (F.col("d") != 0)
    return rounded(met.groupBy("cluster").agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"), (F.count_if(same) / F.count("*")).alias("agreement")), "agreement")


@query("r14_noise_gate", PAIR_RECORDS + """, e AS (SELECT cluster, entity, avg(d) AS d FROM x GROUP BY ALL), s AS (SELECT cluster, count(*) AS n, avg(d) AS delta, stddev_samp(d) AS sd FROM e GROUP BY cluster)
SELECT cluster, n, round(CASE WHEN n = 4 THEN delta END, 6) AS delta, round(CASE WHEN n = 4 THEN 2 * (sd / sqrt(5)) * sqrt(2) / sqrt(n) END, 6) AS gate, CASE WHEN n = 4 THEN CASE WHEN abs(delta) > 2 * (sd / sqrt(5)) * sqrt(2) / sqrt(n) THEN 1 ELSE 0 END END AS passes FROM s""")
def r14(spark, d):
    each = differences(spark, d).groupBy("cluster", "entity").agg(F.avg("d").alias("d")).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"))
    gate = 2 * (F.col("sd") / F.sqrt(F.lit(5.0))) * F.sqrt(F.lit(2.0)) / F.sqrt("n")
    whole = F.col("n") == 4  # a cell counts where every entity of the cluster is there
    return rounded(each.select("cluster", "n", F.when(whole, F.col("delta")).alias("delta"), F.when(whole, gate).alias("gate"), F.when(whole, (F.abs("delta") > gate).cast("int")).alias("passes")), "delta", "gate")


@query("r16_skyline", RECORD_SQL + ", k AS (SELECT cluster, avg(value) AS v, (SELECT avg(value) FROM rec WHERE arm = 'causal') AS lim FROM rec WHERE arm = 'causal' GROUP BY cluster) SELECT rec.arm, cluster, round(avg(value), 6) AS value, CASE WHEN any_value(v) <= any_value(lim) THEN 1 ELSE 0 END AS excluded FROM rec JOIN k USING (cluster) GROUP BY ALL")
def r16(spark, d):
    r = records(spark, d)
    ref = r.where("arm = 'causal'")
    limit = F.broadcast(ref.agg(F.avg("value").alias("lim")))  # one row
    flags = ref.groupBy("cluster").agg(F.avg("value").alias("v")).join(limit).select("cluster", (F.col("v") <= F.col("lim")).cast("int").alias("excluded"))
    return rounded(r.groupBy("arm", "cluster").agg(F.avg("value").alias("value")).join(flags, "cluster"), "value")
