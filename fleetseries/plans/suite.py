"""Registered queries of the evaluation suite. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseries.functions.frames import framed, r6, settled
from fleetseries.operators import detect, fusion, gallery, merging, models, prep, proximity, volume
from fleetseries.operators.prep import KEYS
from fleetseries.plans.fleet import FUSION_SQL, HEADS, RATIO_SQL, head_scores
from fleetseries.plans.queries import ASSIGN_SQL, HEAD_K, K, PRED_SQL, QUANTILE, RECORD_SQL, SCALED_SQL, STRIDE, WIDTH, assigned, predicted, query, read, records, rounded, scaled, scored
from fleetseries.sources import tables

BUFFER, CUTS = 8, 50

VUS_SQL = f"""y AS (SELECT entity, t, score, label, sum(label) OVER (PARTITION BY entity) AS pos, count(*) OVER (PARTITION BY entity) AS n FROM pred),
ok AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC) - 1 AS rank FROM y WHERE pos > 0 AND pos < n),
ks AS (SELECT unnest(range(0, {CUTS})) AS k), vs AS (SELECT unnest(range(0, {BUFFER + 1})) AS v),
cu AS (SELECT o.entity, k, o.score AS thr FROM ok AS o CROSS JOIN ks WHERE o.rank = CASE WHEN k = {CUTS - 1} THEN n - 1 ELSE floor(k * ((n - 1) / CAST({CUTS - 1} AS DOUBLE))) END),
sh AS (SELECT o.entity, v, o.t, any_value(o.score) AS score, least(1, sum(sqrt(1 - greatest(a - t, t - b) / CAST(v AS DOUBLE)))) AS w FROM ok AS o JOIN segs USING (entity) CROSS JOIN vs
  WHERE o.label = 0 AND v >= 2 AND greatest(a - t, t - b) BETWEEN 1 AND v // 2 GROUP BY o.entity, v, o.t),
hs AS (SELECT cu.entity, v, k, sum(w) AS h FROM sh JOIN cu ON cu.entity = sh.entity AND sh.score >= thr GROUP BY ALL),
br AS (SELECT entity, v, a, b, CASE WHEN a - lag(b) OVER w > 2 * (v // 2) OR lag(b) OVER w IS NULL THEN 1 ELSE 0 END AS head FROM segs CROSS JOIN vs WINDOW w AS (PARTITION BY entity, v ORDER BY a)),
gr AS (SELECT *, sum(head) OVER (PARTITION BY entity, v ORDER BY a) AS g FROM br), rg AS (SELECT entity, v, g, min(a) - v // 2 AS a, max(b) + v // 2 AS b FROM gr GROUP BY entity, v, g),
rt AS (SELECT r.entity, v, g, max(score) AS top FROM rg AS r JOIN ok AS o ON o.entity = r.entity AND o.t BETWEEN r.a AND r.b GROUP BY ALL),
ex AS (SELECT cu.entity, v, k, avg(CASE WHEN top >= thr THEN 1.0 ELSE 0.0 END) AS e FROM rt JOIN cu USING (entity) GROUP BY ALL),
pl AS (SELECT cu.entity, k, any_value(pos) AS pos, any_value(n) AS n, sum(label) AS seg, count(*) AS np FROM ok JOIN cu ON cu.entity = ok.entity AND score >= thr GROUP BY ALL),
al AS (SELECT entity, v, k, seg + coalesce(h, 0) AS tp, pos + coalesce(h, 0) / 2 AS p, np, n, e FROM pl CROSS JOIN vs JOIN ex USING (entity, v, k) LEFT JOIN hs USING (entity, v, k)),
cv AS (SELECT entity, v, k, least(tp / p, 1) * e AS tpr, CASE WHEN n > p THEN (np - tp) / (n - p) ELSE 0 END AS fpr, tp / np AS prec FROM al UNION ALL SELECT DISTINCT entity, v, {CUTS}, 1, 1, 0 FROM al),
ar AS (SELECT *, coalesce(lag(tpr) OVER w, 0) AS t0, coalesce(lag(fpr) OVER w, 0) AS f0 FROM cv WINDOW w AS (PARTITION BY entity, v ORDER BY k))
SELECT entity, round(sum((fpr - f0) * (tpr + t0) / 2) / {BUFFER + 1}, 6) AS vus_roc, round(sum(CASE WHEN k < {CUTS} THEN (tpr - t0) * prec END) / {BUFFER + 1}, 6) AS vus_pr FROM ar GROUP BY entity"""


@query("j10_volume", VUS_SQL, PRED_SQL)
def j10(spark, d):
    return rounded(volume.surface(predicted(spark, d), ["entity"], BUFFER, CUTS), "vus_roc", "vus_pr")


ZONES_SQL = PRED_SQL + f""", ends AS (SELECT entity, min(t) AS first, max(t) AS last FROM pred GROUP BY entity),
prs AS (SELECT unnest([0, 0, {BUFFER}, {BUFFER}]) AS e, unnest([0, {BUFFER}, 0, {BUFFER}]) AS d),
zo AS (SELECT entity, e, d, a, b, b - a + 1 AS len, first, least(b + d, coalesce(lead(a) OVER (PARTITION BY entity, e, d ORDER BY a) - 1, last)) AS stop FROM segs JOIN ends USING (entity) CROSS JOIN prs),
zs AS (SELECT *, lag(stop) OVER (PARTITION BY entity, e, d ORDER BY a) AS prior FROM zo),
zn AS (SELECT *, greatest(first, a - e, coalesce(prior + 1, first)) AS begin FROM zs),
wt AS (SELECT entity, e, d, t, a, 'in' AS zone, 1.0 AS w FROM zn JOIN pred USING (entity) WHERE t BETWEEN a AND b
 UNION ALL SELECT entity, e, d, t, a, 'pre', 1 - (len * (a - t) + len * (len - 1) / 2) / (len * (a - begin) + len * (len - 1) / 2) FROM zn JOIN pred USING (entity) WHERE t BETWEEN begin AND a - 1
 UNION ALL SELECT entity, e, d, t, a, 'post', 1 - (len * (t - b) + len * (len - 1) / 2) / (len * (stop - b) + len * (len - 1) / 2) FROM zn JOIN pred USING (entity) WHERE t BETWEEN b + 1 AND stop)"""
#: From pk (entity, k, t, p): whether a point is predicted at cut k.
PROXIMITY_SQL = """dt AS (SELECT pk.entity, k, a, b, min(CASE WHEN p THEN t END) AS head FROM pk JOIN segs ON segs.entity = pk.entity AND t BETWEEN a AND b GROUP BY ALL),
rn AS (SELECT dt.entity, dt.k, a, b, head, coalesce(min(CASE WHEN NOT p AND t > head THEN t END), any_value(b) + 1) - any_value(head) AS run FROM dt JOIN pk ON pk.entity = dt.entity AND pk.k = dt.k AND t BETWEEN a AND b GROUP BY ALL),
ms AS (SELECT rn.entity, rn.k, sum(CASE WHEN p THEN 0 WHEN head IS NULL OR t - a <= run THEN 1 ELSE 1 - ((run + 1) * (t - a) - run * (run + 1) / 2) / ((b - a + 1) * (b - a) / 2) END) AS missed
       FROM rn JOIN pk ON pk.entity = rn.entity AND pk.k = rn.k AND t BETWEEN a AND b GROUP BY ALL),
tp AS (SELECT pk.entity, e, d, pk.k, sum(CASE WHEN zone = 'pre' AND head IS NULL THEN 0 ELSE w END) AS tp FROM pk JOIN wt ON wt.entity = pk.entity AND wt.t = pk.t AND p JOIN dt ON dt.entity = pk.entity AND dt.k = pk.k AND dt.a = wt.a GROUP BY ALL),
np AS (SELECT entity, k, sum(CASE WHEN p THEN 1 ELSE 0 END) AS n FROM pk GROUP BY ALL),
pr AS (SELECT np.entity, prs.e, prs.d, np.k, coalesce(tp / nullif(n, 0), 0) AS prec, round(coalesce(tp / nullif(tp + coalesce(missed, 0), 0), 0), 12) AS rec
       FROM np CROSS JOIN prs LEFT JOIN ms ON ms.entity = np.entity AND ms.k = np.k LEFT JOIN tp ON tp.entity = np.entity AND tp.k = np.k AND tp.e = prs.e AND tp.d = prs.d)"""


@query("j11_pate", f"""pq AS (SELECT entity, t, label, round(score, 8) AS score FROM pred), ds AS (SELECT entity, score, max(label) AS hit FROM pq GROUP BY ALL),
kp AS (SELECT entity, score, row_number() OVER (PARTITION BY entity ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY entity) AS m
       FROM (SELECT *, lag(hit) OVER w AS lo, lead(hit) OVER w AS hi FROM ds WINDOW w AS (PARTITION BY entity ORDER BY score)) WHERE lo IS NULL OR hi IS NULL OR hit = 1 OR lo = 1),
pl AS (SELECT entity, k, CASE WHEN abs(x - round(x)) < 1e-9 THEN round(x) ELSE x END AS x FROM (SELECT entity, k, (any_value(m) - 1) * ((100 + k * (CAST(-100 AS DOUBLE) / 249)) / 100) AS x FROM kp CROSS JOIN (SELECT unnest(range(0, 250)) AS k) GROUP BY entity, k)),
th AS (SELECT pl.entity, k, CASE WHEN x = floor(x) THEN l.score ELSE l.score * (1 - (x - floor(x))) + h.score * (x - floor(x)) END AS thr FROM pl JOIN kp AS l ON l.entity = pl.entity AND l.r = floor(x) JOIN kp AS h ON h.entity = pl.entity AND h.r = ceil(x)),
pk AS (SELECT p.entity, k, t, score >= thr AS p FROM pq AS p JOIN th ON th.entity = p.entity), {PROXIMITY_SQL},
ri AS (SELECT * FROM (SELECT *, max(rec) OVER (PARTITION BY entity, e, d ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM pr) WHERE most IS NULL OR rec >= most),
ar AS (SELECT entity, (rec - coalesce(lag(rec) OVER w, 0)) * (prec + coalesce(lag(prec) OVER w, 1)) / 2 AS area FROM ri WINDOW w AS (PARTITION BY entity, e, d ORDER BY k))
SELECT entity, round(sum(area) / 4, 6) AS pate FROM ar GROUP BY entity""", ZONES_SQL)
def j11(spark, d):
    points = predicted(spark, d).withColumn("score", F.round("score", 8))  # which scores are one is not left to the last bit
    return rounded(proximity.pate(points, ["entity"], BUFFER, BUFFER), "pate")


@query("j11_pate_f1", f"pk AS (SELECT entity, 0 AS k, t, pred = 1 AS p FROM pred), {PROXIMITY_SQL} SELECT entity, round(sum(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0)) / 4, 6) AS pate_f1 FROM pr GROUP BY entity", ZONES_SQL)
def j11_f1(spark, d):
    return rounded(proximity.pate_f1(predicted(spark, d), ["entity"], BUFFER, BUFFER), "pate_f1")


STRATEGY_SQL = PRED_SQL + f""", adj AS (SELECT entity, t, label, CASE WHEN label = 1 THEN max(score) OVER (PARTITION BY entity, label, CASE WHEN label = 1 THEN seg ELSE -t END) ELSE score END AS score FROM marked),
two AS (SELECT entity, 'raw' AS variant, label, score FROM pred UNION ALL SELECT entity, 'adjusted', label, score FROM adj),
e4 AS (SELECT entity, variant, min(score) AS lo, max(score) AS hi, sum(label) AS pos FROM two GROUP BY ALL),
g4 AS (SELECT entity, variant, k, lo + k * ((hi - lo) / 399) AS thr, pos FROM e4 CROSS JOIN (SELECT unnest(generate_series(0, 399)) AS k)),
f4 AS (SELECT g.entity, g.variant, g.k, g.thr, 2 * sum(CASE WHEN p.score > g.thr THEN p.label ELSE 0 END) / (sum(CASE WHEN p.score > g.thr THEN 1 ELSE 0 END) + any_value(g.pos)) AS f1 FROM g4 AS g JOIN two AS p USING (entity, variant) GROUP BY ALL),
g5 AS ({RATIO_SQL.replace("SELECT entity,", "SELECT entity, variant,").replace("FROM pred GROUP BY entity", "FROM two GROUP BY entity, variant")}),
f5 AS (SELECT g.entity, g.variant, g.ratio, g.thr, coalesce(2 * sum(CASE WHEN p.score > g.thr THEN p.label ELSE 0 END) / nullif(sum(CASE WHEN p.score > g.thr THEN 1 ELSE 0 END) + any_value(g.pos), 0), 0) AS f1 FROM g5 AS g JOIN two AS p USING (entity, variant) GROUP BY ALL),
a6 AS (SELECT entity, score FROM scored WHERE split = 'train'), u6 AS (SELECT entity, quantile_cont(score, 0.9) AS u, count(*) AS n, quantile_cont(score, 0.95) AS q FROM a6 GROUP BY entity),
g6 AS (SELECT entity, u, n, count(*) AS c, avg(score - u) AS m, var_pop(score - u) AS v FROM a6 JOIN u6 USING (entity) WHERE score > u GROUP BY ALL),
x6 AS (SELECT *, 0.5 * (1 - m * m / v) AS xi, 0.5 * m * (m * m / v + 1) AS sg, 0.001 * n / c AS r FROM g6),
p6 AS (SELECT u6.entity, q, u6.u + coalesce(CASE WHEN v <= 1e-12 OR abs(xi) < 1e-9 THEN -m * ln(r) ELSE sg / xi * (pow(r, -xi) - 1) END, 0) AS thr FROM u6 LEFT JOIN x6 USING (entity)),
st AS (SELECT entity, variant, 'best_f1_search' AS strategy, thr FROM f4 QUALIFY row_number() OVER (PARTITION BY entity, variant ORDER BY f1 DESC, k) = 1
 UNION ALL SELECT entity, variant, 'anomaly_ratio', thr FROM f5 QUALIFY row_number() OVER (PARTITION BY entity, variant ORDER BY f1 DESC, ratio) = 1
 UNION ALL SELECT entity, variant, 'pot', thr FROM p6 CROSS JOIN (SELECT unnest(['raw', 'adjusted']) AS variant) UNION ALL SELECT entity, variant, 'quantile_0.95', q FROM p6 CROSS JOIN (SELECT unnest(['raw', 'adjusted']) AS variant))"""


def variants(spark, d):
    """Thresholds of every strategy, and the test scores as they are and point-adjusted."""
    s = scored(spark, d)
    raw = s.where("split = 'test'").select(*KEYS, "t", "label", "score")
    adjusted = settled(detect.point_adjust(raw, "score").select(*raw.columns))
    thr = settled(volume.strategies(s.where("split = 'train'"), raw, adjusted, ["entity"], 0.95, 0.1))
    both = raw.withColumn("variant", F.lit("raw")).unionByName(adjusted.withColumn("variant", F.lit("adjusted")))
    return thr, both


@query("t7_strategies", "SELECT entity, variant, strategy, round(thr, 5) AS thr FROM st", STRATEGY_SQL)
def t7(spark, d):
    return variants(spark, d)[0].select("entity", "variant", "strategy", (F.round("thr", 5) + 0.0).alias("thr"))


@query("j13_report", """m AS (SELECT entity, variant, strategy, any_value(thr) AS threshold, sum(CASE WHEN score > thr THEN label ELSE 0 END) AS tp, sum(CASE WHEN score > thr THEN 1 ELSE 0 END) AS np, sum(label) AS pos FROM two JOIN st USING (entity, variant) GROUP BY ALL),
g AS (SELECT entity, variant, score, sum(label) AS pos, count(*) AS n FROM two GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY entity, variant) AS al, sum(n) OVER (PARTITION BY entity, variant) AS tot FROM g WINDOW w AS (PARTITION BY entity, variant ORDER BY score DESC)),
f AS (SELECT entity, variant, sum((n - pos) * (tp - pos / 2)) / (any_value(al) * (any_value(tot) - any_value(al))) AS auroc, sum(pos / al * tp / seen) AS auprc, max(2 * tp / (seen + al)) AS best_f1 FROM c GROUP BY ALL),
l AS (SELECT entity, variant, strategy, 'threshold' AS metric, threshold AS value FROM m UNION ALL SELECT entity, variant, strategy, 'precision', coalesce(tp / nullif(np, 0), 0) FROM m
 UNION ALL SELECT entity, variant, strategy, 'recall', coalesce(tp / nullif(pos, 0), 0) FROM m UNION ALL SELECT entity, variant, strategy, 'f1', coalesce(2 * tp / nullif(np + pos, 0), 0) FROM m
 UNION ALL SELECT entity, variant, 'free', 'auroc', auroc FROM f UNION ALL SELECT entity, variant, 'free', 'auprc', auprc FROM f UNION ALL SELECT entity, variant, 'free', 'best_f1', best_f1 FROM f)
SELECT entity, variant, strategy, metric, round(value, 5) AS value FROM l""", STRATEGY_SQL)
def j13(spark, d):
    thr, both = variants(spark, d)
    out = volume.report(settled(both), thr, ["entity"])
    return out.withColumn("value", F.round("value", 5) + 0.0)


@query("j13_suite")
def j13_suite(spark, d):
    """The raw scores alone, so nothing is adjusted."""
    s = scored(spark, d)
    raw = settled(s.where("split = 'test'").select(*KEYS, "t", "label", "score"))
    thr = settled(volume.strategies(s.where("split = 'train'"), raw, None, ["entity"], 0.95, 0.1).select("entity", "strategy", "thr"))
    return rounded(volume.suite(raw, thr, ["entity"], BUFFER, CUTS), "value")


# -- merged models -------------------------------------------------------------------------------------

LAG_SQL = """, lg AS (SELECT cluster, entity, x, lag(x) OVER (PARTITION BY entity ORDER BY t) AS l FROM scaled WHERE split = 'train'),
fe AS (SELECT cluster, entity, count(*) AS n, sum(l * l) AS g, sum(l * x) AS b, sum(x * x) AS q FROM lg WHERE l IS NOT NULL GROUP BY ALL),
fc AS (SELECT cluster, sum(n) AS n, sum(g) AS g, sum(b) AS b, sum(q) AS q FROM fe GROUP BY cluster),
av AS (SELECT cluster, sum(n * b / (g + 1e-4 * n)) / sum(n) AS w FROM fe GROUP BY cluster)"""


def client_fits(spark, d, lags=1):
    """Sums and models of each entity, for one lag: what SQL can solve too. Tests compare eight lags with numpy."""
    stats = settled(detect.ar_stats(scaled(spark, d).where("split = 'train'"), ["cluster", "entity"], lags))
    fits = detect.ar_solve(stats, ["cluster", "entity"]).join(stats.select("cluster", "entity", "n"), ["cluster", "entity"])
    return stats, merging.vector_mean(fits, ["cluster"], "w", "n")


@query("h10_parameter_average", "SELECT cluster, n::BIGINT AS n, round(w, 6) AS w FROM fc JOIN av USING (cluster)", SCALED_SQL + LAG_SQL)
def h10(spark, d):
    return client_fits(spark, d)[1].select("cluster", "n", (F.round(F.get("w", F.lit(0)), 6) + 0.0).alias("w"))


@query("h13_excess_objective", """e AS (SELECT cluster, q - b / (g + 1e-4 * n) * b AS optimum, pow(w - b / (g + 1e-4 * n), 2) * (g + 1e-4 * n) AS excess FROM fc JOIN av USING (cluster))
SELECT cluster, round(optimum, 5) AS optimum, round(excess, 5) AS excess, round(excess / optimum, 7) AS relative FROM e""", SCALED_SQL + LAG_SQL)
def h13(spark, d):
    stats, mean = client_fits(spark, d)
    merged = settled(merging.sum_stats(stats, ["cluster"]))
    out = merging.excess_objective(merged, detect.ar_solve(merged, ["cluster"]), mean, ["cluster"])
    return out.select("cluster", *((F.round(c, k) + 0.0).alias(c) for c, k in (("optimum", 5), ("excess", 5), ("relative", 7))))


@query("h14_exactness_witness")
def h14(spark, d):
    s = settled(scaled(spark, d).where("split = 'train'"))
    merged = merging.sum_stats(detect.ar_stats(s, ["cluster", "entity"], 8), ["cluster"])
    pooled = merging.design_stats(s, ["cluster"], 8)
    return merging.witness(detect.ar_solve(merged, ["cluster"]), detect.ar_solve(pooled, ["cluster"]), ["cluster"])


# -- clients side by side ------------------------------------------------------------------------------


@query("u5_client_outputs", """o AS (SELECT s.cluster, f.entity AS client, s.entity, s.t, s.label, s.x - f.b / (f.g + 1e-4 * f.n) * lag(s.x) OVER (PARTITION BY f.entity, s.entity ORDER BY s.t) AS y FROM scaled AS s JOIN fe AS f ON f.cluster = s.cluster WHERE s.split = 'test')
SELECT o.cluster, o.label, o.client AS a, p.client AS b, count(*) AS n, round(avg(abs(o.y - p.y)), 6) AS mae, round(max(abs(o.y - p.y)), 6) AS widest, round(corr(o.y, p.y), 6) AS r
FROM o JOIN o AS p ON p.entity = o.entity AND p.t = o.t AND o.client < p.client WHERE o.y IS NOT NULL AND p.y IS NOT NULL GROUP BY ALL""", SCALED_SQL + LAG_SQL)
def u5_clients(spark, d):
    """One-step errors of each client's model on the same test points of its cluster: pairs of clients (L20: `widest`)."""
    s = scaled(spark, d)
    fits = detect.ar_solve(detect.ar_stats(s.where("split = 'train'"), ["cluster", "entity"], 1), ["cluster", "entity"]).select("cluster", F.col("entity").alias("client"), "w")
    test = framed(s.where("split = 'test'"), 1, 0, {"l": lambda w: F.lag("x").over(w)}).where("l is not null")
    out = test.join(fits, "cluster").select("cluster", "client", "entity", "t", "label", (F.col("x") - F.get("w", F.lit(0)) * F.col("l")).alias("y"))
    return rounded(merging.output_gaps(out, ["entity", "t"], ["cluster", "label"]), "mae", "widest", "r")


@query("r23_hit_table", """b AS (SELECT head AS arm, entity, t AS t_top FROM (SELECT *, row_number() OVER (PARTITION BY entity, head ORDER BY score DESC, t) AS r FROM lng) WHERE r = 1),
h AS (SELECT b.arm, b.entity, CASE WHEN min(abs(p.t - b.t_top)) <= 5 THEN 1 WHEN count(p.t) > 0 THEN 0 END AS hit FROM b LEFT JOIN (SELECT DISTINCT entity, t FROM lng WHERE label = 1) AS p ON p.entity = b.entity GROUP BY ALL)
SELECT arm, entity, round(avg(hit), 6) AS rate, count(*) AS n FROM h WHERE hit IS NOT NULL GROUP BY GROUPING SETS ((arm, entity), (arm))""", FUSION_SQL)
def r23(spark, d):
    heads = settled(fusion.long_scores(head_scores(spark, d), HEADS))
    hits = detect.score_extremes(heads.withColumnRenamed("head", "arm"), ["arm", "entity"], 5)
    return rounded(merging.hit_table(hits.select("arm", "entity", F.col("top1").alias("hit")), ["entity"]), "rate")


@query("r24_relabelled_records", RECORD_SQL + ", x AS (SELECT 1) SELECT CASE WHEN arm = 'causal' THEN 'ma_causal' ELSE arm END AS arm, entity, seed, round(value, 6) AS value FROM rec")
def r24(spark, d):
    r = records(spark, d)
    both = r.where("arm = 'centred'").unionByName(merging.relabelled(r.where("arm = 'causal'"), {"causal": "ma_causal"}))
    return rounded(both.select("arm", "entity", "seed", "value"), "value")


@query("l14_participation", """ex AS (SELECT vec_id, i, v[i] AS x FROM vec CROSS JOIN (SELECT unnest(range(1, 65)) AS i)),
c AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS c FROM ex AS a JOIN ex AS b USING (vec_id) GROUP BY ALL)
SELECT round(pow(sum(CASE WHEN i = j THEN c ELSE 0 END), 2) / sum(c * c), 6) AS participation FROM c""", ASSIGN_SQL)
def l14(spark, d):
    return rounded(models.participation_ratio(tables.vectors_from_embeddings(read(spark, d, "embeddings"))), "participation")


@query("l16_whitening")
def l16(spark, d):
    """Mean, whitening matrix and condition number of each client's vectors."""
    v = tables.vectors_from_embeddings(read(spark, d, "embeddings"))
    return merging.whitening(detect.gram(v, ["client"]), ["client"])


# -- galleries, reclustered codebooks, rescored regions --------------------------------------------------


@query("l9_union_recluster")
def l9(spark, d):
    v = assigned(spark, d)
    st = models.round_stats(v).groupBy("client", "code").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("m"))
    book = models.first_codebook(tables.vectors_from_embeddings(read(spark, d, "embeddings")), K).select(F.col("code").alias("slot"), "c")
    out = gallery.recluster(st.withColumn("m", F.transform("m", lambda e: e["m"])), book, 3.0)
    return out.select(F.col("slot").cast("long").alias("slot"), F.posexplode("c").alias("dim", "x"), "n").select("slot", F.col("dim").cast("long").alias("dim"), r6("x").alias("x"), "n")


@query("l19_gallery_error", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS nearest, list_distance(a.v, b.v) AS dd FROM v AS a JOIN v AS b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0)
SELECT id, nearest, round(dd / sqrt(64), 6) AS rmse FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY dd, nearest) = 1""", "")
def l19(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rounded(gallery.nearest_in_gallery(v.where("id % 20 = 0"), v.where("id % 20 <> 0")).select("id", "nearest", "rmse"), "rmse")


@query("s8_region_rescore", f"""wi AS (SELECT a.entity, a.t AS w, max(b.label) AS y, max(b.score) AS top, any_value(a.thr) AS thr FROM pred AS a JOIN pred AS b ON a.entity = b.entity AND b.t BETWEEN a.t AND a.t + {WIDTH - 1} WHERE a.t % {STRIDE} = 0 GROUP BY a.entity, a.t HAVING count(*) = {WIDTH}),
hw AS (SELECT * FROM wi WHERE y = 1 AND top > thr), vr AS (SELECT unnest([0.05, 0.5]) AS part),
nw AS (SELECT p.entity, part, p.t, any_value(p.s1) - count(w) * part * any_value(p.s0) AS raw FROM pred AS p CROSS JOIN vr LEFT JOIN hw ON hw.entity = p.entity AND p.t BETWEEN w AND w + {WIDTH - 1} GROUP BY p.entity, part, p.t),
fi AS (SELECT *, 0.5 * (raw + avg(raw) OVER (PARTITION BY entity, part ORDER BY t ROWS BETWEEN {WIDTH // 2} PRECEDING AND {WIDTH // 2 - 1} FOLLOWING)) AS score FROM nw),
tev AS (SELECT DISTINCT segs.entity, a, b FROM segs JOIN hw ON hw.entity = segs.entity AND w <= b AND w + {WIDTH - 1} >= a),
fl AS (SELECT part, CASE WHEN max(score) < any_value(thr.thr) THEN 1.0 ELSE 0.0 END AS ok FROM tev JOIN fi ON fi.entity = tev.entity AND t BETWEEN a AND b JOIN thr ON thr.entity = tev.entity GROUP BY tev.entity, a, part)
SELECT CAST(part AS DOUBLE) AS part, round(avg(ok), 6) AS validity, round(stddev_pop(ok), 6) AS spread, count(*) AS n_events FROM fl GROUP BY part""", PRED_SQL)
def s8(spark, d):
    heads = detect.ma_centred(scaled(spark, d), HEAD_K)
    own = ["entity", "channel"]
    kept = settled(detect.assemble(heads, WIDTH, STRIDE).where("split = 'test'").select("entity", "cluster", "split", "channel", "t", "label", F.col("score").alias("raw")))
    final = detect.impulse(kept.withColumn("score", F.col("raw")), WIDTH)
    points = settled(detect.predict(final, detect.quantile_threshold(scored(spark, d).where("split = 'train'"), own, QUANTILE), own))
    windows = prep.sliding_windows(points.withColumn("value", F.struct("score", "label")), WIDTH, STRIDE).join(points.groupBy(*own).agg(F.max("thr").alias("thr")), own)
    top = F.array_max(F.transform("w", lambda e: e["score"]))
    hit = windows.where((F.array_max(F.transform("w", lambda e: e["label"])) == 1) & (top > F.col("thr"))).select(*own, "w_start")
    plain = prep.sliding_windows(heads.where("split = 'test'").withColumn("value", F.col("score")), WIDTH, STRIDE).join(hit, [*own, "w_start"])
    parts = F.explode(F.array(F.lit(0.05), F.lit(0.5))).alias("part")
    deltas = settled(plain.select(*own, "w_start", "w", parts).select(*own, "w_start", "part", F.transform("w", lambda x: -F.col("part") * x).alias("d")))
    events = prep.segments(points, keys=["entity"]).select("entity", "start", "stop")
    thr = points.groupBy("entity").agg(F.max("thr").alias("thr"))
    return rounded(gallery.region_validity(kept, deltas, events, thr, WIDTH, ["entity"], ["part"]), "validity", "spread")
