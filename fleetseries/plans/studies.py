"""Registered queries of fault injection, descriptors, clean windows, integrity, records and affiliation. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseries.functions.frames import correlation, quantiles, r6, settled
from fleetseries.operators import catalog, describe, detect, faults, models, prep, priors, spectral
from fleetseries.operators.prep import KEYS
from fleetseries.plans.fleet import FUSION_SQL, PAIR_RECORDS, PRIOR_SQL, channel_points, differences, head_scores
from fleetseries.plans.queries import (
    ASSIGN_SQL, DETREND_SQL, ENTITY, K, MULTI_SQL, ORACLES, PRED_SQL, RECORD_SQL, SCORED_SQL, SEGMENT_SQL, SERIES_SQL, TOKEN_SQL, TOKENS, WIDTH, WINDOW_SQL,
    assigned, daily, multi, predicted, query, read, records, rounded, scaled, scored, series, tokens, train_counts,
)
from fleetseries.sources import tables
from fleetseries.sources.tables import DAILY_SQL


def u_sql(name: str) -> str:
    return f"((('0x' || substr(md5({name}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def z_sql(name: str) -> str:
    first, second = u_sql(f"{name} || '|r'"), u_sql(f"{name} || '|a'")
    return f"(sqrt(-2 * ln({first})) * cos(2 * pi() * {second}))"


# -- faults --------------------------------------------------------------------------------------------

KINDS = ["spike", "level_shift", "ramp", "group_spike", "group_drift", "noise_burst", "frequency_shift", "amplitude_drop", "amplitude_burst", "flatline", "missed_beat", "contextual_point", "phase_jump", "period_break", "waveform_swap", "double_beat"]
ADDED, ABOUT_MEAN, REPLACED = KINDS[:7] + KINDS[15:], KINDS[7:9], KINDS[9:15]
KIND_SQL = ", ".join(f"('{k}', {4 + 12 * j})" for j, k in enumerate(KINDS))
FAULT_SQL = SERIES_SQL + f""",
fa AS (SELECT entity, split, kind, st AS start, st + 8 AS stop, {u_sql("concat_ws('|', entity, st, kind)")} AS u FROM (SELECT DISTINCT entity, split FROM series WHERE split = 'test') CROSS JOIN (VALUES {KIND_SQL}) AS k(kind, st)),
mk AS (SELECT s.entity, s.t, s.value AS x, f.kind, f.start, s.t - f.start AS k, f.u, h.value AS held, avg(s.value) OVER (PARTITION BY s.entity, f.start) AS mean, avg(s.value) OVER (PARTITION BY s.entity) AS al,
       {z_sql("concat_ws('|', s.entity, f.start, f.kind, s.t)")} AS z
       FROM series AS s LEFT JOIN fa AS f ON f.entity = s.entity AND s.t >= f.start AND s.t < f.stop LEFT JOIN series AS h ON h.entity = s.entity AND h.split = 'test' AND h.t = f.start - 1 WHERE s.split = 'test'),
fy AS (SELECT *, CASE kind WHEN 'spike' THEN x + CASE WHEN u < 0.5 THEN -6 ELSE 6 END WHEN 'level_shift' THEN x + 3 * (0.8 + 0.4 * u) WHEN 'ramp' THEN x + 3 * k / 7.0 WHEN 'group_spike' THEN x + 4 WHEN 'group_drift' THEN x + 2 * k / 7.0
 WHEN 'noise_burst' THEN x + 1.5 * z WHEN 'frequency_shift' THEN x + 1.8 * sin(2 * pi() * k / 8) WHEN 'amplitude_drop' THEN mean + 0.25 * (x - mean) WHEN 'amplitude_burst' THEN mean + 3 * (x - mean) WHEN 'flatline' THEN held WHEN 'missed_beat' THEN held
 WHEN 'contextual_point' THEN al WHEN 'phase_jump' THEN mean + 1.2 * sin(2 * pi() * k / 32 + pi() * (0.5 + u)) WHEN 'period_break' THEN mean + sin(2 * pi() * k / (32 / (1.5 + 0.7 * u))) WHEN 'waveform_swap' THEN mean + 2.8 * (k / 32.0 - floor(0.5 + k / 32.0))
 WHEN 'double_beat' THEN x + 1.5 * sin(4 * pi() * k / 32) ELSE x END AS y FROM mk)"""


def injected(spark, d):
    s = series(spark, d).where("split = 'test'")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(4 + 12 * j).cast("long").alias("start")) for j, k in enumerate(KINDS)))).alias("f")
    spans = s.select(*KEYS).distinct().select(*KEYS, kinds).select(*KEYS, "f.kind", "f.start", (F.col("f.start") + 8).alias("stop"))
    return faults.inject(s, spans)


def kinds_query(name: str, kinds: list[str]) -> None:
    inside = ", ".join(f"'{k}'" for k in kinds)

    @query(name, f"SELECT entity, kind, t, round(y, 8) AS faulty FROM fy WHERE kind IN ({inside})", FAULT_SQL)
    def run(spark, d):
        return injected(spark, d).where(F.col("kind").isin(kinds)).select("entity", "kind", "t", (F.round("faulty", 8) + 0.0).alias("faulty"))


kinds_query("i1_added_faults", ADDED)
kinds_query("i2_faults_about_mean", ABOUT_MEAN)
kinds_query("i3_replaced_values", REPLACED)


@query("i6_change_events", "SELECT entity, split, start, start + 8 AS stop, sum(CASE WHEN abs(y - x) > 1e-9 THEN 1 ELSE 0 END)::BIGINT AS n_changed, count(DISTINCT CASE WHEN abs(y - x) > 1e-9 THEN 0 END) AS n_channels FROM (SELECT *, 'test' AS split FROM fy) WHERE kind IS NOT NULL GROUP BY ALL", FAULT_SQL)
def i6(spark, d):
    return faults.change_events(injected(spark, d), ["entity", "split"])


#: channel, start, stop, source, shift, sign: negated copy, lag, group, permutation, loss of step.
CROSS = [(1, 10, 34, 0, 0, -1), (2, 40, 72, 2, 16, 1), *((c, 80, 104, 0, 0, 1) for c in (1, 2, 3, 4)), (0, 120, 150, 1, 0, 1), (1, 120, 150, 2, 0, 1), (2, 120, 150, 0, 0, 1), *((c, 160, 190, c, 8 + 3 * c, 1) for c in range(5))]
CROSS_SQL = ", ".join(str(c) for c in CROSS)


def constant(spark, rows, schema):
    return F.broadcast(spark.createDataFrame(rows, schema))  # a fixed list


@query("i4_cross_channel_faults", f"""f AS (SELECT * FROM (VALUES {CROSS_SQL}) AS v(channel, start, stop, source, shift, sgn))
SELECT m.entity, m.channel, m.t, round(f.sgn * o.value, 6) AS faulty FROM multi AS m JOIN f ON f.channel = m.channel AND m.t >= f.start AND m.t < f.stop
JOIN multi AS o ON o.entity = m.entity AND o.channel = f.source AND o.t = f.start + (m.t - f.start - f.shift + 1000 * (f.stop - f.start)) % (f.stop - f.start)""", MULTI_SQL)
def i4(spark, d):
    m = multi(spark, d)
    spans = m.select("entity", "split").distinct().crossJoin(constant(spark, CROSS, "channel int, start long, stop long, source int, shift long, sign int"))
    return faults.borrow(m, spans).where("start is not null and faulty is not null").select("entity", "channel", "t", r6("faulty").alias("faulty"))


@query("i5_one_hot_faults", """f AS (SELECT * FROM (VALUES (10, 20, [0, 1]), (30, 40, []::INTEGER[]), (50, 60, [2])) AS v(start, stop, active))
SELECT m.entity, m.channel, m.t, CASE WHEN list_contains(active, m.channel) THEN 1.0 ELSE 0.0 END AS faulty FROM multi AS m JOIN f ON m.t >= f.start AND m.t < f.stop""", MULTI_SQL)
def i5(spark, d):
    m = multi(spark, d)
    spans = m.select("entity", "split").distinct().crossJoin(constant(spark, [(10, 20, [0, 1]), (30, 40, []), (50, 60, [2])], "start long, stop long, active array<int>"))
    return faults.one_hot(m, spans).where("start is not null").select("entity", "channel", "t", "faulty")


# -- descriptors ---------------------------------------------------------------------------------------

PROFILE_SQL = """
ev AS (SELECT 'u' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS entity, hour(ts) AS hour, value FROM events),
lv AS (SELECT entity, hour, avg(ln(1 + value - low)) AS level FROM (SELECT *, min(value) OVER (PARTITION BY entity) AS low FROM ev) GROUP BY ALL),
ext AS (SELECT entity, hour + o AS h, level, count(*) OVER (PARTITION BY entity) / 3 AS filled FROM lv CROSS JOIN (VALUES (-24), (0), (24)) AS v(o)),
br AS (SELECT g.h, x.entity, any_value(filled) AS filled, max(CASE WHEN x.h <= g.h THEN x.h END) AS a, arg_max(CASE WHEN x.h <= g.h THEN level END, CASE WHEN x.h <= g.h THEN x.h END) AS la, min(CASE WHEN x.h >= g.h THEN x.h END) AS b, arg_min(CASE WHEN x.h >= g.h THEN level END, CASE WHEN x.h >= g.h THEN x.h END) AS lb
       FROM (SELECT unnest(range(0, 24)) AS h) AS g CROSS JOIN ext AS x GROUP BY g.h, x.entity),
pf AS (SELECT entity, h, CASE WHEN filled < 2 THEN 0 ELSE CASE WHEN a = b THEN la ELSE la + (lb - la) * (h - a) / (b - a) END END AS p FROM br),
d1 AS (SELECT entity, h AS hour, (p - avg(p) OVER e) / (stddev_pop(p) OVER e + 1e-9) AS z FROM pf WINDOW e AS (PARTITION BY entity))"""


def profiles(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("u"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")).alias("entity"), "ts", "value")
    return describe.day_profiles(prep.hour_profile(e))


def hours(profile):
    return profile.select("entity", F.col("hour").cast("long").alias("hour"), r6("z").alias("z"))


@query("d1_day_profile", "SELECT entity, hour, round(z, 6) AS z FROM d1", PROFILE_SQL)
def d1(spark, d):
    return hours(profiles(spark, d))


@query("d2_deviation_profile", "v AS (SELECT entity, hour, z - avg(z) OVER (PARTITION BY hour) AS z FROM d1) SELECT entity, hour, round((z - avg(z) OVER e) / (stddev_pop(z) OVER e + 1e-9), 6) AS z FROM v WINDOW e AS (PARTITION BY entity)", PROFILE_SQL)
def d2(spark, d):
    return hours(describe.deviation_profiles(profiles(spark, d)))


VEC_SQL = "vec AS (SELECT label AS cluster, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def vectors(spark, d):
    return tables.vectors_from_embeddings(read(spark, d, "embeddings"))


def clustered(spark, d):
    return vectors(spark, d).withColumnRenamed("client", "cluster")


@query("d4_cosine_cohesion", """p AS (SELECT a.cluster, a.vec_id, b.cluster AS c2, b.vec_id AS id2, list_cosine_similarity(a.v, b.v) AS s FROM vec AS a CROSS JOIN vec AS b)
SELECT cluster, count(DISTINCT vec_id) AS n, round(avg(CASE WHEN c2 = cluster AND id2 <> vec_id THEN s END), 6) AS within, round(avg(CASE WHEN c2 <> cluster THEN s END), 6) AS between FROM p GROUP BY cluster""", VEC_SQL)
def d4(spark, d):
    return rounded(describe.cosine_cohesion(clustered(spark, d)), "within", "between")


@query("d4_silhouette", """p AS (SELECT a.cluster, a.vec_id, b.cluster AS c2, sum(pow(list_distance(a.v, b.v), 2)) AS s, count(*) AS n FROM vec AS a CROSS JOIN vec AS b GROUP BY ALL),
q AS (SELECT cluster, vec_id, max(CASE WHEN c2 = cluster THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN c2 <> cluster THEN s / n END) AS b FROM p GROUP BY ALL)
SELECT cluster, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM q GROUP BY cluster""", VEC_SQL)
def d4s(spark, d):
    return describe.silhouette(clustered(spark, d)).groupBy("cluster").agg(F.count("*").alias("n"), (F.round(F.avg("silhouette"), 5) + 0.0).alias("silhouette"))


HOUR_SQL = SERIES_SQL + """,
hr AS (SELECT 'u' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS entity, 'c' || CAST(user_id % 4 AS VARCHAR) AS cluster, date_trunc('hour', ts) AS ts, avg(value) AS value, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS label FROM events GROUP BY ALL),
ov AS (SELECT a.entity AS ea, b.entity AS eb, count(*) AS n, CASE WHEN stddev_pop(a.value) <= 1e-9 OR stddev_pop(b.value) <= 1e-9 THEN 0 ELSE abs(corr(a.value, b.value)) END AS r, coalesce(sum(a.label * b.label) / nullif(sum(greatest(a.label, b.label)), 0), 0) AS jaccard
       FROM hr AS a JOIN hr AS b ON a.ts = b.ts AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 100),
ed AS (SELECT ea, eb FROM ov WHERE r > 0.12 OR jaccard > 0.5)"""


def hourly(spark, d):
    e = read(spark, d, "events")
    name = F.concat(F.lit("u"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")).alias("entity")
    return e.groupBy(name, F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("cluster"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"), F.max((F.col("event_type") == "error").cast("int")).alias("label"))


def overlapping(spark, d):
    return describe.overlaps(hourly(spark, d), 100)


def alike(spark, d):
    return overlapping(spark, d).where("r > 0.12 or jaccard > 0.5").select("ea", "eb")


@query("d5_overlap", "SELECT ea, eb, n, round(r, 6) AS r, round(jaccard, 6) AS jaccard FROM ov", HOUR_SQL)
def d5(spark, d):
    return rounded(overlapping(spark, d), "r", "jaccard")


@query("d6_near_duplicates", """nd AS (SELECT entity, count(*) AS n FROM hr GROUP BY entity),
rc AS (SELECT entity, entity AS grp FROM nd UNION SELECT CASE WHEN e.ea = r.entity THEN e.eb ELSE e.ea END, r.grp FROM rc AS r JOIN ed AS e ON r.entity IN (e.ea, e.eb)),
g AS (SELECT entity, min(grp) AS grp FROM rc GROUP BY entity)
SELECT entity, grp, n, CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY n DESC, entity) = 1 THEN 1 ELSE 0 END AS kept FROM g JOIN nd USING (entity)""", HOUR_SQL)
def d6(spark, d):
    n = hourly(spark, d).groupBy("entity").agg(F.count("*").alias("n"))
    return describe.keep_longest(describe.groups(n, alike(spark, d)).join(n, "entity"))


ORACLES["d6_near_duplicates"] = ORACLES["d6_near_duplicates"].replace("WITH", "WITH RECURSIVE", 1)


@query("d7_cluster_agreement", """cl AS (SELECT DISTINCT entity, cluster FROM hr), z AS (SELECT count(*) AS n FROM cl GROUP BY cluster)
SELECT count(*) AS n_pairs, round(avg(CASE WHEN a.cluster = b.cluster THEN 1.0 ELSE 0.0 END), 6) AS same, round((SELECT sum(n * n) / pow(sum(n), 2) FROM z), 6) AS chance FROM ed JOIN cl AS a ON a.entity = ea JOIN cl AS b ON b.entity = eb""", HOUR_SQL)
def d7(spark, d):
    return rounded(describe.cluster_agreement(alike(spark, d), hourly(spark, d).select("entity", "cluster").distinct()), "same", "chance")


@query("d8_nearest_centroid", """m AS (SELECT cluster, i, avg(v[i]) AS c FROM vec CROSS JOIN (SELECT unnest(range(1, 65)) AS i) WHERE cluster < 5 GROUP BY ALL),
x AS (SELECT vec_id, m.cluster AS code, sqrt(sum(pow(v[i] - c, 2))) AS distance FROM vec JOIN m ON vec.cluster >= 5 GROUP BY ALL)
SELECT vec_id, code, round(distance, 6) AS distance FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, code) = 1""", VEC_SQL)
def d8(spark, d):
    v = clustered(spark, d)
    return rounded(describe.nearest_centroid(v.where("cluster >= 5").drop("cluster"), v.where("cluster < 5")).select("vec_id", "code", "distance"), "distance")


# -- codebooks -----------------------------------------------------------------------------------------


def lloyd_sql(first: str, rounds: int) -> str:
    steps = [f"b0 AS ({first})"]
    for k in range(rounds):
        steps.append(
            f"d{k} AS (SELECT vec_id, v, code, list_distance(v, c) AS dd FROM vec CROSS JOIN b{k}), "
            f"a{k} AS (SELECT * FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dd, code) = 1), "
            f"m{k} AS (SELECT code, list(x ORDER BY i) AS c FROM (SELECT code, i, avg(v[i]) AS x FROM a{k} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY code), "
            f"b{k + 1} AS (SELECT b.code, coalesce(m.c, b.c) AS c FROM b{k} AS b LEFT JOIN m{k} AS m USING (code))"
        )
    return ", ".join(steps) + f" SELECT code, i - 1 AS dim, round(c[i], 6) AS x FROM b{rounds} CROSS JOIN (SELECT unnest(range(1, 65)) AS i)"


def cells(book, *keys):
    return book.select("code", *keys, F.posexplode("c").alias("dim", "x")).select(F.col("code").cast("long").alias("code"), *keys, F.col("dim").cast("long").alias("dim"), r6("x").alias("x"))


MD5_BOOK = "SELECT row_number() OVER (ORDER BY h) - 1 AS code, v AS c FROM (SELECT v, md5(CAST(vec_id AS VARCHAR)) AS h FROM vec ORDER BY h LIMIT {0})"


@query("d3_kmeans", lloyd_sql(f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS code, v AS c FROM (SELECT * FROM vec ORDER BY vec_id LIMIT {K})", 3), VEC_SQL)
def d3(spark, d):
    v = vectors(spark, d)
    return cells(describe.lloyd(v, models.first_codebook(v, K), 3))


@query("l2_seeded_codebook", lloyd_sql(MD5_BOOK.format(K), 2), VEC_SQL)
def l2(spark, d):
    v = vectors(spark, d)
    return cells(describe.lloyd(v, describe.md5_codebook(v, K), 2))


@query("l5_moving_usage", "u AS (SELECT code, vec_id % 4 AS round, count(*) AS n FROM asg GROUP BY ALL), g AS (SELECT c.code, r.round FROM (SELECT DISTINCT code FROM u) AS c CROSS JOIN (SELECT DISTINCT round FROM u) AS r), e AS (SELECT g.code, g.round, coalesce(sum(0.1 * pow(0.9, g.round - u.round) * u.n), 0) AS ema FROM g LEFT JOIN u ON u.code = g.code AND u.round <= g.round GROUP BY ALL) SELECT code, round, round(ema, 6) AS ema, round(ema / (1 - pow(0.9, round + 1)), 6) AS corrected FROM e", ASSIGN_SQL)
def l5(spark, d):
    n = assigned(spark, d).groupBy(F.col("code").cast("long").alias("code"), (F.col("vec_id") % 4).alias("round")).agg(F.count("*").alias("n"))
    return rounded(catalog.moving_usage(n, 0.9), "ema", "corrected")


@query("l6_revive", f"""n AS (SELECT code, c, coalesce(k, 0) AS n FROM book LEFT JOIN (SELECT code, count(*) AS k FROM asg GROUP BY code) USING (code)),
r AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY n DESC, code) - 1 AS r, (SELECT count(*) FROM n WHERE n >= 20) AS m FROM n),
o AS (SELECT code, c, 0 AS revived FROM r WHERE n >= 20 UNION ALL SELECT a.code, list_transform(range(0, 64), lambda i: b.c[i + 1] + 0.01 * (2 * {u_sql("a.code || '|' || i")} - 1)), 1 FROM r AS a JOIN r AS b ON a.n < 20 AND b.n >= 20 AND b.r = a.r % a.m)
SELECT code, revived, i - 1 AS dim, round(c[i], 6) AS x FROM o CROSS JOIN (SELECT unnest(range(1, 65)) AS i)""", ASSIGN_SQL)
def l6(spark, d):
    book = models.first_codebook(vectors(spark, d), K)
    return cells(catalog.revive(book, assigned(spark, d).groupBy("code").agg(F.count("*").alias("n")), 20, 0.01), "revived")


@query("l10_prototypes", f"""g AS (SELECT code, dim, sum(n) AS n, sum(m) AS m FROM st GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY dim) AS al FROM g), a AS (SELECT code, dim, n, m / ((n + 1e-5) / (al + {K} * 1e-5) * al) AS x FROM t), b AS (SELECT code, dim, avg(m / n) AS y FROM st GROUP BY ALL)
SELECT code, max(n)::BIGINT AS n, round(sqrt(sum(pow(y - x, 2))) / sqrt(sum(x * x)), 6) AS gap FROM a JOIN b USING (code, dim) GROUP BY code HAVING max(n) >= 20""", ASSIGN_SQL)
def l10(spark, d):
    st = models.round_stats(assigned(spark, d))
    support = st.groupBy("code").agg((F.sum("n") / F.count_distinct("dim")).cast("long").alias("n"))
    met = models.merge_stats(st, K).join(models.merge_uniform(st).select("code", "dim", F.col("x").alias("y")), ["code", "dim"]).join(support.where("n >= 20"), "code")
    gap = F.sqrt(F.sum(F.pow(F.col("y") - F.col("x"), 2))) / F.sqrt(F.sum(F.col("x") * F.col("x")))
    return rounded(met.groupBy(F.col("code").cast("long").alias("code"), "n").agg(gap.alias("gap")), "gap")


@query("l11_residual_codes", f"""r1 AS (SELECT a.vec_id, a.code AS code_1, list_transform(range(1, 65), lambda i: a.v[i] - b.c[i]) AS v FROM asg AS a JOIN book AS b USING (code)),
b2 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS code_2, v AS c FROM (SELECT v, md5(CAST(vec_id AS VARCHAR)) AS h FROM r1 ORDER BY h LIMIT 8)),
d2 AS (SELECT r1.vec_id, code_1, code_2, list_distance(v, c) AS dd FROM r1 CROSS JOIN b2)
SELECT vec_id, code_1, code_2, round(dd, 6) AS left_over FROM d2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dd, code_2) = 1""", ASSIGN_SQL)
def l11(spark, d):
    v = vectors(spark, d)
    first = models.first_codebook(v, K)
    second = describe.md5_codebook(describe.residual_codes(v, [first]), 8)
    out = describe.residual_codes(v, [first, second])
    norm = F.sqrt(describe.total(F.transform("v", lambda x: x * x)))
    return out.select("vec_id", *(F.col(f"code_{k}").cast("long").alias(f"code_{k}") for k in (1, 2)), r6(norm).alias("left_over"))


@query("l13_codebook_distance", """bk AS (SELECT client, code, list(m / n ORDER BY dim) AS c FROM st GROUP BY ALL), p AS (SELECT a.client AS a, b.client AS b, a.code, min(list_distance(a.c, b.c)) AS dd FROM bk AS a JOIN bk AS b ON a.client <> b.client GROUP BY ALL)
SELECT a, b, round(avg(dd), 6) AS distance FROM p GROUP BY a, b""", ASSIGN_SQL)
def l13(spark, d):
    st = models.round_stats(assigned(spark, d))
    books = st.groupBy("client", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("m") / F.col("n")).alias("x")))), lambda e: e["x"]).alias("c"))
    return rounded(describe.book_distance(books), "distance")


@query("l17_tokenizer_agreement", """ow AS (SELECT cluster, avg(value) AS mu, greatest(stddev_pop(value), 1e-4) AS sd FROM series WHERE split = 'train' GROUP BY cluster),
pr AS (SELECT s.entity, CAST(least(greatest(floor((x + 3) / 0.375), 0), 15) AS INTEGER) AS a, CAST(least(greatest(floor(((value - mu) / sd + 3) / 0.375), 0), 15) AS INTEGER) AS b FROM scaled AS s JOIN ow USING (cluster)),
n AS (SELECT entity, count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS same FROM pr GROUP BY entity),
us AS (SELECT entity, token, sum(k) AS na, sum(l) AS nb FROM (SELECT entity, a AS token, 1 AS k, 0 AS l FROM pr UNION ALL SELECT entity, b, 0, 1 FROM pr) GROUP BY ALL),
q AS (SELECT us.entity, n, same, sum(na * nb) / (n * n) AS chance, avg(CASE WHEN na > 0 AND nb > 0 THEN 1.0 ELSE 0.0 END) AS jaccard,
 sum(0.5 * ((na + 1) / (n + 16) * ln(2 * (na + 1) / (na + nb + 2)) + (nb + 1) / (n + 16) * ln(2 * (nb + 1) / (na + nb + 2)))) AS js FROM us JOIN n USING (entity) GROUP BY us.entity, n, same)
SELECT entity, n, round(same / n, 6) AS raw, round(chance, 6) AS chance, round((same / n - chance) / (1 - chance), 6) AS kappa, round(jaccard, 6) AS jaccard, round(js, 6) AS js FROM q""", TOKEN_SQL)
def l17(spark, d):
    s = scaled(spark, d)
    both = prep.scale(s.withColumnRenamed("x", "own"), prep.scale_stats(s, ["cluster"]), ["cluster"])
    pairs = both.select("entity", tables.quantise(F.col("own"), TOKENS).alias("a"), tables.quantise(F.col("x"), TOKENS).alias("b"))
    return rounded(catalog.agreement(pairs, ["entity"], TOKENS), "raw", "chance", "kappa", "jaccard", "js")


# -- shapes, spectra, peaks ----------------------------------------------------------------------------

GAP_SQL = DAILY_SQL + """,
gp AS (SELECT entity, t, CASE WHEN t % 97 >= 3 THEN value END AS value FROM daily),
nx AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN t END) OVER w AS pt, last_value(value IGNORE NULLS) OVER w AS pv, min(CASE WHEN value IS NOT NULL THEN t END) OVER f AS nt, first_value(value IGNORE NULLS) OVER f AS nv FROM gp
       WINDOW w AS (PARTITION BY entity ORDER BY t), f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT entity, t, count(*) OVER (PARTITION BY entity) AS n, coalesce(value, pv + (nv - pv) * (t - pt) / (nt - pt), pv, nv) AS v FROM nx)"""


def gappy(spark, d):
    return daily(spark, d).withColumn("value", F.when(F.col("t") % 97 >= 3, F.col("value")))


@query("n6_resample", """g AS (SELECT DISTINCT entity, n, j, j * (n - 1) / 63.0 AS x FROM fl CROSS JOIN (SELECT unnest(range(0, 64)) AS j)),
r AS (SELECT g.entity, j, a.v + (b.v - a.v) * (x - floor(x)) AS r FROM g JOIN fl AS a ON a.entity = g.entity AND a.t = floor(x) JOIN fl AS b ON b.entity = g.entity AND b.t = ceil(x))
SELECT entity, j, round((r - avg(r) OVER e) / (stddev_pop(r) OVER e + 1e-9), 5) AS z FROM r WINDOW e AS (PARTITION BY entity)""", GAP_SQL)
def n6(spark, d):
    out = describe.resample(describe.interpolate(gappy(spark, d), ["entity"]), ["entity"], 64)
    return out.select("entity", F.col("j").cast("long").alias("j"), (F.round("z", 5) + 0.0).alias("z"))


@query("w3_eval_stride", "n AS (SELECT entity, split, count(*) AS n FROM series GROUP BY ALL), w AS (SELECT unnest([16, 45, 128]) AS width) SELECT entity, split, width, greatest(1, CAST(round_even(CAST(0.1 AS DOUBLE) * width, 0) AS BIGINT)) AS stride, CASE WHEN n < width THEN 0 ELSE (n - width) // greatest(1, CAST(round_even(CAST(0.1 AS DOUBLE) * width, 0) AS BIGINT)) + 1 END AS n_windows FROM n CROSS JOIN w")
def w3(spark, d):
    n = series(spark, d).groupBy("entity", "split").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.lit(prep.eval_stride(w)).cast("long").alias("stride")) for w in (16, 45, 128)))).alias("w")
    return n.select("entity", "split", "n", each).select("entity", "split", "w.width", "w.stride", prep.n_windows(F.col("n"), F.col("w.width"), F.col("w.stride")).alias("n_windows"))


@query("w6_box_filter", """n AS (SELECT *, count(*) OVER (PARTITION BY entity, split) AS n FROM series),
p AS (SELECT entity, split, t, value, n FROM n UNION ALL SELECT entity, split, -t, value, n FROM n WHERE t BETWEEN 1 AND 5 UNION ALL SELECT entity, split, 2 * (n - 1) - t, value, n FROM n WHERE t < n - 1 AND t >= n - 6),
m AS (SELECT entity, split, t, n, avg(value) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM p)
SELECT entity, split, t, round(m, 6) AS m FROM m WHERE t >= 0 AND t < n""")
def w6(spark, d):
    return rounded(describe.box_filter(series(spark, d), 5, KEYS).select("entity", "split", "t", "m"), "m")


TILE_WINDOW_SQL = f"""wn AS (SELECT s.entity, s.split, s.t AS w_start, list(p.value ORDER BY p.t) AS w, list(p.m ORDER BY p.t) AS y FROM mm AS s JOIN mm AS p ON p.entity = s.entity AND p.split = s.split AND p.t BETWEEN s.t AND s.t + 15 WHERE s.t % 16 = 0 GROUP BY ALL HAVING count(*) = 16)"""
SMOOTH_SQL = SERIES_SQL + ", mm AS (SELECT *, avg(value) OVER (PARTITION BY entity, split ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM series), " + TILE_WINDOW_SQL


@query("w7_stft_amplitude", """e AS (SELECT entity, split, w_start, w, unnest(range(0, 17)) AS c FROM wn),
f AS (SELECT entity, split, w_start, w[abs(c - 1) + 1] AS b, w[CASE WHEN c >= 16 THEN 30 - c ELSE c END + 1] AS m, w[CASE WHEN c + 1 >= 16 THEN 30 - c - 1 ELSE c + 1 END + 1] AS d FROM e)
SELECT entity, split, w_start, round(sqrt(avg(pow((0.5 * b + m + 0.5 * d) / 2, 2))), 6) AS p0, round(sqrt(avg(pow(m / 2, 2) + pow((d - b) / 4, 2))), 6) AS p1, round(sqrt(avg(pow((m - 0.5 * b - 0.5 * d) / 2, 2))), 6) AS p2 FROM f GROUP BY ALL""", SMOOTH_SQL)
def w7(spark, d):
    frames = prep.sliding_windows(series(spark, d), 16, 16).withColumn("f", F.explode(describe.stft(F.col("w"), 16)))
    power = lambda k: F.sqrt(F.avg(F.pow(F.col("f")[k]["re"], 2) + F.pow(F.col("f")[k]["im"], 2)))
    return frames.groupBy("entity", "split", "w_start").agg(*(r6(power(k)).alias(f"p{k}") for k in range(3)))


DFT = "list_transform(range(0, 9), lambda k: pow(list_sum(list_transform(range(0, 16), lambda i: {0}[i + 1] * cos(2 * pi() * k * i / 16))), 2) + pow(list_sum(list_transform(range(0, 16), lambda i: {0}[i + 1] * sin(2 * pi() * k * i / 16))), 2))"


@query("q3_spectral_retained", f"p AS (SELECT entity, split, w_start, {DFT.format('w')} AS px, {DFT.format('y')} AS py FROM wn) SELECT entity, split, w_start, round(list_sum(py[1:3]) / list_sum(px[1:3]), 5) AS low, round(list_sum(py[4:6]) / list_sum(px[4:6]), 5) AS middle, round(list_sum(py[7:9]) / list_sum(px[7:9]), 5) AS high FROM p", SMOOTH_SQL)
def q3(spark, d):
    s = prep.centred_average(series(spark, d), 10, "m")
    keys = ["entity", "split", "w_start"]
    x, y = prep.sliding_windows(s, 16, 16).select(*keys, F.col("w").alias("x")), prep.sliding_windows(s, 16, 16, "m").select(*keys, F.col("w").alias("y"))
    out = describe.spectral_retained(x.join(y, keys), 16)
    return out.select(*keys, *((F.round(b, 5) + 0.0).alias(b) for b in ("low", "middle", "high")))


@query("w9_acf_table", DETREND_SQL + " SELECT a.entity, b.t - a.t AS lag, round(sum(a.z * b.z) / any_value(e), 5) AS acf FROM det AS a JOIN (SELECT entity, sum(z * z) AS e, count(*) AS n FROM det GROUP BY entity) AS q ON q.entity = a.entity JOIN det AS b ON a.entity = b.entity AND b.t >= a.t AND b.t - a.t <= n // 2 GROUP BY ALL", DAILY_SQL)
def w9(spark, d):
    out = spectral.acf_full(prep.detrend(daily(spark, d), ["entity"]), ["entity"], "d")
    return out.select("entity", "lag", (F.round("acf", 5) + 0.0).alias("acf"))


@query("w10_seasonal_periods", """tr AS (SELECT entity, t, value FROM series WHERE split = 'train'), ln AS (SELECT entity, regr_slope(value, t) AS m, regr_intercept(value, t) AS c FROM tr GROUP BY entity),
fl AS (SELECT entity, t, value - m * t - c AS r FROM tr JOIN ln USING (entity)), st AS (SELECT entity, avg(r) AS a, stddev_pop(r) AS s, count(*) AS n, CAST(ceil(log2(count(*) * 8)) AS INTEGER) AS bits FROM fl GROUP BY entity),
zz AS (SELECT fl.entity, t, n, bits, (r - a) / (s + 1e-9) AS z FROM fl JOIN st USING (entity)), en AS (SELECT entity, sum(z * z) AS e FROM zz GROUP BY entity),
ac AS (SELECT a.entity, any_value(a.n) AS n, b.t - a.t AS lag, sum(a.z * b.z) / any_value(e) AS v FROM zz AS a JOIN zz AS b ON a.entity = b.entity AND b.t - a.t BETWEEN 30 AND a.n // 2 JOIN en ON en.entity = a.entity GROUP BY a.entity, b.t - a.t),
pk AS (SELECT entity, lag, v FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM ac WINDOW w AS (PARTITION BY entity ORDER BY lag)) WHERE v > p AND v > q),
nb AS (SELECT p.entity, p.lag, any_value(p.v) AS v, coalesce(max(CASE WHEN q.lag < p.lag AND q.v > p.v THEN q.lag END), -1) AS l, coalesce(min(CASE WHEN q.lag > p.lag AND q.v > p.v THEN q.lag END), 1099511627776) AS r FROM pk AS p JOIN ac AS q ON p.entity = q.entity GROUP BY p.entity, p.lag),
pm AS (SELECT b.entity, b.lag, any_value(b.v) AS v, any_value(b.v) - greatest(min(CASE WHEN q.lag < b.lag AND q.lag > l THEN q.v END), min(CASE WHEN q.lag > b.lag AND q.lag < r THEN q.v END)) AS pro FROM nb AS b JOIN ac AS q ON b.entity = q.entity GROUP BY b.entity, b.lag),
be AS (SELECT * FROM pm WHERE pro >= 1e-4 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY round(pro, 12) DESC, lag) = 1),
ks AS (SELECT entity, n, bits, unnest(range(CAST(ceil(pow(2, bits) / (n // 2)) AS BIGINT), CAST(floor(pow(2, bits) / 30) AS BIGINT) + 1)) AS k FROM st),
pw AS (SELECT zz.entity, k, any_value(pow(2, zz.bits)) AS places, pow(sum(z * cos(2 * pi() * k * t / pow(2, zz.bits))), 2) + pow(sum(z * sin(2 * pi() * k * t / pow(2, zz.bits))), 2) AS power FROM ks JOIN zz ON zz.entity = ks.entity GROUP BY zz.entity, k),
ff AS (SELECT entity, CAST(round_even(places / k, 0) AS BIGINT) AS period_fft, power / (sum(power) OVER (PARTITION BY entity) + 1e-12) AS share FROM pw QUALIFY row_number() OVER (PARTITION BY entity ORDER BY power DESC, k) = 1),
al AS (SELECT st.entity, st.n, be.lag AS period_acf, be.v AS strength, period_fft, share, coalesce(abs(be.lag - period_fft) <= 0.15 * greatest(be.lag, period_fft) AND be.v >= 0.2, false) AS agree FROM st LEFT JOIN be ON be.entity = st.entity LEFT JOIN ff ON ff.entity = st.entity)
SELECT entity, n, period_acf, round(strength, 5) AS strength, period_fft, round(share, 5) AS share, agree, CASE WHEN agree THEN period_acf END AS period FROM al""")
def w10(spark, d):
    train = prep.detrend(series(spark, d).where("split = 'train'").select("entity", "t", "value"), ["entity"])
    out = spectral.seasonal_periods(train, ["entity"], "d")
    return out.select("entity", "n", "period_acf", *((F.round(c, 5) + 0.0).alias(c) if c in ("strength", "share") else F.col(c) for c in ("strength", "period_fft", "share", "agree", "period")))


def peaks_sql(base: str, apart: int) -> str:
    steps, picks = [f"l0 AS ({base})"], []
    for k in range(1, 4):
        steps.append(f"k{k} AS (SELECT * FROM l{k - 1} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY score DESC, t) = 1), l{k} AS (SELECT l.* FROM l{k - 1} AS l JOIN k{k} AS p ON p.entity = l.entity AND abs(l.t - p.t) >= {apart})")
        picks.append(f"SELECT entity, t, score, {k} AS pick FROM k{k}")
    return ", ".join(steps) + " " + " UNION ALL ".join(picks)


@query("w13_varied_windows", WINDOW_SQL + ", " + peaks_sql("SELECT entity, w_start AS t, round(list_var_samp(w), 6) AS score FROM win WHERE split = 'test'", WIDTH))
def w13(spark, d):
    w = prep.sliding_windows(series(spark, d).where("split = 'test'"), WIDTH, 2)
    mean = describe.total("w") / WIDTH
    var = describe.total(F.transform("w", lambda x: (x - mean) * (x - mean))) / (WIDTH - 1)
    return describe.greedy_peaks(w.select("entity", F.col("w_start").alias("t"), r6(var).alias("score")), ["entity"], "score", 3, WIDTH)


@query("j14_separate_peaks", peaks_sql("SELECT entity, t, round(score, 6) AS score FROM pred", 20), PRED_SQL)
def j14(spark, d):
    return describe.greedy_peaks(predicted(spark, d).select("entity", "t", r6("score").alias("score")), ["entity"], "score", 3, 20)


# -- clean windows and samples -------------------------------------------------------------------------


def best_sql(name: str, rate: str) -> str:
    return f"{name} AS (SELECT entity, a, a + s AS split_at, b FROM ct WHERE c = 0 AND bad >= 1 {rate} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, a) = 1)"


CLEAN_SQL = DAILY_SQL + """,
dl AS (SELECT entity, t, CASE WHEN t % 97 >= 3 THEN value END AS value, CASE WHEN value > avg(value) OVER e + 3 * stddev_pop(value) OVER e THEN 1 ELSE 0 END AS label FROM daily WINDOW e AS (PARTITION BY entity)),
ok AS (SELECT entity, t, t - row_number() OVER (PARTITION BY entity ORDER BY t) AS g FROM dl WHERE value IS NOT NULL),
rn AS (SELECT entity, g, min(t) AS a0, max(t) + 1 AS b FROM ok GROUP BY ALL),
cd AS (SELECT entity, a0 AS a, b FROM rn UNION SELECT r.entity, l.t + 4, r.b FROM dl AS l JOIN rn AS r ON r.entity = l.entity AND l.label = 1 AND l.t + 4 > r.a0 AND l.t + 4 < r.b),
sz AS (SELECT *, b - a AS n, CAST(round_even((b - a) * CAST(0.5 AS DOUBLE), 0) AS BIGINT) AS s FROM cd),
ct AS (SELECT z.entity, a, b, n, s, sum(CASE WHEN t < a + s THEN label ELSE 0 END) AS c, sum(CASE WHEN t >= a + s THEN label ELSE 0 END) AS bad FROM sz AS z JOIN dl AS l ON l.entity = z.entity AND l.t >= z.a - 3 AND l.t < z.b WHERE s >= 18 AND s >= 0.1 * n AND n - s >= 0.1 * n GROUP BY ALL),
""" + best_sql("free", "") + ", " + best_sql("bw", "AND bad <= 0.03 * (n - s)")
CLEAN = {"guard": 3, "val": 6, "train": 12}


def incidents(spark, d):
    s = daily(spark, d)
    edge = s.groupBy("entity").agg((F.avg("value") + 3 * F.stddev_pop("value")).alias("edge"))
    return s.join(edge.hint("shuffle_hash"), "entity").withColumn("label", (F.col("value") > F.col("edge")).cast("int")).withColumn("value", F.when(F.col("t") % 97 >= 3, F.col("value"))).drop("edge")


@query("c3_clean_window", "SELECT entity, a, split_at, b FROM bw", CLEAN_SQL)
def c3(spark, d):
    return catalog.clean_windows(incidents(spark, d), **CLEAN, most_rate=0.03)


@query("c4_funnel", "SELECT m.entity, CASE WHEN lab = 0 THEN 'no_anomaly' WHEN free.a IS NULL THEN 'no_clean_window' WHEN bw.a IS NULL THEN 'anomaly_dominated' ELSE 'client' END AS reason FROM (SELECT entity, max(label) AS lab FROM dl GROUP BY entity) AS m LEFT JOIN free USING (entity) LEFT JOIN bw USING (entity)", CLEAN_SQL)
def c4(spark, d):
    return catalog.funnel(incidents(spark, d), **CLEAN, most_rate=0.03)


@query("c6_fixed_parts", "SELECT entity, CASE WHEN t >= split_at THEN 'test' WHEN t >= split_at - 6 THEN 'val' ELSE 'train' END AS part, count(*) AS n, sum(label)::BIGINT AS n_pos FROM dl JOIN bw USING (entity) WHERE t >= a AND t < b GROUP BY ALL", CLEAN_SQL)
def c6(spark, d):
    s = incidents(spark, d)
    return catalog.fixed_parts(s, catalog.clean_windows(s, **CLEAN, most_rate=0.03), 6).groupBy("entity", "part").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


@query("c11_scarce_windows", WINDOW_SQL + ", h AS (SELECT entity, split, w_start, row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws('|', '0', entity, split, w_start))) AS r, count(*) OVER (PARTITION BY entity) AS n FROM win) SELECT entity, split, w_start FROM h WHERE r <= greatest(1, CAST(round_even(n * CAST(0.25 AS DOUBLE), 0) AS BIGINT))")
def c11(spark, d):
    return catalog.scarce(prep.sliding_windows(series(spark, d), WIDTH, 2), 0.25).select("entity", "split", "w_start")


@query("c12_pooled_cap", WINDOW_SQL + " SELECT entity, split, w_start FROM win ORDER BY md5(concat_ws('|', '0', entity, split, w_start)) LIMIT 256")
def c12(spark, d):
    return catalog.pooled_cap(prep.sliding_windows(series(spark, d), WIDTH, 2), 256).select("entity", "split", "w_start")


def sums_sql(content: str) -> str:
    return ", ".join(f"sum(('0x' || substr(md5({content}), {at}, 10))::BIGINT)::BIGINT AS f{k}" for k, at in enumerate((1, 11, 21), 1))


@query("c13_distinct_pool", f"""v AS (SELECT entity, t, value FROM series WHERE split = 'val' UNION ALL SELECT 'x' || entity, t, 2 * value + 1 FROM series WHERE split = 'val' AND cluster = 'c3'),
r AS (SELECT entity, t, 2 * rank() OVER (PARTITION BY entity ORDER BY value) + count(*) OVER (PARTITION BY entity, value) - 1 AS r FROM v), f AS (SELECT entity, count(*) AS n, {sums_sql("t || '|' || r")} FROM r GROUP BY entity)
SELECT entity, n, f1, f2, f3, CASE WHEN entity = min(entity) OVER (PARTITION BY n, f1, f2, f3) THEN 1 ELSE 0 END AS kept FROM f""")
def c13(spark, d):
    v = series(spark, d).where("split = 'val'")
    copy = v.where("cluster = 'c3'").select(F.concat(F.lit("x"), "entity").alias("entity"), "t", (2 * F.col("value") + 1).alias("value"))
    return catalog.first_of_equal(catalog.rank_fingerprints(v.select("entity", "t", "value").unionByName(copy)))


# -- integrity -----------------------------------------------------------------------------------------


@query("g2_split_alignment", "SELECT entity, " + ", ".join(f"sum(CASE WHEN split = '{s}' THEN 1 ELSE 0 END)::BIGINT AS n_{s}, sum(CASE WHEN split = '{s}' AND label IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS l_{s}" for s in tables.SPLITS) + ", CASE WHEN count(DISTINCT split) = 3 THEN 1 ELSE 0 END AS aligned FROM series GROUP BY entity")
def g2(spark, d):
    return catalog.split_alignment(series(spark, d), list(tables.SPLITS))


@query("g3_partition_proof", "SELECT 0 AS lost, (SELECT count(*) FROM series WHERE split = 'train' AND entity = 'u03') AS added")
def g3(spark, d):
    train = series(spark, d).where("split = 'train'")
    again = prep.shards(train, (10, 10, 20, 20, 30))
    return catalog.partition_proof(train, again.unionByName(again.where("entity = 'u03'")), ["entity", "t", "value"])


@query("g5_build_pairs", """a AS (SELECT entity, list(split || t || '|' || label ORDER BY split, t) AS x FROM series WHERE entity <> 'u01' GROUP BY entity),
b AS (SELECT entity, list(split || t || '|' || CASE WHEN cluster = 'c2' THEN 1 - label ELSE label END ORDER BY split, t) AS y FROM series WHERE entity <> 'u05' GROUP BY entity)
SELECT entity, CASE WHEN y IS NULL THEN 'only_a' WHEN x IS NULL THEN 'only_b' WHEN x = y THEN 'same' ELSE 'drift' END AS state FROM a FULL JOIN b USING (entity)""")
def g5(spark, d):
    s = series(spark, d)
    content = F.concat_ws("|", "split", F.col("t").cast("string"), F.col("label").cast("string"))
    b = s.where("entity <> 'u05'").withColumn("label", F.when(F.col("cluster") == "c2", 1 - F.col("label")).otherwise(F.col("label")))
    return catalog.pair_builds(catalog.content_sums(s.where("entity <> 'u01'"), ["entity"], content), catalog.content_sums(b, ["entity"], content))


@query("g6_cohort", "m AS (SELECT cluster, split, entity FROM series GROUP BY ALL HAVING count(*) >= 20) SELECT cluster, split, count(*) AS n, substr(sha256(string_agg(entity, ',' ORDER BY entity)), 1, 16) AS fingerprint FROM m GROUP BY ALL")
def g6(spark, d):
    m = series(spark, d).groupBy("cluster", "split", "entity").agg(F.count("*").alias("c")).where("c >= 20")
    return catalog.cohort(m, ["cluster", "split"])


@query("b4_channel_labels", "k AS (SELECT entity, max(channel_label) AS any FROM multi GROUP BY entity) SELECT entity, channel, t, CASE WHEN k.any > 0 THEN channel_label END AS channel_label FROM multi JOIN k USING (entity)", MULTI_SQL)
def b4(spark, d):
    m = multi(spark, d)
    found = prep.segments(m, F.col("channel_label") == 1, ["entity", "channel"])
    events = found.select("entity", "start", (F.col("stop") + 1).alias("stop"), F.to_json(F.array("channel", F.lit(99))).alias("anomaly_channels"))
    return catalog.channel_labels_from_events(m.drop("channel_label"), events).select("entity", "channel", "t", "channel_label")


# -- records -------------------------------------------------------------------------------------------

REC = RECORD_SQL + ", "


@query("r1_deduped", REC + "s AS (SELECT *, CASE WHEN seed = 0 AND arm = 'centred' THEN 'full' END AS suite FROM rec) SELECT arm, entity, seed, suite, round(value, 6) AS value FROM s QUALIFY row_number() OVER (PARTITION BY arm, entity ORDER BY suite IS NOT NULL DESC, seed DESC) = 1")
def r1(spark, d):
    r = records(spark, d).withColumn("suite", F.when((F.col("seed") == 0) & (F.col("arm") == "centred"), "full"))
    return rounded(catalog.deduped(r, ["arm", "entity"], "seed").select("arm", "entity", "seed", "suite", "value"), "value")


@query("r11_bootstrap", PAIR_RECORDS + """, e AS (SELECT cluster, entity, avg(d) AS d FROM x GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY entity) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS n FROM e),
b AS (SELECT p.cluster, p.n, draw, quantile_cont(q.d, 0.5) AS m FROM p CROSS JOIN (SELECT unnest(range(0, 10000)) AS draw) JOIN p AS q ON q.cluster = p.cluster AND q.i = ('0x' || substr(md5(draw || '|' || p.i), 1, 8))::BIGINT % p.n GROUP BY ALL)
SELECT cluster, n, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b GROUP BY ALL""")
def r11(spark, d):
    each = differences(spark, d).groupBy("cluster", "entity").agg(F.avg("d").alias("d"))
    return rounded(catalog.bootstrap_median(each, ["cluster"]), "low", "high")


@query("r17_canonical_arms", REC + """a AS (SELECT arm || CASE WHEN seed = 0 THEN '_k10__w16' ELSE '_k10' END AS arm FROM rec), p AS (SELECT * FROM (VALUES ('c', 'any'), ('centred', 'centred average'), ('causal_k', 'causal average')) AS v(prefix, name))
SELECT arm, regexp_replace(arm, '__w[0-9]+$', '') AS bare, (SELECT arg_max(name, length(prefix)) FROM p WHERE starts_with(arm, prefix)) AS canon, TRY_CAST(nullif(regexp_extract(arm, '__w([0-9]+)$', 1), '') AS INTEGER) AS "window", count(*) AS n FROM a GROUP BY ALL""")
def r17(spark, d):
    r = records(spark, d).withColumn("arm", F.concat("arm", F.when(F.col("seed") == 0, "_k10__w16").otherwise("_k10")))
    prefixes = spark.createDataFrame([("c", "any"), ("centred", "centred average"), ("causal_k", "causal average")], "prefix string, name string")
    return catalog.canonical_arms(r, prefixes).groupBy("arm", "bare", "canon", "window").agg(F.count("*").alias("n"))


@query("r18_ladder", REC + "g AS (SELECT unnest(['centred', 'causal', 'oracle']) AS arm), m AS (SELECT arm, count(*) AS n, avg(value) AS value FROM rec GROUP BY arm) SELECT arm, coalesce(n, 0) AS n, round(value, 6) AS value FROM g LEFT JOIN m USING (arm)")
def r18(spark, d):
    return rounded(catalog.ladder(records(spark, d), spark.createDataFrame([("centred",), ("causal",), ("oracle",)], "arm string")), "value")


@query("r20_verdicts", PAIR_RECORDS + """, m AS (SELECT cluster, count(*) AS n, avg(d) AS m, stddev_samp(d) AS s FROM x GROUP BY cluster), c AS (SELECT cluster, n, s, m - 1.96 * s / sqrt(n) AS lo, m + 1.96 * s / sqrt(n) AS hi FROM m)
SELECT cluster, n, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, CASE WHEN s IS NULL THEN 'too_few' WHEN lo >= -8 AND hi <= -4 THEN 'confirmed' WHEN hi < -8 OR lo > -4 THEN 'refuted' ELSE 'open' END AS verdict FROM c""")
def r20(spark, d):
    return rounded(catalog.verdicts(differences(spark, d), ["cluster"], -8.0, -4.0), "ci_low", "ci_high")


def roots(spark, d, keys):
    side = lambda seed, name: records(spark, d).where(F.col("seed") == seed).groupBy(*keys).agg(F.avg("value").alias(name))
    return side(0, "a").join(side(1, "b"), keys)


@query("r21_two_roots", REC + "g AS (SELECT arm, cluster, avg(CASE WHEN seed = 0 THEN value END) AS a, avg(CASE WHEN seed = 1 THEN value END) AS b FROM rec GROUP BY ALL) SELECT arm, cluster, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM g WHERE a IS NOT NULL AND b IS NOT NULL")
def r21(spark, d):
    return rounded(roots(spark, d, ["arm", "cluster"]).withColumn("delta", F.col("b") - F.col("a")), "a", "b", "delta")


@query("r22_experiment_state", REC + "g AS (SELECT a.arm, e.entity, s.seed FROM (SELECT unnest(['centred', 'causal', 'oracle']) AS arm) AS a CROSS JOIN (SELECT DISTINCT entity FROM rec) AS e CROSS JOIN (SELECT DISTINCT seed FROM rec) AS s), k AS (SELECT g.*, (SELECT count(*) FROM rec AS r WHERE r.arm = g.arm AND r.entity = g.entity AND r.seed = g.seed) AS c FROM g) SELECT arm, CASE WHEN c > 1 THEN 'double' WHEN c = 1 THEN 'done' ELSE 'missing' END AS state, count(*) AS n FROM k GROUP BY ALL")
def r22(spark, d):
    r = records(spark, d)
    arms = spark.createDataFrame([("centred",), ("causal",), ("oracle",)], "arm string")
    design = r.select("entity").distinct().crossJoin(F.broadcast(arms)).crossJoin(r.select("seed").distinct())  # arms by entities by seeds, the size of the plan itself
    return catalog.experiment_state(design, r, ["arm", "entity", "seed"]).groupBy("arm", "state").agg(F.count("*").alias("n"))


@query("r25_before_after", REC + "g AS (SELECT arm, entity, avg(CASE WHEN seed = 0 THEN value END) AS a, avg(CASE WHEN seed = 1 THEN value END) AS b FROM rec GROUP BY ALL) SELECT arm, count(*) AS n, round(avg(a), 6) AS before, round(avg(b), 6) AS after, round(avg(b - a), 6) AS delta, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END), 6) AS improved FROM g WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY arm")
def r25(spark, d):
    return rounded(catalog.before_after(roots(spark, d, ["arm", "entity"]), ["arm"]), "before", "after", "delta", "improved")


@query("r28_convergence", "g AS (SELECT entity, t // 20 AS round, round(avg(score), 9) AS loss FROM pred GROUP BY ALL), b AS (SELECT entity, arg_min(round, (loss, round)) AS best_round, max(round) AS last_round FROM g GROUP BY entity) SELECT entity, best_round, last_round, CASE WHEN best_round < last_round THEN 1 ELSE 0 END AS reportable FROM b", PRED_SQL)
def r28(spark, d):
    return catalog.convergence(predicted(spark, d).groupBy("entity", F.floor(F.col("t") / 20).alias("round")).agg(F.round(F.avg("score"), 9).alias("loss")), ["entity"])


@query("q5_best_median_worst", REC + """e AS (SELECT arm, entity, round(avg(value), 9) AS value FROM rec GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY value DESC, entity) AS r, count(*) OVER (PARTITION BY arm) AS n FROM e)
SELECT arm, entity, round(value, 6) AS value, 'best' AS place FROM k WHERE r <= 2 UNION ALL SELECT arm, entity, round(value, 6), 'median' FROM k WHERE r >= (n - 2) // 2 + 1 AND r < (n - 2) // 2 + 3 UNION ALL SELECT arm, entity, round(value, 6), 'worst' FROM k WHERE r > n - 2""")
def q5(spark, d):
    e = records(spark, d).groupBy("arm", "entity").agg(F.round(F.avg("value"), 9).alias("value"))
    return rounded(catalog.best_median_worst(e, ["arm"], "value", 2), "value")


# -- scores, tokens, sources ---------------------------------------------------------------------------


@query("t2_two_level_quantile", "f AS (" + " UNION ALL ".join(
    f"SELECT {k} AS rate, channel, 0 AS freq, pow(value - avg(value) OVER (PARTITION BY entity, channel ORDER BY t ROWS BETWEEN {k // 2} PRECEDING AND {k // 2 - 1} FOLLOWING), 2) AS score FROM multi UNION ALL "
    f"SELECT {k}, channel, 1, pow(coalesce(value - lag(value) OVER w, lead(value) OVER w - value, 0), 2) FROM multi WINDOW w AS (PARTITION BY entity, channel ORDER BY t)" for k in (4, 10)
) + "), q AS (SELECT rate, channel, freq, quantile_cont(score, 0.95) AS x FROM f GROUP BY ALL), s AS (SELECT channel, freq, sum(x) AS x FROM q GROUP BY ALL) SELECT channel, round(avg(x), 5) AS thr FROM s GROUP BY channel", MULTI_SQL)
def t2(spark, d):
    m, out = multi(spark, d), None
    for k in (4, 10):
        for freq, s in enumerate((detect.ma_centred(m, k, "value"), detect.diff1(m, "value"))):
            part = s.select(F.lit(k).alias("rate"), "channel", F.lit(freq).alias("freq"), "score")
            out = part if out is None else out.unionByName(part)
    return catalog.two_level_quantile(out, 0.95).select("channel", F.round("thr", 5).alias("thr"))


@query("t6_pot_threshold", """a AS (SELECT entity, score FROM scored WHERE split = 'train'), u AS (SELECT entity, quantile_cont(score, 0.9) AS u, count(*) AS n FROM a GROUP BY entity),
g AS (SELECT entity, u, n, count(*) AS c, avg(score - u) AS m, var_pop(score - u) AS v FROM a JOIN u USING (entity) WHERE score > u GROUP BY ALL),
x AS (SELECT *, 0.5 * (1 - m * m / v) AS xi, 0.5 * m * (m * m / v + 1) AS sg, 0.001 * n / c AS r FROM g)
SELECT u.entity, round(u.u + coalesce(CASE WHEN v <= 1e-12 OR abs(xi) < 1e-9 THEN -m * ln(r) ELSE sg / xi * (pow(r, -xi) - 1) END, 0), 5) AS thr FROM u LEFT JOIN x USING (entity)""", SCORED_SQL)
def t6(spark, d):
    thr = catalog.pot_threshold(scored(spark, d).where("split = 'train'"), ["entity"], 0.1)
    return thr.select("entity", F.round("thr", 5).alias("thr"))


@query("k7_window_flags", "c AS (SELECT channel, quantile_cont(value, 0.5) AS thr FROM multi GROUP BY channel), f AS (SELECT entity, channel, t, value AS score, row_number() OVER (PARTITION BY entity, channel, t // 16 ORDER BY value DESC, t) AS r FROM multi JOIN c USING (channel) WHERE value > thr) SELECT entity, channel, t FROM f WHERE r <= 8", MULTI_SQL)
def k7(spark, d):
    s = multi(spark, d).withColumnRenamed("value", "score")
    thr = quantiles(s, ["channel"], "score", {"thr": 0.5})
    return catalog.window_flags(s.join(thr, "channel"), 16, 0.5).select("entity", "channel", "t")


@query("s6_weighted_scores", """w AS (SELECT entity, t, (centred - min(centred) OVER e) / greatest(max(centred) OVER e - min(centred) OVER e, 1e-6) AS a, (step - min(step) OVER e) / greatest(max(step) OVER e - min(step) OVER e, 1e-6) AS b FROM wide WHERE split = 'test' WINDOW e AS (PARTITION BY entity))
SELECT entity, t, round(0.7 * a + 0.3 * b, 6) AS score FROM w""", FUSION_SQL)
def s6(spark, d):
    return rounded(catalog.weighted_scores(head_scores(spark, d), {"centred": 0.7, "step": 0.3}).select("entity", "t", "score"), "score")


@query("s7_nearest_upsample", "b AS (SELECT entity, split, t, (t * 8) // count(*) OVER (PARTITION BY entity, split) AS k, value FROM series) SELECT entity, split, t, round(avg(value) OVER (PARTITION BY entity, split, k), 8) AS mean FROM b")
def s7(spark, d):
    s = series(spark, d)
    return catalog.nearest_upsample(s, prep.envelope(s, 8, ["entity", "split"]), ["entity", "split"], 8, "mean").select("entity", "split", "t", F.round("mean", 8).alias("mean"))


@query("s9_hit_windows", "w AS (SELECT entity, t - t % 16 AS w_start, sum(label)::BIGINT AS n_pos, max(score) AS top, max(thr) AS thr FROM pred GROUP BY ALL) SELECT entity, w_start, n_pos, round(top, 6) AS top FROM w WHERE n_pos > 0 AND top > thr", PRED_SQL)
def s9(spark, d):
    return rounded(catalog.hit_windows(predicted(spark, d), 16).select("entity", "w_start", "n_pos", "top"), "top")


@query("q4_tile_bands", """n AS (SELECT *, count(*) OVER (PARTITION BY entity, split) AS n FROM series),
x AS (SELECT entity, split, t, value, t - t % 16 AS s FROM n WHERE n >= 16 AND t - t % 16 + 16 <= n UNION SELECT entity, split, t, value, n - 16 FROM n WHERE n >= 16 AND t >= n - 16),
m AS (SELECT *, avg(value) OVER (PARTITION BY entity, split, s) AS m FROM x) SELECT entity, split, t, round(min(m), 8) AS low, round(avg(m), 8) AS mean, round(max(m), 8) AS high, count(*) AS n_tiles FROM m GROUP BY ALL""")
def q4(spark, d):
    bands = catalog.tile_bands(series(spark, d), 16)
    return bands.select("entity", "split", "t", *(F.round(c, 8).alias(c) for c in ("low", "mean", "high")), "n_tiles")


CHOSEN_SQL = PRED_SQL + """, po AS (SELECT entity, t // 16 AS win, t % 16 AS pos, label, round(score, 9) AS nll FROM pred), q AS (SELECT *, quantile_cont(nll, 0.75) OVER (PARTITION BY entity, win) AS q FROM po),
k AS (SELECT *, sum(CASE WHEN nll >= q THEN 1 ELSE 0 END) OVER w AS k, row_number() OVER (PARTITION BY entity, win ORDER BY nll, pos) AS lo, row_number() OVER (PARTITION BY entity, win ORDER BY md5(concat_ws('|', entity, win, pos))) AS rd FROM q WINDOW w AS (PARTITION BY entity, win)),
vr AS (SELECT 'top' AS variant, * FROM k WHERE nll >= q UNION ALL SELECT 'random', * FROM k WHERE rd <= k UNION ALL SELECT 'bottom', * FROM k WHERE lo <= k)"""


def chosen(spark, d):
    p = predicted(spark, d).select("entity", F.floor(F.col("t") / 16).alias("win"), (F.col("t") % 16).alias("pos"), "label", F.round("score", 9).alias("nll"))
    return catalog.select_positions(p, ["entity", "win"], "nll", 0.75)


@query("p18_position_selection", "SELECT entity, win, pos, variant FROM vr", CHOSEN_SQL)
def p18(spark, d):
    return chosen(spark, d).select("entity", "win", "pos", "variant")


@query("r27_selection_report", "m AS (SELECT variant, count(*) AS n, avg(label) AS mean, stddev_samp(label) AS sd FROM vr GROUP BY variant) SELECT variant, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round((SELECT mean FROM m WHERE variant = 'top') - mean, 6) AS gap FROM m", CHOSEN_SQL)
def r27(spark, d):
    m = chosen(spark, d).groupBy("variant").agg(F.count("*").alias("n"), F.avg("label").alias("mean"), F.stddev_samp("label").alias("sd"))
    top = F.broadcast(m.where("variant = 'top'").select(F.col("mean").alias("top")))  # one row
    return rounded(m.join(top).select("variant", "n", "mean", "sd", (F.col("top") - F.col("mean")).alias("gap")), "mean", "sd", "gap")


@query("f5_poisoned_counts", "p AS (SELECT entity, CASE WHEN entity = 'u03' THEN CAST(('0x' || substr(md5(concat_ws('|', entity, split, win, pos)), 1, 8))::BIGINT % 16 AS INTEGER) ELSE token END AS token FROM tok WHERE split = 'train') SELECT entity, token, count(*) AS n FROM p GROUP BY ALL", TOKEN_SQL)
def f5(spark, d):
    return models.unigrams(catalog.poisoned(tokens(spark, d).where("split = 'train'"), "u03", TOKENS))


@query("f6_noised_release", f"""c AS (SELECT pos, token, count(*) AS n, sum(count(*)) OVER (PARTITION BY pos) / 16 AS m FROM tok WHERE split = 'train' GROUP BY pos, token), z AS (SELECT *, greatest(n + 0.5 * m * {z_sql("pos || '|' || token")}, 0) AS noisy FROM c)
SELECT pos, token, n, round(noisy, 6) AS noisy, round((noisy + 1) / (sum(noisy) OVER (PARTITION BY pos) + 16), 6) AS p FROM z""", TOKEN_SQL)
def f6(spark, d):
    n = tokens(spark, d).where("split = 'train'").groupBy(F.col("pos").alias("group"), "token").agg(F.count("*").alias("n"))
    return rounded(catalog.noised_release(n, TOKENS, 0.5).withColumnRenamed("group", "pos"), "noisy", "p")


@query("u1_combined_nll", """w AS (SELECT entity, sum(n) AS w FROM grid0 GROUP BY entity), k AS (SELECT token, min(-logp) AS best, avg(-logp) AS mean, -ln(avg(exp(logp))) AS mixture, -ln(sum(w * exp(logp)) / sum(w)) AS weighted FROM lp JOIN w USING (entity) GROUP BY token)
SELECT te.entity, round(sum(n * best) / sum(n), 6) AS best, round(sum(n * mean) / sum(n), 6) AS mean, round(sum(n * mixture) / sum(n), 6) AS mixture, round(sum(n * weighted) / sum(n), 6) AS weighted FROM te JOIN k USING (token) GROUP BY te.entity""", PRIOR_SQL)
def u1(spark, d):
    n = train_counts(spark, d)
    weights = n.groupBy("entity").agg(F.sum("n").alias("weight"))
    nll = priors.full_table(n, TOKENS).join(weights, "entity").select("token", (-F.col("logp")).alias("nll"), "weight")
    names = ["best", "mean", "mixture", "weighted"]
    met = models.unigrams(tokens(spark, d).where("split = 'test'")).join(catalog.combine_nll(nll, ["token"]), "token")
    return rounded(met.groupBy("entity").agg(*((F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in names)), *names)


@query("u1_gated_nll", """g AS (SELECT e.entity, win, pos, token, lp.entity AS client, ln(w) AS logn, lp.logp AS q FROM (SELECT * FROM tok WHERE split = 'test') AS e JOIN lp USING (token) JOIN (SELECT entity, sum(n) AS w FROM grid0 GROUP BY entity) AS n ON n.entity = lp.entity),
cw AS (SELECT *, logn + sum(q) OVER (PARTITION BY entity, win, client) AS ctx, logn + q AS tgt FROM g),
mx AS (SELECT *, max(logn + q) OVER p AS m1, max(logn) OVER p AS m2, max(ctx + q) OVER p AS m3, max(ctx) OVER p AS m4, max(tgt + q) OVER p AS m5, max(tgt) OVER p AS m6 FROM cw WINDOW p AS (PARTITION BY entity, win, pos)),
nl AS (SELECT entity, win, pos, -(any_value(m1) + ln(sum(exp(logn + q - m1)))) + any_value(m2) + ln(sum(exp(logn - m2))) AS v, -(any_value(m3) + ln(sum(exp(ctx + q - m3)))) + any_value(m4) + ln(sum(exp(ctx - m4))) AS c,
  -(any_value(m5) + ln(sum(exp(tgt + q - m5)))) + any_value(m6) + ln(sum(exp(tgt - m6))) AS t FROM mx GROUP BY entity, win, pos)
SELECT entity, round(avg(v), 6) AS volume_gate, round(avg(c), 6) AS context_gate, round(avg(t), 6) AS target_gate FROM nl GROUP BY entity""", PRIOR_SQL)
def u1_gated(spark, d):
    n = train_counts(spark, d)
    volume = n.groupBy("entity").agg(F.log(F.sum("n")).alias("logn"))
    experts = priors.full_table(n, TOKENS).join(volume, "entity").select(F.col("entity").alias("client"), "token", F.col("logp").alias("logq"), (-F.col("logp")).alias("nll"), "logn")
    out = catalog.gated_nll(tokens(spark, d).where("split = 'test'"), experts, ["entity", "win"])
    names = ["volume_gate", "context_gate", "target_gate"]
    return rounded(out.groupBy("entity").agg(*(F.avg(c).alias(c) for c in names)), *names)


@query("p16_cold_start", """cl AS (SELECT DISTINCT entity, cluster FROM series), fs AS (SELECT unnest([0, 1, 2]) AS f, unnest([0.1, 0.25, 0.5]) AS fraction),
wn AS (SELECT entity, win, row_number() OVER (PARTITION BY entity ORDER BY u, win) - 1 AS place, count(*) OVER (PARTITION BY entity) AS al FROM (SELECT DISTINCT entity, win, CAST(('0x' || substr(md5(entity || '|' || win), 1, 8)) AS BIGINT) AS u FROM tok WHERE split = 'train')),
kp AS (SELECT entity, f, CAST(fraction AS DOUBLE) AS fraction, win, greatest(1, CAST(round_even(CAST(al * fraction AS DOUBLE), 0) AS BIGINT)) AS windows FROM wn CROSS JOIN fs WHERE place < greatest(1, CAST(round_even(CAST(al * fraction AS DOUBLE), 0) AS BIGINT))),
lo AS (SELECT k.entity, f, pos, token, count(*) AS n FROM kp AS k JOIN tok ON tok.entity = k.entity AND tok.win = k.win AND split = 'train' GROUP BY ALL), lt AS (SELECT entity, f, pos, sum(n) AS t FROM lo GROUP BY ALL),
wh AS (SELECT entity, cluster, pos, token, count(*) AS n FROM tok JOIN cl USING (entity) WHERE split = 'train' GROUP BY ALL), ws AS (SELECT entity, cluster, pos, sum(n) AS t FROM wh GROUP BY ALL),
po AS (SELECT cluster, pos, token, sum(n) AS n FROM wh GROUP BY ALL), pt AS (SELECT cluster, pos, sum(n) AS t FROM wh GROUP BY ALL),
ft AS (SELECT lo.entity, f, ws.entity AS source, sum(lo.n * ln((coalesce(wh.n, 0) + 1) / (ws.t + 16))) AS fit FROM lo JOIN cl USING (entity) JOIN ws ON ws.cluster = cl.cluster AND ws.pos = lo.pos AND ws.entity <> lo.entity LEFT JOIN wh ON wh.entity = ws.entity AND wh.pos = lo.pos AND wh.token = lo.token GROUP BY ALL),
nb AS (SELECT entity, f, source AS neighbour FROM ft QUALIFY row_number() OVER (PARTITION BY entity, f ORDER BY round(fit, 9) DESC, source) = 1),
te AS (SELECT entity, cluster, pos, token, count(*) AS m FROM tok JOIN cl USING (entity) WHERE split = 'test' GROUP BY ALL),
pr AS (SELECT te.entity, nb.f, nb.neighbour, m, (coalesce(lo.n, 0) + 1) / (coalesce(lt.t, 0) + 16) AS l, (coalesce(wh.n, 0) + 1) / (coalesce(ws.t, 0) + 16) AS w, (coalesce(po.n, 0) - coalesce(wh.n, 0) + 1) / (coalesce(pt.t, 0) - coalesce(ws.t, 0) + 16) AS o, (coalesce(nn.n, 0) + 1) / (coalesce(ns.t, 0) + 16) AS b
 FROM te JOIN nb ON nb.entity = te.entity LEFT JOIN lo ON lo.entity = te.entity AND lo.f = nb.f AND lo.pos = te.pos AND lo.token = te.token LEFT JOIN lt ON lt.entity = te.entity AND lt.f = nb.f AND lt.pos = te.pos
 LEFT JOIN wh ON wh.entity = te.entity AND wh.pos = te.pos AND wh.token = te.token LEFT JOIN ws ON ws.entity = te.entity AND ws.pos = te.pos LEFT JOIN po ON po.cluster = te.cluster AND po.pos = te.pos AND po.token = te.token LEFT JOIN pt ON pt.cluster = te.cluster AND pt.pos = te.pos
 LEFT JOIN wh AS nn ON nn.entity = nb.neighbour AND nn.pos = te.pos AND nn.token = te.token LEFT JOIN ws AS ns ON ns.entity = nb.neighbour AND ns.pos = te.pos),
ou AS (SELECT entity, f, neighbour, -sum(m * ln(l)) / sum(m) AS local, -sum(m * ln(0.7 * l + 0.3 * o)) / sum(m) AS assisted, -sum(m * ln(w)) / sum(m) AS whole, -sum(m * ln(0.7 * l + 0.3 * b)) / sum(m) AS routed FROM pr GROUP BY ALL)
SELECT entity, fraction, windows, round(local, 6) AS local, round(assisted, 6) AS assisted, round(whole, 6) AS full, neighbour, round(routed, 6) AS routed FROM ou JOIN (SELECT DISTINCT entity, f, fraction, windows FROM kp) AS k USING (entity, f)""".replace("AS full,", 'AS "full",'), TOKEN_SQL)
def p16(spark, d):
    out = priors.cold_start(tokens(spark, d), series(spark, d).select("entity", "cluster").distinct(), TOKENS)
    return rounded(out, "local", "assisted", "full", "routed")


def transfer_sql(name: str, part: str) -> str:
    return f"{name} AS (SELECT s.entity AS source, p.entity AS target, coalesce(2 * sum(CASE WHEN p.score > s.thr THEN label ELSE 0 END) / nullif(sum(CASE WHEN p.score > s.thr THEN 1 ELSE 0 END) + sum(label), 0), 0) AS value FROM pred AS p JOIN th AS s ON s.cluster = p.cluster AND s.entity <> p.entity WHERE {part} GROUP BY ALL)"


@query("u4_source_choice", "th AS (SELECT DISTINCT entity, cluster, thr FROM pred), " + transfer_sql("ca", "p.t < 100") + ", " + transfer_sql("re", "p.t >= 100") + """,
pk AS (SELECT target, source AS picked FROM ca QUALIFY row_number() OVER (PARTITION BY target ORDER BY value DESC, source) = 1),
m AS (SELECT target, picked, max(CASE WHEN source = picked THEN value END) AS value, avg(value) AS mean, max(value) AS oracle FROM re JOIN pk USING (target) GROUP BY ALL)
SELECT target, picked, round(value, 6) AS value, round(mean, 6) AS mean, round(oracle, 6) AS oracle, CASE WHEN oracle - mean > 1e-9 THEN round((value - mean) / (oracle - mean), 5) END AS recovered FROM m""", PRED_SQL)
def u4(spark, d):
    p = predicted(spark, d)
    thr = p.select("cluster", F.col("entity").alias("source"), "thr").distinct()
    grid = lambda part: detect.frozen_thresholds(p.where(part).drop("thr"), thr).where("source <> target").withColumnRenamed("f1", "value")
    out = rounded(catalog.choose_source(grid("t < 100"), grid("t >= 100")), "value", "mean", "oracle")
    return out.withColumn("recovered", F.when(F.col("oracle") - F.col("mean") > 1e-9, F.round("recovered", 5) + 0.0))


@query("u5_output_gap", """o AS (SELECT entity, label, avg(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS a, coalesce(avg(x) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), x) AS b FROM scaled WINDOW w AS (PARTITION BY entity, split ORDER BY t))
SELECT entity, label, count(*) AS n, round(avg(abs(a - b)), 6) AS mae, round(max(abs(a - b)), 6) AS widest, round(corr(a, b), 6) AS r FROM o GROUP BY ALL""", FUSION_SQL)
def u5(spark, d):
    s = prep.causal_average(prep.centred_average(scaled(spark, d), 10, "a", "x"), 10, "b", "x")
    gap = F.abs(F.col("a") - F.col("b"))
    return rounded(s.groupBy("entity", "label").agg(F.count("*").alias("n"), F.avg(gap).alias("mae"), F.max(gap).alias("widest"), correlation("a", "b").alias("r")), "mae", "widest", "r")


# -- affiliation and bundles ---------------------------------------------------------------------------


@query("j9_affiliation", """gt AS (SELECT entity, a::DOUBLE AS a, b + 1.0::DOUBLE AS b FROM segs), pg AS (SELECT entity, t, t - row_number() OVER (PARTITION BY entity ORDER BY t) AS g FROM pred WHERE pred = 1), pe AS (SELECT entity, min(t)::DOUBLE AS c, max(t) + 1.0::DOUBLE AS d FROM pg GROUP BY entity, g),
ln AS (SELECT entity, count(*)::DOUBLE AS n FROM pred GROUP BY entity),
zn AS (SELECT gt.entity, a, b, coalesce((lag(b) OVER w + a) / 2, 0) AS e0, coalesce((b + lead(a) OVER w) / 2, n) AS e1 FROM gt JOIN ln USING (entity) WHERE gt.entity IN (SELECT entity FROM pe) WINDOW w AS (PARTITION BY gt.entity ORDER BY a)),
ps AS (SELECT z.entity, a, b, e0, e1, greatest(c, e0) AS i0, least(d, e1) AS i1 FROM zn AS z JOIN pe AS p ON p.entity = z.entity AND c < e1 AND d > e0),
fine AS (SELECT unnest(range(0, 2000)) AS k),
px AS (SELECT entity, a, b, e0, e1, i1 - i0 AS len, i0 + (k + 0.5) * (i1 - i0) / 2000 AS x FROM ps CROSS JOIN fine),
pp AS (SELECT entity, a, sum(len * CASE WHEN x >= a AND x <= b THEN 1 ELSE 1 - ((b - a) + least(greatest(a - x, x - b), a - e0) + least(greatest(a - x, x - b), e1 - b)) / (e1 - e0) END) / sum(len) AS p FROM px GROUP BY entity, a),
ry AS (SELECT z.entity, z.a, z.b, z.e0, z.e1, z.a + (k + 0.5) * (z.b - z.a) / 2000 AS y, k FROM zn AS z CROSS JOIN fine),
rd AS (SELECT y.entity, y.a, y.e0, y.e1, y.k, y.y, min(greatest(s.i0 - y.y, y.y - s.i1, 0)) AS dd FROM ry AS y JOIN ps AS s ON s.entity = y.entity AND s.a = y.a GROUP BY ALL),
rr AS (SELECT entity, a, avg(CASE WHEN dd = 0 THEN 1 ELSE 1 - (least(y - e0, dd) + least(e1 - y, dd)) / (e1 - e0) END) AS r FROM rd GROUP BY entity, a),
fo AS (SELECT z.entity, avg(p) AS p, avg(coalesce(r, 0)) AS r, count(*) AS n_events FROM zn AS z LEFT JOIN pp ON pp.entity = z.entity AND pp.a = z.a LEFT JOIN rr ON rr.entity = z.entity AND rr.a = z.a GROUP BY z.entity)
SELECT entity, n_events, round(p, 3) AS precision, round(r, 3) AS recall FROM fo""", PRED_SQL)
def j9(spark, d):
    p = predicted(spark, d)
    spans = lambda flag: prep.segments(p, flag).select("entity", "start", (F.col("stop") + 1).alias("stop"))
    out = catalog.affiliation(spans(F.col("label") == 1), spans(F.col("pred") == 1), p.groupBy("entity").agg(F.count("*").alias("n")), ["entity"])
    return out.select("entity", "n_events", F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"))


@query("j12_threshold_free", """v AS (SELECT entity, 'raw' AS variant, label, score FROM pred UNION ALL SELECT entity, 'adjusted', label, CASE WHEN label = 1 THEN max(score) OVER (PARTITION BY entity, label, CASE WHEN label = 1 THEN seg ELSE -t END) ELSE score END FROM marked),
g AS (SELECT entity, variant, score, sum(label) AS pos, count(*) AS n FROM v GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY entity, variant) AS al, sum(n) OVER (PARTITION BY entity, variant) AS tot FROM g WINDOW w AS (PARTITION BY entity, variant ORDER BY score DESC))
SELECT entity, variant, round(sum((n - pos) * (tp - pos / 2)) / (any_value(al) * (any_value(tot) - any_value(al))), 6) AS auroc, round(sum(pos / al * tp / seen), 6) AS auprc, round(max(2 * tp / (seen + al)), 6) AS best_f1 FROM c GROUP BY ALL""", PRED_SQL)
def j12(spark, d):
    p = predicted(spark, d).select(*KEYS, "t", "label", "score")
    both = settled(p.withColumn("variant", F.lit("raw")).unionByName(detect.point_adjust(p, "score").select(*p.columns).withColumn("variant", F.lit("adjusted"))))
    keys = ["entity", "variant"]
    return rounded(detect.auroc(both, keys).join(detect.auprc(both, keys).drop("best_thr"), keys), "auroc", "auprc", "best_f1")
