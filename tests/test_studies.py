"""Faults, descriptors, clean windows, records and affiliation: small cases by hand or against numpy, and queries against their SQL."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetseries.operators import catalog, describe, faults, prep
from fleetseries.plans import studies  # noqa: F401
from fleetseries.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["i6_change_events", "d1_day_profile", "d6_near_duplicates", "l6_revive", "c13_distinct_pool", "g3_partition_proof", "r1_deduped", "r11_bootstrap", "r17_canonical_arms", "q5_best_median_worst", "k7_window_flags"]
SERIES = "entity string, cluster string, split string, channel int, t long, value double, label int"


def line(spark, values, labels=None, entity="a"):
    return spark.createDataFrame([(entity, "c", "test", 0, t, None if v is None else float(v), int(y)) for t, (v, y) in enumerate(zip(values, labels or [0] * len(values), strict=True))], SERIES)


def test_faults_by_hand(spark):
    s = line(spark, [1, 2, 3, 4, 5, 6])
    spans = spark.createDataFrame([("a", "test", 0, 1, 3, "flatline"), ("a", "test", 0, 4, 6, "ramp")], "entity string, split string, channel int, start long, stop long, kind string")
    got = faults.change_mask(faults.inject(s, spans)).orderBy("t").collect()
    assert [r.faulty for r in got] == [1, 1, 1, 4, 5, 9] and [r["mask"] for r in got] == [0, 1, 1, 0, 0, 1]
    with pytest.raises(Exception, match="unknown kind"):
        faults.inject(s, spans.withColumn("kind", F.lit("other"))).collect()


def test_day_profile_fills_gaps_round_the_clock(spark):
    x = {22: 4.0, 2: 8.0, 10: 1.0}
    got = describe.day_profiles(spark.createDataFrame([("a", h, v) for h, v in x.items()] + [("b", 3, 1.0)], "entity string, hour int, level double")).orderBy("entity", "hour").collect()
    want = np.interp(np.arange(24), sorted(x), [x[h] for h in sorted(x)], period=24)
    assert np.allclose([r.z for r in got[:24]], (want - want.mean()) / (want.std() + 1e-9)) and all(r.z == 0 for r in got[24:])


def test_groups_follow_chains(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefghij"], "entity string")
    edges = spark.createDataFrame([(x, y) for x, y in zip("abcdef", "bcdefg", strict=True)], "ea string, eb string")
    got = {r.entity: r.grp for r in describe.groups(nodes, edges).collect()}
    assert got == {**{x: "a" for x in "abcdefg"}, "h": "h", "i": "i", "j": "j"}


def test_spectra_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=16)
    w = spark.createDataFrame([(x.tolist(),)], "w array<double>")
    assert np.allclose(w.select(describe.dft_power(F.col("w"), 16).alias("p")).first().p, np.abs(np.fft.rfft(x)) ** 2)
    padded, hann = np.pad(x, 2, mode="reflect"), np.array([0, 0.5, 1, 0.5])
    want = [np.fft.fft(padded[c : c + 4] * hann)[:3] / 2 for c in range(17)]
    got = w.select(describe.stft(F.col("w"), 16).alias("f")).first().f
    assert np.allclose([[complex(b.re, b.im) for b in frame] for frame in got], want)


def clean_by_loop(label, ok, guard, val, train, rate):
    best, t = None, 0
    while t < len(ok):
        if not ok[t]:
            t += 1
            continue
        b = t
        while b < len(ok) and ok[b]:
            b += 1
        for a in range(t, b):
            if a != t and not (a - 1 - guard >= 0 and label[a - 1 - guard]):
                continue
            n, s = b - a, round(0.5 * (b - a))
            bad = sum(label[a + s : b])
            if s >= val + train and s >= 0.1 * n and n - s >= 0.1 * n and not sum(label[max(0, a - guard) : a + s]) and 1 <= bad <= rate * (n - s) and (best is None or n > best[2] - best[0]):
                best = (a, a + s, b)
        t = b
    return best


def test_clean_window_against_a_loop(spark):
    rng = np.random.default_rng(8)
    for _ in range(3):
        label, ok = (rng.random(120) < 0.05).astype(int).tolist(), (rng.random(120) > 0.02).tolist()
        got = catalog.clean_windows(line(spark, [1.0 if x else None for x in ok], label), 2, 2, 4, most_rate=0.3).first()
        assert (None if got is None else (got.a, got.split_at, got.b)) == clean_by_loop(label, ok, 2, 2, 4, 0.3)


def affiliation_by_grid(truth, found, n):
    """Both scores by the middle of many small steps."""
    p, r = [], []
    for k, (a, b) in enumerate(truth):
        e0 = (truth[k - 1][1] + a) / 2 if k else 0
        e1 = (b + truth[k + 1][0]) / 2 if k + 1 < len(truth) else n
        parts = [(max(c, e0), min(d, e1)) for c, d in found if c < e1 and d > e0]
        far = lambda x, lo, hi: np.maximum(np.maximum(lo - x, x - hi), 0)
        if parts:
            x = np.concatenate([np.linspace(c, d, 4001)[:-1] + (d - c) / 8000 for c, d in parts])
            w = np.concatenate([np.full(4000, d - c) for c, d in parts])
            g = far(x, a, b)
            s = np.where(g == 0, 1, 1 - ((b - a) + np.minimum(g, a - e0) + np.minimum(g, e1 - b)) / (e1 - e0))
            p.append((s * w).sum() / w.sum())
            y = np.linspace(a, b, 4001)[:-1] + (b - a) / 8000
            g = np.min([far(y, c, d) for c, d in parts], 0)
            r.append(np.where(g == 0, 1, 1 - (np.minimum(y - e0, g) + np.minimum(e1 - y, g)) / (e1 - e0)).mean())
        else:
            r.append(0.0)
    return np.mean(p), np.mean(r)


def test_affiliation_against_a_fine_grid(spark):
    cases = {"a": ([(10, 20), (40, 44)], [(5, 12), (15, 16), (30, 41)], 60), "b": ([(3, 9)], [(0, 1), (20, 30)], 30), "c": ([(5, 6), (8, 30), (31, 33)], [(7, 9), (12, 13), (29, 32)], 40)}
    frame = lambda k: spark.createDataFrame([(e, *x) for e, c in cases.items() for x in c[k]], "entity string, start long, stop long")
    lengths = spark.createDataFrame([(e, c[2]) for e, c in cases.items()], "entity string, n long")
    for step in (1024, 7):
        for row in catalog.affiliation(frame(0), frame(1), lengths, ["entity"], step).collect():
            assert np.allclose((row.precision, row.recall), affiliation_by_grid(*cases[row.entity]), atol=1e-4)
    assert catalog.affiliation(frame(0).limit(0), frame(1), lengths, ["entity"]).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    flat = lambda rows: sorted((tuple("" if v is None else round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows), key=str)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert flat(got.select(*names).collect()) == flat(want.fetchall())


def test_segments_go_on_from_chunk_to_chunk(spark):
    at = [*range(65530, 65540), 131071, 131072, 131073, 300000, 300001]
    flags = [1, 0, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 0, 1, 1]
    s = spark.createDataFrame([("a", "c", "test", 0, t, 1.0, y) for t, y in zip(at, flags, strict=True)], SERIES)
    got = [(r.run_id, r.start, r.stop, r.length) for r in prep.segments(s).orderBy("start").collect()]
    assert got == [(1, 65530, 65530, 1), (2, 65532, 65537, 6), (3, 65539, 131072, 3), (4, 300000, 300001, 2)]


def test_labels_from_spans_that_overlap(spark):
    spans = [(0, 3), (2, 9), (2, 4), (5, 5), (12, 18), (16, 17), (31, 99)]
    df = spark.createDataFrame([("a", "test", 0, *x) for x in spans], "entity string, split string, channel int, start long, stop long")
    got = [r.label for r in prep.labels_from_segments(line(spark, range(40)), df, step=4).orderBy("t").collect()]
    assert got == [int(any(a <= t <= b for a, b in spans)) for t in range(40)]


@pytest.mark.parametrize("made", [lambda s: catalog.clean_windows(s, 3, 6, 12), lambda s: prep.segments(s)])
def test_points_are_not_read_again(spark, tmp_path, made):
    line(spark, range(200), [int(k in (40, 150, 160)) for k in range(200)]).write.parquet(f"{tmp_path}/points")
    out = made(spark.read.parquet(f"{tmp_path}/points"))
    assert not [f for f in out.inputFiles() if str(tmp_path) + "/points" in f] and out.count()


def test_window_moments_are_worked_out_once(spark):
    x = np.random.default_rng(8).normal(size=3000)
    w = spark.createDataFrame([(x.tolist(),)], "w array<double>")
    out = w.select(prep.standardise_window(F.col("w")).alias("z"), prep.minmax_window(F.col("w")).alias("m"))
    got = out.first()
    assert np.allclose(got.z, (x - x.mean()) / x.std(ddof=1)) and np.allclose(got.m, (x - x.min()) / np.ptp(x))
    plan = w.select(prep.standardise_window(F.col("w")).alias("z"))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"\baggregate\(", plan.split("\n")[0])) == 2, plan


def many(spark, tmp_path, entities=60, n=120):
    """Series of random labels and gaps, read from a file, and each entity's labels and known points."""
    rng, made = np.random.default_rng(4), {}
    for k in range(entities):
        made[f"e{k}"] = ((rng.random(n) < (0, 0.01, 0.03, 0.1)[k % 4]).astype(int).tolist(), (rng.random(n) > 0.02).tolist())
    rows = [(e, "c", "test", 0, t, 1.0 if ok[t] else None, label[t]) for e, (label, ok) in made.items() for t in range(n)]
    spark.createDataFrame(rows, SERIES).write.parquet(f"{tmp_path}/points")
    return spark.read.parquet(f"{tmp_path}/points"), made


def test_tables_that_are_small_on_disk_alone_are_not_broadcast(spark, tmp_path):
    points, made = many(spark, tmp_path)
    windows = catalog.clean_windows(points, 2, 2, 4, most_rate=0.1)
    parts = catalog.fixed_parts(points, windows, 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # over each file written here, below what Spark expects of a join of two
    try:
        for out in (prep.segments(points), windows, parts, catalog.funnel(points, 2, 2, 4, 0.1)):
            assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r.entity: r.n for r in parts.groupBy("entity").agg(F.count("*").alias("n")).collect()}
    want = {e: clean_by_loop(*x, 2, 2, 4, 0.1) for e, x in made.items()}
    assert got and got == {e: w[2] - w[0] for e, w in want.items() if w}


def test_funnel_reads_points_once_and_equals_a_loop(spark, tmp_path):
    points, made = many(spark, tmp_path)
    out = catalog.funnel(points, 2, 2, 4, 0.1)
    assert not [f for f in out.inputFiles() if f"{tmp_path}/points" in f]
    found = lambda x, rate: clean_by_loop(*x, 2, 2, 4, rate) is not None
    reason = lambda x: "no_anomaly" if not sum(x[0]) else "client" if found(x, 0.1) else "anomaly_dominated" if found(x, 1) else "no_clean_window"
    want = {e: reason(x) for e, x in made.items()}
    assert {r.entity: r.reason for r in out.collect()} == want and len(set(want.values())) == 4
