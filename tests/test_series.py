"""Identities and small hand-made cases of the series operators, against numpy."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from fleetseries.operators import detect, prep, reports
from fleetseries.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def points(spark, values, labels=None, entity="a", split="test"):
    labels = labels or [0] * len(values)
    rows = [(entity, "c", split, 0, t, None if v is None else float(v), y) for t, (v, y) in enumerate(zip(values, labels, strict=True))]
    return spark.createDataFrame(rows, "entity string, cluster string, split string, channel int, t long, value double, label int")


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def test_segments_of_hand_made_labels(spark):
    got = prep.segments(points(spark, [0] * 6, [0, 0, 1, 1, 0, 1])).orderBy("start").collect()
    assert [(r.start, r.stop, r.length) for r in got] == [(2, 3, 2), (5, 5, 1)]
    assert prep.segments(points(spark, [0, 0], [0, 0])).count() == 0
    assert [(r.start, r.stop) for r in prep.segments(points(spark, [0, 0, 0], [1, 1, 1])).collect()] == [(0, 2)]


def test_frames_across_chunks_equal_numpy(spark):
    from fleetseries.functions.frames import framed, running_sum
    from pyspark.sql import functions as F

    x = np.random.default_rng(1).normal(size=50)
    s = points(spark, x)
    got = framed(s, 3, 2, {"m": lambda w: F.avg("value").over(w.rowsBetween(-3, 2))}, size=7)
    assert np.allclose(column(got, "m"), [x[max(0, k - 3) : k + 3].mean() for k in range(50)])
    assert np.allclose(column(running_sum(s, F.col("value"), "c", size=7), "c"), x.cumsum())


def test_ma3_is_a_quarter_of_diff1(spark):
    s = points(spark, np.random.default_rng(2).normal(size=40))
    a, b = column(detect.ma_centred(s, 3, "value"), "score"), column(detect.diff1(s, "value"), "score")
    assert np.allclose(a[1:], np.array(b[1:]) / 4)


def test_merged_statistics_equal_a_pooled_fit(spark):
    x, y = np.random.default_rng(3).normal(size=(2, 80))
    both = points(spark, x, entity="a").unionByName(points(spark, y, entity="b"))
    one = detect.ar_solve(detect.ar_stats(both, ["cluster"], 3, "value"), ["cluster"], 1e-4).first()
    rows = np.array([[s[t - 1], s[t - 2], s[t - 3], s[t]] for s in (x, y) for t in range(3, 80)])
    f, target = rows[:, :3], rows[:, 3]
    want = np.linalg.solve(f.T @ f + 1e-4 * len(f) * np.eye(3), f.T @ target)
    assert np.allclose(one.w, want, rtol=1e-8)


def test_coverage_equals_counting(spark):
    for length, width, stride in ((20, 6, 2), (7, 7, 3), (5, 8, 1), (33, 5, 7)):
        s = points(spark, [1.0] * length).withColumn("score", plans.F.lit(1.0))
        starts = range(0, length - width + 1, stride) if length >= width else []
        want = [sum(a <= t < a + width for a in starts) for t in range(length)]
        got = s.withColumn("cov", detect.coverage(plans.F.col("t"), plans.F.lit(length), width, stride))
        assert column(got, "cov") == want


def test_auroc_with_ties_and_one_class(spark):
    s = points(spark, [0] * 5, [0, 1, 0, 1, 1]).withColumn("score", plans.F.element_at(plans.F.array(*map(plans.F.lit, [1.0, 1.0, 2.0, 3.0, 2.0])), (plans.F.col("t") + 1).cast("int")))
    assert detect.auroc(s, ["entity"]).first().auroc == pytest.approx((0.5 + 0 + 1 + 1 + 1 + 0.5) / 6)
    assert detect.auroc(s.withColumn("label", plans.F.lit(0)), ["entity"]).first().auroc is None


def test_missing_statistics_is_an_error(spark):
    s = points(spark, [1.0, 2.0])
    with pytest.raises(Exception, match="no scaling statistics"):
        prep.scale(s, prep.scale_stats(s, ["entity"]), ["entity"]).collect()


def test_sign_test(spark):
    p = spark.createDataFrame([(k, "e", 1.0, 0.0 if k else 2.0, "matched") for k in range(8)], "seed int, entity string, va double, vb double, status string")
    assert reports.sign_test(p).first().p == pytest.approx(2 * 9 / 256)


@pytest.mark.parametrize("name", ["b6_segments", "s4_impulse", "j1_confusion", "t4_grid_threshold", "j5_average_precision", "r7_wilcoxon", "p3_ngrams"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    sql = con.sql(__spark_entry__.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    text = lambda rows, names: sorted(str([round(r[names.index(c)], 5) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in order]) for r in rows)
    assert text(df.collect(), df.columns) == text(sql.fetchall(), list(sql.columns))


def test_detrended_autocorrelation_equals_numpy(spark):
    from fleetseries.functions.frames import CHUNK

    rng = np.random.default_rng(4)
    made = {
        "noise": rng.normal(size=90) + 0.3 * np.arange(90), "wave": np.sin(np.arange(200) / 3) + 1e6, "sparse": np.where(np.arange(60) % 9, 0.0, 5e4), "short": rng.normal(size=7),
        "flat": np.full(30, 2.0), "one": np.array([3.0]), "long": rng.normal(size=CHUNK + 5).cumsum(), "nearly": 50.0 * np.arange(80) + 1e-4 * rng.normal(size=80),
    }
    rows = [(k, t, float(x)) for k, xs in made.items() for t, x in enumerate(xs)] + [("gap", t, None if t == 12 else float(t * t % 11)) for t in range(40)]
    s = spark.createDataFrame(rows, "entity string, t long, value double")
    got = {r.entity: r.acf for r in prep.detrended_acf_at(s, 7, ["entity"]).collect()}
    by_steps = {r.entity: r.acf for r in prep.acf_at(prep.detrend(s, ["entity"]), 7, "d", ["entity"]).collect()}
    assert set(got) == {*made, "gap"} and {k for k, v in got.items() if v is None} == {"short", "flat", "one"}
    for k, v in got.items():
        assert v == pytest.approx(by_steps[k], abs=1e-9)
        if k in made and v is not None:
            t = np.arange(len(made[k]))
            r = made[k] - np.polyval(np.polyfit(t, made[k], 1), t)
            assert v == pytest.approx(r[:-7] @ r[7:] / (r @ r), abs=1e-6)


@pytest.mark.parametrize("name, reads", [("w8_acf_at_lag", 2), ("n5_detrend", 3)])
def test_detrended_queries_read_the_calendar_seldom(spark, name, reads):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(sequence(from") <= reads
    assert name != "w8_acf_at_lag" or plan.count("Generate explode") == reads + 1  # and one frame
