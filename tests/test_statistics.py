"""Selection of a median, Student's t, gates and neighbours against plain versions."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetseries.functions.frames import beside, carried
from fleetseries.operators import catalog, describe, reports
from fleetseries.sources import tables


def matched(spark, d):
    rows = [(k, "e", float(x), 0.0, "matched") for k, x in enumerate(d)] + [(-1, "e", None, 1.0, "only_b")]
    return spark.createDataFrame(rows, "seed long, entity string, va double, vb double, status string")


@pytest.mark.parametrize("few", [4096, 3])
def test_hodges_lehmann_equals_all_pairs(spark, few):
    rng = np.random.default_rng(3)
    cases = [rng.normal(size=41), np.round(rng.normal(size=60), 1), np.zeros(30), np.r_[np.zeros(20), 5], [2.0], [1.0, 4.0], np.r_[np.full(9, -1e6), np.full(10, 1e6)], rng.normal(size=20) * 1e-9 + 7]
    for d in cases if few > 100 else [cases[1], cases[3]]:
        d = np.asarray(d, float)
        walsh = [(a + b) / 2 for i, a in enumerate(d) for b in d[i:]]
        got = reports.hodges_lehmann(matched(spark, d), few).first()
        assert got.hl == pytest.approx(np.median(walsh), abs=1e-12) and got.n_walsh == len(walsh)
    assert reports.hodges_lehmann(matched(spark, [])).first().hl is None


#: Upper tails of Student's t: (t, degrees of freedom, chance), from published tables and closed forms of 1 and 2 degrees.
TAILS = [(0.0, 5, 0.5), (1.0, 1, 0.25), (12.706205, 1, 0.025), (2.919986, 2, 0.05), (2.570582, 5, 0.025), (1.812461, 10, 0.05), (2.042272, 30, 0.025), (1.660234, 100, 0.05), (-1.812461, 10, 0.95)]


def integral(t, v):
    x = np.linspace(0, abs(t), 200001)
    y = (1 + x * x / v) ** (-(v + 1) / 2)
    area = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * np.trapezoid(y, x)
    return 0.5 - area if t >= 0 else 0.5 + area


def test_student_tails_and_quantiles(spark):
    rows = TAILS + [(t, v, integral(t, v)) for t in (-4.0, -0.3, 0.1, 1.7, 6.0) for v in (1, 2, 3, 9, 40, 1000)]
    df = spark.createDataFrame([(float(t), float(v), float(p)) for t, v, p in rows], "t double, v double, p double")
    for r in df.withColumn("got", reports.student_upper(F.col("t"), F.col("v"))).collect():
        assert r.got == pytest.approx(r.p, abs=1e-6), r
    q = df.where("t > 0 and v in (1, 2, 5, 10, 30)").limit(4).select("v", reports.student_quantile(0.05, F.col("v")).alias("q")).select("*", reports.student_upper(F.col("q"), F.col("v")).alias("p"))
    assert all(r.p == pytest.approx(0.05, abs=1e-9) for r in q.collect())
    for x in (0.5, 1.0, 3.7, 60.0):
        assert spark.range(1).select(reports.log_gamma(F.lit(x)).alias("g")).first().g == pytest.approx(math.lgamma(x), abs=1e-10)


def test_equivalence_verdicts(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(size=25) * 0.1
    r = reports.equivalence(matched(spark, d), 0.2).first()
    se = d.std(ddof=1) / 5
    assert (r.p_low, r.p_high) == pytest.approx((integral((d.mean() + 0.2) / se, 24), integral((0.2 - d.mean()) / se, 24)), abs=1e-6)
    assert r.verdict == "equivalent" and -0.2 < r.low < r.delta < r.high < 0.2
    assert reports.equivalence(matched(spark, d + 1), 0.2).first().verdict == "not equivalent"
    assert reports.equivalence(matched(spark, d), 0.03).first().verdict == "equivalent, underpowered"
    assert reports.equivalence(matched(spark, d), 0.01).first().verdict == "not equivalent, underpowered"
    assert reports.equivalence(matched(spark, np.zeros(4)), 0.1).first().verdict == "equivalent"
    assert reports.equivalence(matched(spark, [1.0]), 0.1).first().verdict is None


def test_gates_equal_numpy(spark):
    rng = np.random.default_rng(2)
    tables = rng.dirichlet(np.ones(6), 4)
    volume = np.array([5.0, 500, 40, 2])
    rows = [("x", int(w), int(p), int(rng.integers(6))) for w in range(5) for p in range(8)]
    tokens = spark.createDataFrame(rows, "entity string, win int, pos int, token int")
    experts = spark.createDataFrame([(f"c{k}", t, math.log(tables[k, t]), -math.log(tables[k, t]) * 30, math.log(volume[k])) for k in range(4) for t in range(6)], "client string, token int, logq double, nll double, logn double")
    got = {(r.win, r.pos): r for r in catalog.gated_nll(tokens, experts, ["entity", "win"]).collect()}
    lse = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
    for _, w, p, t in rows:
        nll = -np.log(tables[:, t]) * 30
        context = np.log(volume) + sum(np.log(tables[:, u]) for _, v, _, u in rows if v == w)
        for name, weight in (("volume_gate", np.log(volume)), ("context_gate", context), ("target_gate", np.log(volume) - nll)):
            assert got[w, p][name] == pytest.approx(-lse(weight - nll) + lse(weight))


@pytest.mark.parametrize("step", [1, 10, 10**6])
def test_beside_equals_a_window(spark, step):
    rng = np.random.default_rng(5)
    rows = [(k, int(t), float(t) / 3) for k in "ab" for t in np.unique(rng.integers(0, 400, 40))] + [("c", 7, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(r.k, r.t): (r.p, r.n) for r in beside(df, ["k"], "t", {"p": "v"}, {"n": "t"}, step).collect()}
    for k in "abc":
        own = [r for r in rows if r[0] == k]
        for i, r in enumerate(own):
            assert got[k, r[1]] == (own[i - 1][2] if i else None, own[i + 1][1] if i + 1 < len(own) else None)


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_interpolation_reaches_over_any_gap(spark, step):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k, n, known in (("a", 3000, [5, 9, 2990]), ("b", 40, sorted(rng.choice(40, 12, False).tolist())), ("c", 10, []), ("d", 4, [2])):
        x = {t: float(rng.normal()) for t in known}
        rows += [(k, t, x.get(t)) for t in range(n)]
        want |= {(k, t): float(np.interp(t, known, [x[i] for i in known])) if known else None for t in range(n)}
    df = spark.createDataFrame(rows, "k string, t long, value double")
    for r in describe.interpolate(df, ["k"], step).collect():
        assert r.filled == (None if want[r.k, r.t] is None else pytest.approx(want[r.k, r.t], abs=1e-9))


def test_carried_walks_no_frame_to_the_end(spark):
    df = spark.createDataFrame([("a", t, float(t) if t in (2, 5) else None) for t in range(8)], "k string, t long, value double")
    out = carried(df, ["k"], "value", "p", "n", step=3)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = [(r.p and r.p.t, r.n and r.n.t) for r in out.orderBy("t").collect()]
    assert got == [(None, 2)] * 2 + [(2, 2)] + [(2, 5)] * 2 + [(5, 5)] + [(5, None)] * 2


@pytest.mark.parametrize("n", [1, 5, 64, 200])
def test_resample_of_any_length(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "k string, t long, filled double")
    got = [r.r for r in describe.resample(df, ["k"], 64).orderBy("j").collect()]
    assert np.allclose(got, np.interp(np.arange(64) * (n - 1) / 63, np.arange(n), x))


def test_daily_fills_from_the_first_day_to_the_last(spark, tmp_path):
    rows = [(1, "1995-01-03 00:00:00", 2.0), (1, "1995-01-03 05:00:00", 3.0), (2, None, 9.0), (2, "1995-01-01 00:00:00", 1.0), (3, None, 4.0), (None, "1995-01-05 00:00:00", 7.0), (4, "1995-01-02 00:00:00", None), (9, "1995-01-02 00:00:00", 1.0)]
    spark.createDataFrame(rows, "l_suppkey long, s string, l_extendedprice double").selectExpr("l_suppkey", "cast(s as timestamp) as l_shipdate", "l_extendedprice").coalesce(1).write.parquet(f"{tmp_path}/l")
    spark.createDataFrame([(k, k % 3) for k in (1, 2, 3, 4, 5)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/s")
    con = duckdb.connect()
    for name, at in (("lineitem", "l"), ("supplier", "s")):
        con.sql(f"create view {name} as select * from '{tmp_path}/{at}/*.parquet'")
    got = tables.daily_from_lineitem(spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/s")).select("entity", "cluster", "t", "value")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"WITH {tables.DAILY_SQL} SELECT entity, cluster, t, value FROM daily").fetchall())
    assert got.count() == 20 and got.where("value > 0").count() == 2
