"""Attribution, thresholds, priors and fusion: small cases against numpy, and every query against its SQL."""

import duckdb
import numpy as np
import pytest

from fleetseries.operators import attribution, detect, fusion, priors
from fleetseries.plans import fleet  # noqa: F401
from fleetseries.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
NAMES = ["c9_eligibility", "w12_richness", "t10_source_threshold", "k2_segment_hits", "k4_macro_weighted", "j16_pooled_and_macro", "p6_token_nll", "p14_mergeability", "r19_transfer_reduction", "u3_fusion_gain", "r14_noise_gate"]


def channels(spark, scores, labels):
    rows = [("a", t, c, float(x), int(y)) for t, (xs, ys) in enumerate(zip(scores, labels, strict=True)) for c, (x, y) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(rows, "entity string, t long, channel int, score double, channel_label int")


def test_localisation_and_segment_hits_by_hand(spark):
    s = channels(spark, [[3, 2, 1], [1, 2, 3], [0, 0, 9]], [[1, 0, 0], [1, 0, 1], [0, 0, 0]])
    got = attribution.localisation(s, ["entity"], (1,)).first()
    assert (got.n_steps, got.precision_at_1, got.recall_at_1, got.at_oracle) == (2, 1.0, 0.75, 0.75)
    hits = attribution.segment_hits(s).first()  # one segment of two steps: channels 0 and 2 are labelled, peaks 3, 2, 3
    assert (hits.ips, hits.n_segments) == (1.0, 1)
    assert attribution.localisation(channels(spark, [[1]], [[1]]), ["entity"]).count() == 0  # one channel: no metric
    assert attribution.segment_hits(channels(spark, [[1, 2]], [[0, 0]])).count() == 0


def labelled(spark, scores, labels):
    rows = [("a", "c", float(x), int(y)) for x, y in zip(scores, labels, strict=True)]
    return spark.createDataFrame(rows, "entity string, cluster string, score double, label int")


def test_thresholds_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 30, 200), rng.random(200) < 0.1  # many ties
    s = labelled(spark, x, y)
    f1 = lambda thr: 2 * (y & (x > thr)).sum() / ((x > thr).sum() + y.sum())
    tried = [np.percentile(x, 100 - r) for r in detect.RATIOS]
    got = detect.ratio_threshold(s, ["entity"]).first()
    assert np.isclose(got.f1, max(map(f1, tried))) and got.ratio == detect.RATIOS[int(np.argmax([f1(t) for t in tried]))]
    assert np.isclose(detect.base_rate_threshold(s, ["entity"]).first().thr, np.quantile(x, 1 - y.mean()))
    none = detect.ratio_threshold(labelled(spark, [1, 2], [0, 0]), ["entity"]).first()
    assert none.f1 == 0.0 and none.ratio == detect.RATIOS[0]


def test_frozen_thresholds_against_counting(spark):
    x, y = np.array([1, 2, 3, 4, 5, 5]), np.array([0, 0, 1, 0, 1, 1])
    marks = {"s": 2.0, "u": 2.0, "v": 4.5, "w": 9.0}
    made = spark.createDataFrame([("c", k, v) for k, v in marks.items()], "cluster string, source string, thr double")
    got = {r.source: r.f1 for r in detect.frozen_thresholds(labelled(spark, x, y), made).collect()}
    assert got == pytest.approx({k: 2 * y[x > v].sum() / ((x > v).sum() + y.sum()) for k, v in marks.items()})


def test_backoff_adds_up_to_one_and_merges_exactly(spark):
    rows = [(e, "train", w, p, int(t)) for e in "ab" for w, win in enumerate(np.random.default_rng(ord(e)).integers(0, 4, (6, 5))) for p, t in enumerate(win)]
    seen = priors.in_context(spark.createDataFrame(rows, "entity string, split string, win long, pos int, token int"))
    ask = spark.createDataFrame([(1, 2, t) for t in range(4)] + [(None, 3, t) for t in range(4)] + [(None, None, t) for t in range(4)], "a int, b int, token int")
    sums = priors.backoff(seen, ask, 4).groupBy("a", "b").sum("p").collect()
    assert len(sums) == 3 and np.allclose([r["sum(p)"] for r in sums], 1.0)
    alone = priors.mergeability(seen.where("entity = 'a'"), 4).first()
    assert abs(alone.kl) < 1e-12  # one client: the average is the pooled table
    assert priors.mergeability(seen, 4).first().kl > 0


def test_mixed_nll_stays_finite(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(priors.mixed_nll(F.lit(2000.0), F.lit(2001.0), 0.5).alias("m")).first()
    assert np.isclose(row.m, 2000 - np.log(0.5 + 0.5 * np.exp(-1.0)))


def test_fusing_equal_scorers_changes_nothing(spark):
    x = [0.1, 0.9, 0.4, 0.4]
    wide = spark.createDataFrame([("a", t, int(t == 1), v, v, v) for t, v in enumerate(x)], "entity string, t long, label int, p double, q double, r double")
    z = fusion.standardised(fusion.long_scores(wide, ["p", "q", "r"]))
    want = (np.array(x) - np.mean(x)) / np.std(x)
    got = fusion.fuse(z).orderBy("t").collect()
    assert np.allclose([r.mean_z for r in got], want) and np.allclose([r.trimmed_z for r in got], want)
    assert np.allclose([r.mean_rank for r in got], [0.25, 1.0, 0.625, 0.625])
    gain = fusion.gains(z).first()
    assert gain.fused == gain.best_auprc == 1.0 and gain.gain_vs_mean == 0.0


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    flat = lambda rows: sorted((tuple("" if v is None else round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows), key=str)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert flat(got.select(*names).collect()) == flat(want.fetchall())
