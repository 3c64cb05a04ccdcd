"""Sums of products, autoregression and subspace scores against numpy."""

import numpy as np

from fleetseries.operators import detect
from pyspark.sql import functions as F


def test_sums_of_products_by_key(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = {("a", 1): rng.normal(size=(40, 5)), ("a", 2): rng.normal(size=(1, 5)), (None, 1): rng.normal(size=(7, 5)) * 100}
    rows = [(*k, v.tolist()) for k, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "k string, j int, v array<double>").repartition(3)
    for held in (detect.HELD, 30):
        monkeypatch.setattr(detect, "HELD", held)
        got = {(r.k, r.j): r for r in detect.gram(df, ["k", "j"]).collect()}
        assert got.keys() == groups.keys()
        for k, x in groups.items():
            assert got[k].n == len(x) and np.allclose(got[k].s, x.sum(0)) and np.allclose(np.reshape(got[k].g, (5, 5)), x.T @ x)
    assert detect.gram(df.limit(0), ["k", "j"]).count() == 0


def test_autoregression_equals_numpy(spark):
    rng, p = np.random.default_rng(4), 32
    x = rng.normal(size=300)
    for t in range(2, 300):
        x[t] += 0.6 * x[t - 1] - 0.3 * x[t - 2]
    df = spark.createDataFrame([("e", "train", 0, t, float(v)) for t, v in enumerate(x)], "entity string, split string, channel int, t long, x double")
    fit = detect.ar_solve(detect.ar_stats(df, ["entity"]), ["entity"])
    past = np.array([x[t - p : t][::-1] for t in range(p, 300)])
    n = len(past)
    w = np.linalg.solve(past.T @ past + 1e-4 * n * np.eye(p), past.T @ x[p:])
    errors = (x[p:] - past @ w) ** 2
    got = fit.collect()[0]
    assert np.allclose(got.w, w) and np.isclose(got.sigma2, errors.mean())
    scores = [r.score for r in detect.ar_score(df, fit, ["entity"]).orderBy("t").collect()]
    assert np.allclose(scores, np.concatenate([np.zeros(p), errors / errors.mean()]))


def test_subspace_scores_equal_numpy(spark):
    rng, m, top = np.random.default_rng(5), 12, 8
    data = {k: rng.normal(size=(60, m)) @ rng.normal(size=(m, m)) + k for k in (1, 2)}
    df = spark.createDataFrame([(k, 40 * i, v.tolist()) for k, x in data.items() for i, v in enumerate(x)], "entity int, w_start long, w array<double>")
    models = detect.subspace_models(detect.gram(df, ["entity"], "w"), ["entity"])
    for matrix in ("residual", "white"):
        got = {(r.entity, r.w_start): r.r for r in detect.apply_matrix(df, models, ["entity"], matrix, chunk=500).collect()}
        assert len(got) == 120
        for k, x in data.items():
            cov = np.cov(x.T, bias=True)
            if matrix == "residual":
                v = np.linalg.svd(x - x.mean(0))[2][:top]
                want = (x - x.mean(0)) - (x - x.mean(0)) @ v.T @ v
            else:
                e, u = np.linalg.eigh(0.95 * cov + 0.05 * np.trace(cov) / m * np.eye(m))
                want = (x - x.mean(0)) @ (u / np.sqrt(e)) @ u.T
            assert np.allclose([got[k, 40 * i] for i in range(60)], want**2)
    assert detect.apply_matrix(df.where(F.lit(False)), models, ["entity"], "white").count() == 0
