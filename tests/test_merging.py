"""Merged models, witnesses, whitening and pairs of clients: against numpy."""

import numpy as np
from pyspark.sql import functions as F

from fleetseries.operators import detect, merging, models

P = 4
SERIES = "cluster string, entity string, split string, channel int, t long, x double"


def walks(n=(60, 90)):
    rng = np.random.default_rng(4)
    return {f"e{k}": np.convolve(rng.normal(size=m + 3), [0.5, 0.3, 0.1, 0.1], "valid") for k, m in enumerate(n)}


def line(spark, xs):
    return spark.createDataFrame([("c", e, "train", 0, t, float(v)) for e, x in xs.items() for t, v in enumerate(x)], SERIES)


def design(x):
    return np.array([x[t - P : t][::-1] for t in range(P, len(x))]), x[P:]


def ridge(xs):
    a, y = (np.concatenate(z) for z in zip(*(design(x) for x in xs), strict=True))
    g = a.T @ a + 1e-4 * len(y) * np.eye(P)
    return np.linalg.solve(g, a.T @ y), g, y @ y, a.T @ y, len(y)


def test_merged_models_and_their_loss(spark):
    xs = walks()
    s = line(spark, xs)
    stats = detect.ar_stats(s, ["cluster", "entity"], P)
    fits = detect.ar_solve(stats, ["cluster", "entity"]).join(stats.select("cluster", "entity", "n"), ["cluster", "entity"])
    mean = merging.vector_mean(fits, ["cluster"], "w", "n")
    own = [ridge([x]) for x in xs.values()]
    want = sum(o[0] * o[4] for o in own) / sum(o[4] for o in own)
    assert np.allclose(mean.first().w, want)
    merged = merging.sum_stats(stats, ["cluster"])
    best = detect.ar_solve(merged, ["cluster"])
    w, g, q, b, _ = ridge(list(xs.values()))
    got = merging.excess_objective(merged, best, mean, ["cluster"]).first()
    assert np.allclose([got.optimum, got.excess, got.relative], [q - w @ b, (want - w) @ g @ (want - w), (want - w) @ g @ (want - w) / (q - w @ b)])
    pooled = detect.ar_solve(merging.design_stats(s, ["cluster"], P), ["cluster"])
    assert np.allclose(pooled.first().w, w) and merging.witness(best, pooled, ["cluster"]).first().gap < 1e-9
    verdict = lambda a, b: merging.witness(a, b, ["cluster"]).first().verdict
    assert verdict(best, best) == "FAIL: exact zero" and verdict(best, mean) == "FAIL: above tolerance"
    assert verdict(best, best.withColumn("w", F.transform("w", lambda x: x * (1 + 1e-12)))) == "PASS"


def test_scores_of_an_autoregression(spark):
    x = walks()["e1"]
    s = line(spark, {"e1": x})
    got = detect.ar_score(s, detect.ar_solve(detect.ar_stats(s, ["entity"], P), ["entity"]), ["entity"], P).orderBy("t").collect()
    w, _, q, b, n = ridge([x])
    a, y = design(x)
    assert np.allclose([r.score for r in got], [0] * P + list((y - a @ w) ** 2 / ((y - a @ w) @ (y - a @ w) / n)))


def test_subspaces_and_whitening(spark):
    rng = np.random.default_rng(6)
    data = {k: rng.normal(size=(40 + 10 * k, 5)) @ rng.normal(size=(5, 5)) for k in range(2)}
    v = spark.createDataFrame([("c", k, row.tolist()) for k, x in data.items() for row in x], "cluster string, client int, v array<double>")
    stats = detect.gram(v, ["cluster", "client"])
    fits = detect.subspace_models(stats, ["cluster", "client"], 2).join(stats.select("cluster", "client", "n"), ["cluster", "client"])
    off = {}
    for r in fits.collect():
        x = data[r.client]
        _, u = np.linalg.eigh(np.cov(x.T, bias=True))
        off[r.client] = np.eye(5) - u[:, -2:] @ u[:, -2:].T
        assert np.allclose(np.reshape(r.residual, (5, 5)), off[r.client]) and np.allclose(r.mu, x.mean(0))
        shrunk = 0.95 * np.cov(x.T, bias=True) + 0.05 * np.trace(np.cov(x.T, bias=True)) / 5 * np.eye(5)
        assert np.allclose(np.reshape(r.white, (5, 5)) @ shrunk @ np.reshape(r.white, (5, 5)), np.eye(5))
    windows = v.withColumnRenamed("v", "w")
    for r in detect.apply_matrix(windows, fits, ["cluster", "client"], "residual").collect():
        assert np.allclose(r.r, ((np.array(r.w) - data[r.client].mean(0)) @ off[r.client]) ** 2)
    mean = (40 * (np.eye(5) - off[0]) + 50 * (np.eye(5) - off[1])) / 90
    _, u = np.linalg.eigh(mean)
    got = merging.subspace_mean(fits, ["cluster"], 2).first()
    assert np.allclose(np.reshape(got.residual, (5, 5)), np.eye(5) - u[:, -2:] @ u[:, -2:].T)
    for r in merging.whitening(stats, ["client"], 0.0).collect():
        cov = np.cov(data[r.client].T, bias=True)
        white = np.reshape(r.white, (5, 5))
        assert np.allclose(white @ cov @ white.T, np.eye(5)) and np.isclose(r.condition, np.linalg.cond(cov))


def test_pairs_of_clients_and_hits(spark):
    rows = [("x", k, c, float(k * i)) for k in range(5) for i, c in enumerate("abc")] + [("x", 9, "a", 1.0)]
    got = {(r.a, r.b): (r.n, r.mae, r.widest) for r in merging.output_gaps(spark.createDataFrame(rows, "g string, t long, client string, y double"), ["t"], ["g"]).collect()}
    assert got == {("a", "b"): (5, 2.0, 4.0), ("a", "c"): (5, 4.0, 8.0), ("b", "c"): (5, 2.0, 4.0)}
    hits = spark.createDataFrame([("m", "u", 1), ("m", "v", 0), ("m", "w", None)], "arm string, entity string, hit int")
    assert {(r.entity, r.rate, r.n) for r in merging.hit_table(hits, ["entity"]).collect()} == {("u", 1.0, 1), ("v", 0.0, 1), (None, 0.5, 2)}
    assert [r.arm for r in merging.relabelled(hits, {"m": "k", "q": "z"}).select("arm").distinct().collect()] == ["k"]


def test_constant_series_have_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)], "k string, x double, y double")
    assert {r.k: r.pearson for r in models.approximation(df, ["k"]).collect()} == {"a": 0.0, "b": 1.0}
