"""Running sums by value, exact quantiles, the volume under the surface and the report: against numpy and by hand."""

import numpy as np
import pytest

from fleetseries.functions.frames import quantiles, value_sums
from fleetseries.operators import detect, volume
from pyspark.sql import functions as F

VALUES = [0.0, -0.0, 1e-300, -1e-300, 3.5, 3.5, -2.0, 1e300, float("inf"), float("-inf"), 7.0, 7.25, 1.0]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=301) ** 3, "b": np.round(rng.exponential(size=100), 1), "c": np.array([4.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), (None, 2.0)]
    made = {"lo": 0.0, "mid": 0.5, "high": 0.9, "top": 1.0}
    got = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", made).collect()}
    for k, v in groups.items():
        assert np.allclose([got[k][n] for n in made], [np.quantile(v, q) for q in made.values()])
    whole = quantiles(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), [], "x", {"mid": 0.5}).collect()
    assert [r.mid for r in whole] == [2.0]


@pytest.mark.parametrize("falling", [False, True])
def test_sums_follow_the_order_of_values(spark, falling):
    df = spark.createDataFrame([("k", x) for x in VALUES], "k string, x double").groupBy("k", "x").agg(F.count("*").alias("c"))
    got = {r.x: r.upto for r in value_sums(df, ["k"], "x", {"upto": F.col("c")}, falling).collect()}
    assert got == {x: sum((y >= x) if falling else (y <= x) for y in VALUES) for x in VALUES}


def by_loop(label, score, buffer, cuts):
    """VUS-ROC and VUS-PR from their definition, point by point."""
    n, on = len(label), np.flatnonzero(label)
    edges = [(a[0], a[-1]) for a in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1)]
    ordered = np.sort(score)[::-1]
    roc = pr = 0.0
    for v in range(buffer + 1):
        h, soft = v // 2, np.array(label, float)
        for t in range(n):
            if not label[t]:
                reach = [max(a - t, t - b) for a, b in edges]
                soft[t] = min(1.0, sum(np.sqrt(1 - d / v) for d in reach if 1 <= d <= h))
        ranges = []
        for a, b in edges:
            if ranges and a - ranges[-1][1] <= 2 * h:
                ranges[-1][1] = b
            else:
                ranges.append([a, b])
        curve = [(0.0, 0.0)]
        for place in np.linspace(0, n - 1, cuts).astype(int):
            pred = score >= ordered[place]
            tp = soft[pred].sum()
            real = (sum(label) + np.where(label, 1, soft * pred).sum()) / 2
            seen = np.mean([pred[max(a - h, 0) : b + h + 1].any() for a, b in ranges])
            tpr, fpr = min(tp / real, 1) * seen, (pred.sum() - tp) / (n - real)
            pr += (tpr - curve[-1][0]) * tp / pred.sum()
            curve.append((tpr, fpr))
        curve.append((1.0, 1.0))
        roc += sum((y[1] - x[1]) * (x[0] + y[0]) / 2 for x, y in zip(curve, curve[1:], strict=False))
    return roc / (buffer + 1), pr / (buffer + 1)


def test_volume_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(4):
        n = 60 + 17 * k
        label = np.zeros(n, int)
        for a in rng.choice(n, 4, replace=False):
            label[a : a + rng.integers(1, 6)] = 1
        score = np.round(rng.normal(size=n) + label, 1 if k % 2 else 6)
        want[f"e{k}"] = by_loop(label, score, 9, 20)
        rows += [(f"e{k}", t, float(s), int(y)) for t, (s, y) in enumerate(zip(score, label, strict=True))]
    rows += [("flat", t, 1.0, 0) for t in range(5)]
    got = {r.entity: (r.vus_roc, r.vus_pr) for r in volume.surface(spark.createDataFrame(rows, "entity string, t long, score double, label int"), ["entity"], 9, 20).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_overlap_across_buckets(spark):
    t = spark.createDataFrame([("a", 0, 2500), ("a", 5000, 5001)], "entity string, start long, stop long")
    p = spark.createDataFrame([("a", 2500, 2600), ("a", 10, 11), ("a", 4000, 4001)], "entity string, start long, stop long")
    r = detect.event_overlap(t, p, ["entity"]).first()
    assert (r.n_true, r.n_pred, r.hit_true, r.hit_pred) == (2, 3, 1, 2)
