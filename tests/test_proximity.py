"""Proximity-aware evaluation against a version that walks over points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetseries.operators import catalog, detect, prep, proximity, volume


def runs_of(flags):
    edges = np.flatnonzero(np.diff(np.r_[0, flags, 0]))
    return list(zip(edges[::2], edges[1::2] - 1))


def walked(label, pred, early, late):
    """(true, predicted, missed) weights, point by point."""
    n, spans = len(label), runs_of(label)
    away = lambda x, s, e: sum(abs(x - y) for y in range(s, e + 1))
    tp, missed, owner = 0.0, 0.0, {}
    ends = [min(e + late, (spans[i + 1][0] if i + 1 < len(spans) else n) - 1) for i, (_, e) in enumerate(spans)]
    for i, (s, e) in enumerate(spans):
        begin = max(0, s - early, (ends[i - 1] if i else -1) + 1)
        owner |= {x: (i, "pre", begin) for x in range(begin, s)} | {x: (i, "in", 0) for x in range(s, e + 1)} | {x: (i, "post", ends[i]) for x in range(e + 1, ends[i] + 1)}
    hit = [pred[s : e + 1].any() for s, e in spans]
    for x in np.flatnonzero(pred):
        i, zone, edge = owner.get(int(x), (None, None, None))
        if zone == "in":
            tp += 1
        elif zone == "post" or (zone == "pre" and hit[i]):
            tp += 1 - away(x, *spans[i]) / away(edge, *spans[i])
    for (s, e), seen in zip(spans, hit):
        if not seen:
            missed += e - s + 1
            continue
        a, b = runs_of(pred[s : e + 1])[0]
        for p in range(s, e + 1):
            if not pred[p]:
                near = p <= s + (b - a + 1)
                missed += 1 if near or e == s else 1 - sum(abs(p - y) for y in range(s, s + b - a + 2)) / away(e, s, e)
    return tp, int(pred.sum()), missed


def rates(label, pred, early, late):
    tp, predicted, missed = walked(label, pred, early, late)
    return (tp / predicted if predicted else 0.0), (tp / (tp + missed) if tp + missed else 0.0)


def thresholds(label, score, cuts):
    distinct = np.unique(score)[::-1]
    hits = np.array([label[score >= s].sum() for s in distinct])
    if len(distinct) > 2:
        keep = np.r_[True, (np.diff(hits)[:-1] != 0) | (np.diff(hits)[1:] != 0), True]
        distinct = distinct[keep]
    rising, out = distinct[::-1], []
    for q in np.linspace(100, 0, cuts) / 100:
        at = (len(rising) - 1) * q
        at = round(at) if abs(at - round(at)) < 1e-9 else at
        lo = int(np.floor(at))
        out.append(rising[lo] if lo == at else rising[lo] * (1 - (at - lo)) + rising[lo + 1] * (at - lo))
    return out


def area(label, score, early, late, cuts):
    out = []
    for e in (0, early):
        for d in (0, late):
            curve = [(1.0, 0.0)]
            for thr in thresholds(label, score, cuts):
                p, r = rates(label, (score >= thr).astype(int), e, d)
                r = round(r, 12)
                if r >= curve[-1][1]:
                    curve.append((p, r))
            out.append(sum((b[1] - a[1]) * (a[0] + b[0]) / 2 for a, b in zip(curve, curve[1:])))
    return np.mean(out)


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(6)
    out = {"one": (np.r_[0, 1], np.r_[0.2, 0.1]), "none": (np.zeros(9, int), np.arange(9.0)), "all": (np.ones(7, int), np.arange(7.0)), "equal": (np.r_[0, 0, 1, 0], np.ones(4))}
    for k in range(24):
        n = int(rng.integers(20, 90))
        label = (rng.random(n) < rng.choice([0.1, 0.3, 0.6])).astype(int)
        if k % 3 == 0:  # long segments with short gaps: their zones overlap
            label = np.repeat((rng.random(n) < 0.5).astype(int), int(rng.integers(2, 9)))[:n]
        score = np.round(rng.random(len(label)) + 0.3 * label, 1 if k % 2 else 6)
        out[f"k{k}"] = (label, score)
    return out


def points(spark, cases, start=0):
    rows = [(k, "c", int(t) + start, float(s), int(y), int(s > 0.6)) for k, (label, score) in cases.items() for t, (y, s) in enumerate(zip(label, score))]
    return spark.createDataFrame(rows, "entity string, e string, t long, score double, label int, pred int").drop("e")


@pytest.mark.parametrize(("early", "late", "cuts"), [(6, 6, 250), (0, 4, 33), (50, 50, 7)])
def test_pate_equals_the_walk(spark, cases, early, late, cuts):
    got = {r.entity: r.pate for r in proximity.pate(points(spark, cases, 17), ["entity"], early, late, cuts).collect()}
    assert got == pytest.approx({k: area(label, score, early, late, cuts) for k, (label, score) in cases.items()}, abs=1e-9)


@pytest.mark.parametrize(("early", "late"), [(0, 0), (2, 40)])
def test_pate_f1_equals_the_walk(spark, cases, early, late):
    got = {r.entity: r.pate_f1 for r in proximity.pate_f1(points(spark, cases), ["entity"], early, late).collect()}
    want = {}
    for k, (label, score) in cases.items():
        each = [rates(label, (score > 0.6).astype(int), e, d) for e in (0, early) for d in (0, late)]
        want[k] = np.mean([2 * p * r / (p + r) if p + r else 0.0 for p, r in each])
    assert got == pytest.approx(want, abs=1e-9)


def test_pate_cuts_and_empty(spark, cases):
    df = points(spark, cases)
    got = {r.entity: r.thr for r in proximity.cut_scores(df, ["entity"], 40).collect()}
    for k, (label, score) in cases.items():
        assert got[k] == pytest.approx(thresholds(label, score, 40), abs=1e-12)
    assert proximity.pate(df.limit(0), ["entity"], 3, 3).count() == 0
    bins = df.join(proximity.cut_scores(df, ["entity"], 40), "entity").select("entity", "score", "thr", proximity.first_reached(F.col("thr"), F.col("score"), 40).alias("bin"))
    for r in bins.collect():
        assert r.bin == sum(x > r.score for x in r.thr)


def test_suite_rows_are_those_of_the_single_metrics(spark, cases):
    """For each strategy, the long rows equal what each metric gives for that strategy's flags alone."""
    both = {k: v for k, v in cases.items() if 0 < v[0].sum() < len(v[0]) and k in ("k0", "k3", "k4")}
    rows = [(k, "c", "test", 0, t, float(s), int(y)) for k, (label, score) in both.items() for t, (y, s) in enumerate(zip(label, score))]
    df = spark.createDataFrame(rows, "entity string, cluster string, split string, channel int, t long, score double, label int")
    thr = spark.createDataFrame([(k, n, x) for k in both for n, x in (("low", 0.3), ("never", 9.0))], "entity string, strategy string, thr double")
    got = {(r.entity, r.strategy, r.metric): r.value for r in volume.suite(df, thr, ["entity"], 4, 20).collect()}
    for name, x in (("low", 0.3), ("never", 9.0)):
        flags = df.withColumn("pred", (F.col("score") > x).cast("int"))
        truth, found = prep.segments(flags, keys=["entity"]), prep.segments(flags, F.col("pred") == 1, ["entity"])
        for r in detect.event_overlap(truth, found, ["entity"]).collect():
            assert (r.precision, r.recall, r.f1) == pytest.approx(tuple(got[r.entity, name, f"event_{c}"] for c in ("precision", "recall", "f1")))
        for r in detect.detection_delay(flags, ["entity"]).collect():
            assert (r.mean_delay, r.found) == pytest.approx((got[r.entity, name, "mean_delay"], got[r.entity, name, "segments_found"]))
        for r in proximity.pate_f1(flags, ["entity"], 4, 4).collect():
            assert r.pate_f1 == pytest.approx(got[r.entity, name, "pate_f1"])
        ends = [s.select("entity", "start", (F.col("stop") + 1).alias("stop")) for s in (truth, found)]
        lengths = df.groupBy("entity").agg(F.count("*").alias("n"))
        for r in catalog.affiliation(*ends, lengths, ["entity"]).collect():
            assert r.recall == pytest.approx(got[r.entity, name, "affiliation_recall"]) and r.f1 == pytest.approx(got[r.entity, name, "affiliation_f1"])
    for r in volume.surface(df, ["entity"], 4, 20).collect():
        assert (r.vus_roc, r.vus_pr) == pytest.approx((got[r.entity, "free", "vus_roc"], got[r.entity, "free", "vus_pr"]))


def test_strategies_need_no_adjusted_scores_and_null_scores_reach_no_cut(spark, cases):
    df = points(spark, {k: cases[k] for k in ("k0", "k3")}).select("entity", "t", "label", "score")
    keyed = lambda out: {(r.entity, r.variant, r.strategy): r.thr for r in out.collect()}
    alone = keyed(volume.strategies(df, df, None, ["entity"], 0.9, 0.2))
    both = keyed(volume.strategies(df, df, df, ["entity"], 0.9, 0.2))
    assert len(both) == 2 * len(alone) == 16 and all(both[e, v, s] == x for (e, _, s), x in alone.items() for v in ("raw", "adjusted"))
    cuts = spark.sql("SELECT array(3D, 2D, 1D) AS thr, explode(array(3D, 2.5D, 0D, NULL)) AS score")
    assert [r.b for r in cuts.select(proximity.first_reached(F.col("thr"), F.col("score"), 3).alias("b")).collect()] == [0, 1, 3, 3]
