"""Autocorrelations, prominences and periods against numpy and plain loops."""

import numpy as np
import pytest

from fleetseries.operators import spectral


def frame(spark, made, start=0):
    rows = [(k, "b", int(t) + start, float(x)) for k, xs in made.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "entity string, block string, t long, x double").drop("block")


def plain_acf(x):
    n = len(x)
    full = np.array([x[: n - k] @ x[k:] for k in range(n // 2 + 1)])
    return full / full[0]


def plain_prominence(v):
    out = {}
    for i in range(1, len(v) - 1):
        if v[i - 1] < v[i] > v[i + 1]:
            left = [j for j in range(i) if v[j] > v[i]]
            right = [j for j in range(i + 1, len(v)) if v[j] > v[i]]
            a, b = (left[-1] + 1 if left else 0), (right[0] if right else len(v))
            out[i] = v[i] - max(min(v[a:i], default=v[i]), min(v[i + 1 : b], default=v[i]))
    return out


@pytest.mark.parametrize("piece", [1 << 18, 16])
def test_acf_equals_numpy(spark, piece):
    rng = np.random.default_rng(3)
    made = {"a": rng.normal(size=300), "b": rng.normal(size=37), "c": np.ones(8), "d": np.array([2.0]), "zero": np.zeros(6), "e": rng.normal(size=1025)}
    got = spectral.acf_full(frame(spark, made, 5), ["entity"], "x", piece).collect()
    for k, x in made.items():
        own = {r.lag: r.acf for r in got if r.entity == k}
        assert sorted(own) == list(range(len(x) // 2 + 1))
        if k == "zero":
            assert set(own.values()) == {None}
        else:
            assert [own[i] for i in range(len(own))] == pytest.approx(plain_acf(x).tolist(), abs=1e-9)


def test_short_series_are_shuffled_as_points_alone(spark):
    points = spectral.sized(frame(spark, {"a": np.arange(50.0)}), ["entity"], "x", 2)
    plan = spectral.acf_short(points, ["entity"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "array<double>" not in plan


@pytest.mark.parametrize("step", [4096, 7, 2])
def test_prominences_equal_a_loop(spark, step):
    rng = np.random.default_rng(5)
    t = np.arange(200)
    made = {
        "walk": rng.normal(size=200).cumsum(), "noise": rng.normal(size=90), "decay": np.exp(-t / 40) * np.cos(t / 3), "grow": np.exp(t / 90) * np.cos(t / 3),
        "few": np.array([1.0, 3.0, 2.0]), "flat": np.array([1.0, 3.0, 3.0, 1.0, 2.0, 0.0]), "ties": np.round(rng.normal(size=150), 1), "fall": -np.arange(20.0),
    }
    got = spectral.prominences(frame(spark, made), ["entity"], "t", "x", step).collect()
    for k, v in made.items():
        assert {r.t: r.prominence for r in got if r.entity == k} == pytest.approx(plain_prominence(v), abs=1e-12)


def test_planted_periods_are_found_and_noise_is_not(spark):
    rng = np.random.default_rng(8)
    t = np.arange(1500)
    made = {f"p{p}": np.sin(2 * np.pi * t / p) + 0.3 * rng.normal(size=1500) for p in (48, 333, 400, 500)}
    made |= {"noise": rng.normal(size=1500), "walk": rng.normal(size=1500).cumsum(), "short": np.sin(np.arange(40.0)), "once": np.sin(2 * np.pi * t / 1400)}
    for k, x in made.items():
        line = np.polyval(np.polyfit(np.arange(len(x)), x, 1), np.arange(len(x)))
        made[k] = ((x - line) - (x - line).mean()) / (x - line).std()
    got = {r.entity: r for r in spectral.seasonal_periods(frame(spark, made), ["entity"], "x", 100).collect()}
    for p in (333, 400, 500):
        r = got[f"p{p}"]
        assert r.agree and abs(r.period - p) <= 0.02 * p and r.share > 0.05
        assert r.acf_at_day == pytest.approx(plain_acf(made[f"p{p}"])[100], abs=1e-9)
    assert not any(got[k].agree for k in ("noise", "short", "once"))
    nfft = 1 << int(np.ceil(np.log2(1500 * 8)))
    for k in ("p48", "noise", "walk", "once"):
        power = np.abs(np.fft.rfft(made[k], nfft)) ** 2
        place = np.arange(len(power))
        fit = (place > 0) & (nfft / np.maximum(place, 1) >= 30) & (nfft / np.maximum(place, 1) <= 750)
        best = place[fit][power[fit].argmax()]
        assert got[k].period_fft == round(nfft / best) and got[k].share == pytest.approx(power[best] / power[fit].sum(), rel=1e-6)
        own = {i: v for i, v in plain_prominence(plain_acf(made[k])[30:]).items() if v >= 1e-4}
        assert got[k].period_acf == (max(own, key=own.get) + 30 if own else None)
