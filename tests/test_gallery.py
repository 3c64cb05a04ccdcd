"""Nearest neighbours, reclustering and region rescoring against numpy."""

import numpy as np
import pytest

from fleetseries.operators import gallery


def vectors(spark, ids, v):
    rows = [(i, None if x is None else [float(y) for y in x], 1, 2.0) for i, x in zip(ids, v)]
    return spark.createDataFrame(rows, "id long, v array<double>, c int, gap double")


@pytest.mark.parametrize(("cells", "cell"), [(256, 4096), (12, 50), (1, 10)])
def test_nearest_equals_brute_force(spark, cells, cell):
    rng = np.random.default_rng(2)
    middle = 20 * rng.normal(size=(9, 6))
    g = middle[np.r_[np.zeros(500, int), rng.integers(9, size=400)]] + rng.normal(size=(900, 6))  # over half in one place
    g[700:720] = g[3]  # ties
    q = np.vstack([middle[rng.integers(9, size=60)] + rng.normal(size=(60, 6)), g[3], g[710], 500 * np.ones(6), np.zeros(6)])
    ids, names = rng.permutation(900), list(range(len(q)))
    asked, held = vectors(spark, [*names, None, 999], [*q, q[0], None]), vectors(spark, [*ids.tolist(), None], [*g, g[0]])
    got = {r.id: r for r in gallery.nearest_in_gallery(asked, held, cells, cell).collect()}
    assert sorted(got) == names
    for k, x in enumerate(q):
        d = np.sqrt(((g - x) ** 2).sum(1))
        assert got[k].rmse == pytest.approx(d.min() / np.sqrt(6), abs=1e-9)
        assert got[k].nearest == min(ids[np.isclose(d, d.min(), atol=1e-12)])
    if cells > 1:  # most of the pairs are never looked at
        assert sum(r.seen for r in got.values()) < 0.5 * len(q) * len(g)
    assert gallery.nearest_in_gallery(asked, held.limit(0)).count() == 0


def plain_recluster(points, weights, old, steps):
    seeds = [int(np.argmax(weights))]
    far = ((points - points[seeds[0]]) ** 2).sum(1)
    while len(seeds) < min(len(old), len(points)):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[seeds[-1]]) ** 2).sum(1))
    c = points[seeds].copy()
    near = lambda: ((points[:, None] - c[None]) ** 2).sum(2).argmin(1)
    for _ in range(steps):
        k = near()
        for j in range(len(c)):
            if (k == j).any():
                c[j] = np.average(points[k == j], axis=0, weights=weights[k == j])
    n = np.bincount(near(), weights, len(c))
    cost, out = ((c[:, None] - old[None]) ** 2).sum(2), {s: (old[s], 0.0) for s in range(len(old))}
    for _ in range(len(c)):
        i, s = np.unravel_index(cost.argmin(), cost.shape)
        out[int(s)] = (c[i], n[i])
        cost[i], cost[:, s] = np.inf, np.inf
    return out


@pytest.mark.parametrize("clients", [1, 5])
def test_recluster_keeps_rare_codes_and_slots(spark, clients):
    rng = np.random.default_rng(7)
    old = rng.normal(size=(8, 3)) * 5
    rows, points, weights = [], [], []
    for client in range(clients):
        for code in range(8):
            n = int(rng.integers(0, 60))
            m = (old[code] + rng.normal(size=3)) * n
            if client == 0 and code == 2:
                n, m = 4, np.array([400.0, -400, 80])  # rare and far from all others
            rows.append((f"k{client}", code, n, m.tolist()))
            if n >= 3:
                points.append(m / n)
                weights.append(float(n))
    stats = spark.createDataFrame(rows, "client string, code int, n long, m array<double>")
    book = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(old)], "slot int, c array<double>")
    got = {r.slot: r for r in gallery.recluster(stats, book, 3.0).collect()}
    want = plain_recluster(np.array(points), np.array(weights), old, 5)
    for s, (c, n) in want.items():
        assert got[s].c == pytest.approx(c.tolist()) and got[s].n == pytest.approx(n)
    assert any(r.c == pytest.approx([100, -100, 20]) for r in got.values())
    none = {r.slot: r for r in gallery.recluster(stats.limit(0), book, 3.0).collect()}
    assert all(none[k].c == pytest.approx(c.tolist()) and none[k].n == 0 for k, c in enumerate(old))


def test_regions_equal_full_reassembly(spark):
    rng = np.random.default_rng(4)
    width, n = 8, 400
    raw = {(e, c): rng.random(n) * 5 for e in "ab" for c in (0, 1)}
    spans = {"a": [(10, 14), (100, 180), (395, 399)], "b": [(0, 3), (50, 50), (300, 310)]}
    changes = [(e, c, v, s, (-rng.random(width) * 4).tolist()) for e, c, v, s in (("a", 0, 0, 8), ("a", 1, 0, 8), ("a", 0, 0, 12), ("a", 0, 1, 98), ("a", 1, 1, 178), ("a", 0, 0, 392), ("b", 0, 0, 0), ("b", 1, 1, 47), ("b", 0, 1, 305))]
    kept = spark.createDataFrame([(e, c, t, float(x)) for (e, c), xs in raw.items() for t, x in enumerate(xs)], "entity string, channel int, t long, raw double")
    deltas = spark.createDataFrame(changes, "entity string, channel int, kind int, w_start long, d array<double>")
    events = spark.createDataFrame([(e, a, b) for e, own in spans.items() for a, b in own], "entity string, start long, stop long")
    thresholds = spark.createDataFrame([("a", 5.5), ("b", 5.0)], "entity string, thr double")

    def final(e, kind):
        out = []
        for c in (0, 1):
            x = raw[e, c].copy()
            for d in changes if kind is not None else []:
                if (d[0], d[1], d[2]) == (e, c, kind):
                    x[d[3] : d[3] + width] += np.array(d[4])[: n - d[3]]
            out.append([0.5 * (x[t] + x[max(0, t - width // 2) : t + width // 2].mean()) for t in range(n)])
        return np.max(out, axis=0)

    want, flags = {}, {0: [], 1: []}
    for kind in (0, 1):
        for e, own in spans.items():
            for a, b in own:
                if any(d[0] == e and d[2] == kind and d[3] <= b and d[3] + width - 1 >= a for d in changes):
                    want[e, kind, a] = (final(e, None)[a : b + 1].max(), final(e, kind)[a : b + 1].max())
                    flags[kind].append(float(want[e, kind, a][1] < {"a": 5.5, "b": 5.0}[e]))
    met = gallery.touched(events, deltas, ["entity"], ["kind"])
    got = {(r.entity, r.kind, r.start): (r.before, r.after) for r in gallery.rescored(kept, deltas, met, width, ["entity"], ["kind"]).collect()}
    assert sorted(got) == sorted(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])
    rates = {r.kind: (r.validity, r.spread, r.n_events) for r in gallery.region_validity(kept, deltas, events, thresholds, width, ["entity"], ["kind"]).collect()}
    for kind in (0, 1):
        assert rates[kind] == pytest.approx((np.mean(flags[kind]), np.std(flags[kind]), len(flags[kind])))
