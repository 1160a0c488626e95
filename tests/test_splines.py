"""Splines as tables and spans moved to their inflections, against dense algebra and the rules as they are written."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions import bsplines, kernels
from thalweg.operators import inflections, lines, scale_tree, splines
from thalweg.plans import catalogue, signals


def line(n, seed=3):
    rng = np.random.default_rng(seed)
    s = np.cumsum(rng.uniform(0.5, 2, n))
    return s, 1e6 + 10 * np.sin(s / 5) + rng.normal(0, 0.3, n), s + rng.normal(0, 0.3, n)


@pytest.fixture(scope="module")
def rivers(spark):
    """Rivers of 1, 2, 3, 40 and 90 points, the last with a repeated s."""
    data = {r: line(n, r) for r, n in enumerate((1, 2, 3, 40, 90))}
    rows = [(r, i, float(s[i]), float(x[i]), float(y[i])) for r, (s, x, y) in data.items() for i in range(len(s))]
    rows += [(4, 90, rows[-1][2], 0.0, 0.0)]
    return data, spark.createDataFrame(rows, "river_id long, idx long, s double, x double, y double").cache()


def value(row, at):
    return sum(c * (at - row["low"]) ** k for k, c in enumerate(row["c"]))


def pieces(table):
    out = {}
    for r in table.orderBy("low").collect():
        out.setdefault((r.river_id, r.dim), []).append(r)
    return out


def read(rows, at):
    return np.array([value(next((r for r in reversed(rows) if r["low"] <= x), rows[0]), x) for x in at])


@pytest.mark.parametrize("order", splines.ORDERS)
def test_splines_of_every_order_pass_all_points(rivers, order):
    data, points = rivers
    got = pieces(splines.fitted(points, order))
    assert set(got) == {(r, d) for r in (1, 2, 3, 4) for d in "xy"}
    for (r, d), rows in got.items():
        s, v = data[r][0], data[r]["xy".index(d) + 1]
        assert np.allclose(read(rows, s), v, atol=1e-6)
        k = min(order, len(s) - 1)
        for a, b in zip(rows, rows[1:]):  # derivatives below the order run through
            for n in range(k):
                left = sum(c * math.perm(m, n) * (b["low"] - a["low"]) ** (m - n) for m, c in enumerate(a["c"]) if m >= n)
                assert math.isclose(left, b["c"][n] * math.factorial(n), rel_tol=1e-6, abs_tol=1e-5)


def test_cubic_tables_equal_the_resampled_line(rivers):
    _, points = rivers
    line_ = lines.resampled(points)
    table = splines.fitted(points)
    got = splines.at_stations(table, line_.select("river_id", "k", "s"), derivatives=(0, 1, 2))
    both = got.join(line_.drop("s").withColumnsRenamed({c: f"w_{c}" for c in ("x", "y", "dxds", "dyds", "d2xds2", "d2yds2")}), ["river_id", "k"]).collect()
    assert len(both) == line_.count()
    assert all(math.isclose(r[c], r[f"w_{c}"], rel_tol=1e-9, abs_tol=1e-6) for r in both for c in ("x", "y", "dxds", "dyds", "d2xds2", "d2yds2"))


@pytest.mark.parametrize("order", (2, 3))
def test_smoothing_splines_meet_their_residual_with_few_knots(rivers, order):
    data, points = rivers
    smooth = 0.15
    got = pieces(splines.fitted(points, order, smooth, per_point=True))
    for (r, d), rows in got.items():
        s, v = data[r][0], data[r]["xy".index(d) + 1]
        n, residual = len(s), ((read(rows, s) - v) ** 2).sum()
        if n <= order + 1:
            assert residual < 1e-8
        elif len(rows) > 1:
            assert abs(residual - smooth * n) <= 1.1e-3 * smooth * n
            if order > 1:
                assert len(rows) < n / 2
            # of all splines on these knots with that residual it has the least jumps: the penalised problem, solved densely
            t = bsplines.padded(np.array([p["low"] for p in rows[1:]]), s[0], s[-1], order)
            j = np.clip(np.searchsorted(t, s, side="right") - 1, order, len(t) - order - 2)
            dense, parts = np.zeros((n, len(t) - order - 1)), bsplines.basis(t, order, j, s)
            for i in range(n):
                dense[i, j[i] - order : j[i] + 1] = parts[i]
            top = [bsplines.powers(t, order, e)[:, order] for e in np.eye(dense.shape[1])]
            jumps = np.diff(np.array(top), axis=1).T
            low, high, w = -60.0, 60.0, v - v.mean()
            for _ in range(100):
                mid = (low + high) / 2
                c = np.linalg.lstsq(np.vstack([dense, math.exp(mid / 2) * jumps]), np.concatenate([w, np.zeros(len(jumps))]), rcond=None)[0]
                low, high = (mid, high) if ((w - dense @ c) ** 2).sum() < residual else (low, mid)
            assert np.allclose(dense @ c + v.mean(), read(rows, s), atol=2e-3)
        else:  # one polynomial does it
            assert residual <= smooth * n * 1.002
            assert np.allclose(read(rows, s), np.polyval(np.polyfit(s, v - v.mean(), order), s) + v.mean(), atol=1e-4)


def test_knots_go_where_the_line_is_off():
    assert bsplines.new_knots([1, 10], [8, 10], [1.0, 9.0], 1) == [10]
    assert bsplines.new_knots([1, 10], [8, 9], [1.0, 9.0], 1) == [5]  # no point inside the second
    assert sorted(bsplines.new_knots([1], [7], [4.0], 3)) == [2, 4, 6]
    assert bsplines.new_knots([3], [2], [4.0], 3) == []


def test_extensions_and_steps(spark, rivers):
    _, points = rivers
    table = splines.fitted(points.where("river_id = 3"), order=1)
    ends = points.where("river_id = 3").agg(F.min("s"), F.max("s")).first()
    at = spark.createDataFrame([(3, 0, ends[0] - 1), (3, 1, ends[1] + 1), (99, 0, 0.0)], "river_id long, k long, s double")
    zeros = splines.at_stations(table, at, ext=1).collect()
    assert {r.k for r in zeros} == {0, 1} and all(r.x == r.y == 0 for r in zeros)
    with pytest.raises(Exception, match="beyond the ends"):
        splines.at_stations(table, at, ext=2).collect()
    with pytest.raises(ValueError):
        splines.evaluated(table, at, ext=4)
    with pytest.raises(ValueError):
        splines.fitted(points, order=6)
    with pytest.raises(ValueError):
        splines.fitted(points, smooth=-1.0)
    with pytest.raises(ValueError):
        lines.stations(points, "widest")
    with pytest.raises(Exception, match="needs every width"):
        lines.stations(points, "min_width").collect()
    wide = points.withColumn("w_m", F.lit(0.7) + F.col("idx") % 2)
    for rule in lines.STEPS:
        got = {r.river_id: r.n for r in lines.stations(wide, rule).groupBy("river_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        want = {r.river_id: r.n for r in lines.resampled(wide, rule).groupBy("river_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == want
    assert lines.resampled(wide.limit(0), order=1).count() == 0 and splines.fitted(wide.limit(0), smooth=1.0).count() == 0


def grown(s, c, a, b, low, high):
    """The windows as they are written: one point more at a time until a crossing lies inside."""
    n, up = len(s), np.array(c) > 0
    cross = lambda lo, hi: [s[i] - (s[i + 1] - s[i]) / (c[i + 1] - c[i]) * c[i] for i in range(max(0, lo), min(hi, n - 1)) if up[i] != up[i + 1]]
    middle, k = a + (b - a) // 2, 0
    while True:
        start = max(0, a - k)
        found = cross(start, middle)
        k += 1
        if found or a - k < 0:
            break
    left = found[0] if found else s[0]
    left, first = (left, start + 1) if start + 1 >= low else (s[a], a)
    k = 0
    while True:
        found = cross(middle, b + k)
        k += 1
        if found or b + k > n:
            break
    right = found[-1] if found else s[-1]
    right, last = (right, min(b + k, n - 1)) if b + k <= high else (s[b], b)
    return left, right, first, last


def test_inflections_equal_growing_windows(spark):
    rng = np.random.default_rng(8)
    points, spans, want = [], [], {}
    for r in range(40):
        n = int(rng.integers(2, 40))
        s, c = np.cumsum(rng.uniform(0.5, 2, n)), rng.normal(0, 1, n) + rng.choice([-2, 0, 0, 2])
        c[rng.random(n) < 0.2] = 0.0
        points += [(r, i, float(s[i]), None if c[i] == 0 and i % 2 else float(c[i])) for i in range(n)]
        for m in range(6):
            a, b = sorted(int(x) for x in rng.integers(0, n, 2))
            low, high = int(rng.integers(0, a + 1)), int(rng.integers(b, n))
            spans.append((r, m, a, b, low, high))
            want[r, m] = grown(s.tolist(), c.tolist(), a, b, low, high)
    p = spark.createDataFrame(points, "river_id long, idx long, s double, c double")
    q = spark.createDataFrame(spans, "river_id long, bend_id long, idx_start long, idx_end long, ext_start long, ext_end long")
    got = {(r.river_id, r.bend_id): (r.s_inf_left, r.s_inf_right, r.inf_start, r.inf_end) for r in inflections.refined(p, q).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)
    assert inflections.refined(p, q.limit(0)).count() == 0


def test_refined_nodes_of_whole_trees(spark, sf_dir):
    """Every node of the long transects' trees: extended spans by the kernel, inflections by growing windows, leaves by recursion."""
    tree, p = signals._river_tree(spark, sf_dir)
    river = {}
    for r in p.orderBy("river_id", "idx").collect():
        river.setdefault(r.river_id, []).append(r)
    nodes = {(r.river_id, r.node): r for r in tree.collect()}
    got = {(r.river_id, r.node): r for r in catalogue.queries()["refined_nodes"](spark, sf_dir).collect()}
    peaked = {k for k, r in nodes.items() if r.peak_row is not None}
    assert set(got) == peaked
    above = {}
    for k in peaked:
        up = nodes[k].parent
        while up >= 0 and (k[0], up) not in peaked:
            up = nodes[k[0], up].parent
        above[k] = (k[0], up) if up >= 0 else None
    leaves = peaked - set(above.values())
    below = {k: [] for k in peaked}
    for leaf in leaves:
        at = leaf
        while at is not None:
            below[at].append(leaf)
            at = above[at]
    for k, g in got.items():
        rows = river[k[0]]
        s, c = [r.s for r in rows], np.array([r.c for r in rows])
        a, b = g.bound_low, g.bound_high
        low, high = kernels.extended(c, a, b)
        assert (g.ext_start, g.ext_end) == (low, high)
        assert np.allclose((g.s_inf_left, g.s_inf_right, g.inf_start, g.inf_end), grown(s, c.tolist(), a, b, low, high))
        assert math.isclose(g.lambda_ext, s[high] - s[low], abs_tol=1e-9) and math.isclose(g.s_reach, s[-1])
        if k in leaves:
            assert (g.leaf_start, g.leaf_end) == (g.inf_start, g.inf_end)
        else:
            assert g.leaf_start == min(nodes[x].bound_low for x in below[k]) and g.leaf_end == max(nodes[x].bound_high for x in below[k])
    some = next(iter(river))
    xs = np.array([[r.s, r.x, r.y] for r in river[some]])
    for k, g in got.items():
        if k[0] == some:
            at = np.array([g.s_inf_left, g.s_inf_right])
            for c, v in (("x", xs[:, 1]), ("y", xs[:, 2])):
                assert np.allclose(kernels.spline(xs[:, 0], v, at)[0], [g[f"{c}_inf_left"], g[f"{c}_inf_right"]], atol=1e-6)
    spectra = scale_tree.leaf_spectra(spark.createDataFrame(list(got.values())[:20]), p, 1.0, 0.5)
    assert spectra.select("river_id", "node_id").distinct().count() == 20 and spectra.where("is_peak").count() > 0


@pytest.mark.parametrize("order", [1, 3, 5])
def test_series_are_smoothed_together(order):
    """A stack of series of equally many intervals gives what each gives alone, with the residual asked for."""
    rng, rows = np.random.default_rng(4), []
    for _ in range(5):
        s = np.sort(rng.uniform(0, 50, 60))
        t, v = bsplines.padded(s[[15, 30, 45]], s[0], s[-1], order), rng.normal(0, 10, 60)
        j = np.clip(np.searchsorted(t, s, side="right") - 1, order, len(t) - order - 2)
        parts, products, values = bsplines.basis(t, order, j, s), np.zeros((4, (order + 1) * (order + 2) // 2)), np.zeros((4, order + 1))
        for q, p, w in zip(j - order, parts, v, strict=True):
            products[q] += np.outer(p, p)[np.triu_indices(order + 1)]
            values[q] += p * w
        at = lambda c, j=j, parts=parts: (parts * c[j[:, None] - order + np.arange(order + 1)]).sum(axis=1)
        c = bsplines.solved(*(x[0] for x in bsplines.assembled(products[None], values[None], order)))
        rows.append((t, products, values, ((v - at(c)) ** 2).sum(), v, at))
    t, products, values, least = (np.array([r[i] for r in rows]) for i in range(4))
    asked = least * np.array([1.1, 1.2, 1.0, 1.05, 0.9])
    c = bsplines.smoothed(t, order, *bsplines.assembled(products, values, order), least, asked)
    for i, row in enumerate(rows):
        one = slice(i, i + 1)
        alone = bsplines.smoothed(t[one], order, *bsplines.assembled(products[one], values[one], order), least[one], asked[one])[0]
        assert np.allclose(c[i], alone, rtol=1e-9, atol=1e-9)
        assert ((row[4] - row[5](c[i])) ** 2).sum() == pytest.approx(max(asked[i], least[i]), rel=1e-6)


def test_rivers_of_few_points_are_smoothed_in_one_task(spark, monkeypatch):
    """Rivers that fit into an array need no rounds of jobs, and get the same splines as by these; also short ones, and with gaps and repeated s."""
    rng, rows = np.random.default_rng(5), []
    for r, n in enumerate([1, 2, 3, 4, 5, 6, 30, 31, 32, 80]):
        s = np.sort(np.round(rng.uniform(0, n, n), 1))
        rows += [(r, i, float(s[i]), None if r > 6 and i % 9 == 4 else float(i), float(rng.normal(0, 30))) for i in range(n)]
    p = spark.createDataFrame(rows, "river_id long, idx long, s double, x double, y double").repartition(4)

    def table():
        return {(t.river_id, t.dim, round(t.low, 9)): (t.high, *t.c) for t in splines.fitted(p, smooth=100.0, per_point=True).collect()}

    rounds = splines._smoothing
    monkeypatch.setattr(splines, "_smoothing", None)
    arrays = table()
    monkeypatch.setattr(splines, "_smoothing", rounds)
    monkeypatch.setattr(splines, "MOST_POINTS", 30, raising=False)
    both = table()
    assert len(arrays) > 60 and arrays.keys() == both.keys()
    assert all(np.allclose(arrays[k], both[k], rtol=1e-6, atol=1e-6) for k in arrays)
