"""Whole results of the queries that have no SQL, against plain Python on the smallest tables."""

import math

import numpy as np
import pytest

from thalweg.functions import kernels
from thalweg.operators import scale_tree, spectral
from thalweg.plans import catalogue, signals
from thalweg.plans import standins as st
from thalweg.plans.geometry import curved, transects


def run(spark, sf_dir, name):
    return [r.asDict() for r in catalogue.queries()[name](spark, sf_dir).collect()]


def by_river(frame, *columns):
    out = {}
    for r in frame.orderBy("river_id", "idx").collect():
        out.setdefault(r.river_id, []).append([r[c] for c in columns])
    return {k: np.array(v, float).T for k, v in out.items()}


def dense_spline(s, v):
    """Coefficients of the cubic pieces with continuous third derivatives at the second and last but one knot."""
    n = len(s) - 1
    if n < 3:
        return None
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for i in range(n):
        h = s[i + 1] - s[i]
        for t, value in ((0.0, v[i]), (h, v[i + 1])):
            a[row, 4 * i : 4 * i + 4] = [1, t, t * t, t**3]
            b[row] = value
            row += 1
        if i < n - 1:
            a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 5] = [0, 1, 2 * h, 3 * h * h], -1
            a[row + 1, 4 * i : 4 * i + 4], a[row + 1, 4 * i + 6] = [0, 0, 2, 6 * h], -2
            row += 2
    for i in (0, n - 2):
        a[row, 4 * i + 3], a[row, 4 * i + 7] = 1, -1
        row += 1
    return np.linalg.solve(a, b).reshape(n, 4)


def test_resampled_splines(spark, sf_dir):
    points, got = by_river(transects(spark, sf_dir), "s", "x", "y"), {}
    for r in run(spark, sf_dir, "resample_spline"):
        got.setdefault(r["river_id"], []).append(r)
    checked = 0
    for river, (s, x, y) in points.items():
        if len(s) < 4:
            continue
        step = math.exp(np.log(np.diff(s)).mean())
        rows = sorted(got[river], key=lambda r: r["k"])
        assert len(rows) == math.ceil((s[-1] + step / 2 - s[0]) / step - 1e-9)
        for c, v in (("x", x), ("y", y)):
            p = dense_spline(s, v)
            for k, r in enumerate(rows):
                at = s[0] + k * step
                i = int(min(len(s) - 2, max(0, np.searchsorted(s, at, side="right") - 1)))
                t = at - s[i]
                want = (p[i] @ [1, t, t * t, t**3], p[i] @ [0, 1, 2 * t, 3 * t * t], p[i] @ [0, 0, 2, 6 * t])
                assert np.allclose((r[c], r[f"d{c}ds"], r[f"d2{c}ds2"]), want, rtol=1e-5, atol=1e-4 * max(1, np.abs(v).max()))
        checked += 1
    assert checked >= 15


def test_smoothed_lines(spark, sf_dir):
    points, got = by_river(transects(spark, sf_dir), "s", "x", "y"), {}
    for r in run(spark, sf_dir, "smooth_savgol"):
        got.setdefault(r["river_id"], {})[r["k"]] = r
    for river, (s, x, y) in points.items():
        for c, v in (("x", x), ("y", y)):
            n, ds = len(v), np.diff(s).mean() if len(s) > 1 else 1.0
            want = v
            if n > 9:
                slope = []
                for i in range(n):  # the parabola through the five points around, at the ends through the outer five
                    low = min(max(0, i - 2), n - 5)
                    p = np.polyfit(np.arange(low, low + 5) - i, v[low : low + 5], 2)
                    slope.append(p[1] / ds)
                weight = np.array([math.exp(-((2.7 * t / 4) ** 2) / 2) for t in range(-4, 5)])
                weight /= weight.sum()
                wide = [*slope[::-1], *slope, *slope[::-1]]
                faded = []
                for i in range(n, 2 * n):
                    faded.append(sum(weight[k + 4] * wide[i + k] for k in range(-4, 5)))  # both ways give one value: the kernel is even
                total = [0.0]
                for i in range(1, n):
                    total.append(total[-1] + (faded[i] + faded[i - 1]) / 2 * ds)
                want = np.array(total) + np.mean(v - np.array(total))
            assert np.allclose([got[river][k][f"{c}_smooth"] for k in range(n)], want, atol=1e-5 * max(1, np.abs(v).max()))


def plain_peaks(v):
    out, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def test_extended_bounds(spark, sf_dir):
    c = {k: np.nan_to_num(v[0]) for k, v in by_river(curved(spark, sf_dir), "c").items()}
    rows = run(spark, sf_dir, "extended_bounds")
    spans = {(r["river_id"], r["bend_id"]): r for r in run(spark, sf_dir, "bend_table")}
    assert len(rows) > 100
    for r in rows:
        a, b = (int(spans[r["river_id"], r["bend_id"]][k]) for k in ("idx_start", "idx_end"))
        own = c[r["river_id"]]
        part = own[a : b + 1]
        v = -own if part.max() > -part.min() else own
        want = []
        for at, sign in ((a, -1), (b, 1)):
            found, reach = at, b - a
            for _ in range(11):
                low, high = (max(0, at - reach), at) if sign < 0 else (at, min(len(v) - 1, at + reach))
                tops = plain_peaks(v[low : high + 1])
                if tops:
                    top = max(v[low + p] for p in tops)
                    found = low + [i for i in range(high - low + 1) if v[low + i] == top][0]
                    break
                reach += (b - a) // 2
            want.append(found)
        assert [r["ext_start"], r["ext_end"]] == want


def funnel(p, first, last):
    """(lobe, neck, ratio) of a bend; its ends count as so much higher."""
    (x0, y0), (x1, y1) = p[0], p[-1]
    turn = complex(x1 - x0, y1 - y0)
    turn = turn / abs(turn) if turn else 1j
    if turn.real < 0 or (turn.real == 0 and turn.imag < 0):
        turn = -turn
    z = [complex(x - x0, y - y0) / turn for x, y in p]
    side, ahead = -1 if z[(len(z) - 1) // 2].imag < 0 else 1, -1 if z[-1].real < 0 else 1
    line = [(ahead * w.real, side * w.imag) for w in z]
    s = [0.0]
    for (a, b), (c, d) in zip(line, line[1:]):
        s.append(s[-1] + math.hypot(c - a, d - b))
    n, pts = math.ceil(1.5 * len(line)), []
    for k in range(n):
        at = s[-1] * k / (n - 1)
        i = max(j for j in range(len(s) - 1) if s[j] <= at + 1e-12)
        f = min(1.0, (at - s[i]) / (s[i + 1] - s[i]))
        pts.append(tuple(line[i][d] + f * (line[i + 1][d] - line[i][d]) for d in (0, 1)))
    above = lambda level: [q for q in range(n) if pts[q][1] + (first if q == 0 else last if q == n - 1 else 0) >= level]
    neck, low, high = 1e9, min(v for _, v in pts), max(v for _, v in pts)
    for k in range(195):
        inside = above(low * k / 199)
        if inside:
            neck = min(neck, pts[inside[-1]][0] - pts[inside[0]][0])
            if inside[0] == 0 or inside[-1] == n - 1:
                break
    lobe = max([0.0, *(pts[i[-1]][0] - pts[i[0]][0] for i in (above(high * k / 199) for k in range(200)) if i)])
    return (lobe, neck, lobe / neck) if neck not in (0.0, 1e9) and lobe / neck >= 1e-5 else (None, None, None)


def test_funneling(spark, sf_dir):
    """The ends of a bend lie on the level of the chord, so the last digit decides on which side of it."""
    bends, wrong = {}, []
    for r in st.bend_points(spark, sf_dir).orderBy("river_id", "bend_id", "idx").collect():
        bends.setdefault((r.river_id, r.bend_id), []).append((r.x, r.y))
    close = lambda g, w: g is None and w is None or (g is not None and w is not None and math.isclose(g, w, rel_tol=1e-6, abs_tol=1e-8))
    rows = run(spark, sf_dir, "funneling")
    for r in rows:
        p, got = bends[r["river_id"], r["bend_id"]], (r["L_l"], r["L_n"], r["FF"])
        wants = [funnel(p, a, b) for a in (1e-9, -1e-9) for b in (1e-9, -1e-9)] if len(p) > 2 else [(None, None, None)]
        if not any(all(map(close, got, want)) for want in wants):
            wrong.append((p, got, wants))
    assert len(rows) == len(bends) and len(wrong) <= 0.02 * len(rows), wrong[:2]


def test_spectrum_cuts(spark, sf_dir):
    """The minima of the power of all scales, their prominence found by walking outwards."""
    got = {}
    for r in run(spark, sf_dir, "spectrum_cuts"):
        got.setdefault(r["river_id"], []).append(r["cut"])
    for r in spectral.signals(st.lineitems(spark, sf_dir), "y").collect():
        power = (np.abs(kernels.cwt(np.array(r.signal, float), 1.0, 0.25, None, "MORLET", 2.0)[0]) ** 2).sum(axis=0)
        v, want = -power, []
        for p in plain_peaks(v):
            lows = []
            for step in (-1, 1):
                i, low = p, v[p]
                while 0 <= i < len(v) and v[i] <= v[p]:
                    low, i = min(low, v[i]), i + step
                lows.append(low)
            if v[p] - max(lows) >= np.std(power):
                want.append(p)
        assert sorted(got.get(r.river_id, [])) == want


def test_scale_trees(spark, sf_dir):
    """Every node: its place in the tree, and its peak the strongest extremum of its row inside its bounds."""
    factor = kernels.fourier_factor("DOG", 2.0)[0]
    waves = {r.river_id: kernels.cwt(np.array(r.signal, float), 1.0, 0.25) for r in st.signals(spark, sf_dir).collect()}
    trees = {}
    for r in run(spark, sf_dir, "scale_tree_nodes"):
        trees.setdefault(r["river_id"], {})[r["node"]] = r
    assert set(trees) == set(waves)
    for river, nodes in trees.items():
        wave, scales = waves[river][0].real, waves[river][1]
        children = [r["parent"] for r in nodes.values()]
        for k, r in nodes.items():
            up = nodes.get(r["parent"])
            assert (up is None) == (r["parent"] == -1) and r["n_child"] == children.count(k) and r["col_min"] <= r["col_max"]
            assert (r["root"], r["depth"]) == ((up["root"], up["depth"] + 1) if up else (k, 0)) and r["parent"] < k and r["row_bottom"] <= r["row_top"]
            if r["peak_row"] is None:
                assert r["peak_pwr"] is None
                continue
            i, j = r["peak_row"], r["peak_col"]
            assert r["bound_low"] <= j <= r["bound_high"] and r["row_bottom"] <= i <= r["row_top"]
            assert math.isclose(r["peak_pwr"], wave[i, j] ** 2, rel_tol=1e-9) and math.isclose(r["wavelength"], factor * scales[i], rel_tol=1e-9)

            def extreme(a, b):
                a, b = min(max(a, 1), wave.shape[0] - 2), min(max(b, 1), wave.shape[1] - 2)
                ring = [wave[a - 1, b - 1], wave[a, b - 1], wave[a + 1, b], wave[a + 1, b + 1], wave[a, b + 1], wave[a - 1, b]]
                return all(x > wave[a, b] for x in ring) or all(x <= wave[a, b] for x in ring)

            own = [wave[i, b] ** 2 for b in range(r["bound_low"], r["bound_high"] + 1) if extreme(i, b)]
            assert own and math.isclose(max(own), r["peak_pwr"], rel_tol=1e-9)


def test_detected_bends(spark, sf_dir):
    """On each way from a root to a leaf the strongest node, by lists of ways."""
    trees, got = {}, {}
    for r in run(spark, sf_dir, "scale_tree_nodes"):
        trees.setdefault(r["river_id"], {})[r["node"]] = r
    for r in run(spark, sf_dir, "detected_bends"):
        got.setdefault(r["river_id"], set()).add(r["node"])
    for river, nodes in trees.items():
        def way(k):
            out = []
            while k >= 0:
                if nodes[k]["peak_pwr"] is not None:
                    out.append(k)
                k = nodes[k]["parent"]
            return out[::-1]

        ways = [way(k) for k in nodes if nodes[k]["peak_pwr"] is not None]
        inner = {k for w in ways for k in w[:-1]}
        ways = [w for w in ways if w[-1] not in inner and len(w) > 1]
        gone = set()
        while True:
            chosen, new = set(), set(gone)
            for w in ways:
                left = [k for k in w if k not in new]
                best = max(left, key=lambda k: (nodes[k]["peak_pwr"], -k))
                chosen.add(best)
                new |= set(left[: left.index(best)])
            if new == gone:
                break
            gone = new
        assert got.get(river, set()) == {k for k in chosen if not any(k in w and c in w[: w.index(k)] for w in ways for c in chosen)} if ways else not got.get(river)


@pytest.fixture(scope="module")
def river_tree(spark, sf_dir):
    tree, points = signals._river_tree(spark, sf_dir)
    return tree, by_river(points, "s", "x", "y", "c")


def test_placed_nodes(spark, sf_dir, river_tree):
    tree, points = river_tree
    peaked = {(r.river_id, r.node): r for r in tree.collect() if r.peak_row is not None}
    got = {(r["river_id"], r["node"]): r for r in run(spark, sf_dir, "placed_nodes")}
    assert set(got) == set(peaked)
    for key, r in got.items():
        s, x, y, c = points[key[0]]
        a, b = r["bound_low"], r["bound_high"]
        top = a + int(np.argmax(np.abs(c[a : b + 1])))
        want = {"lambda": s[b] - s[a], "l": math.hypot(x[b] - x[a], y[b] - y[a]), "idx_c_max": top, "s_c_max": s[top], "c_c": c[top], "s_c": s[r["peak_col"]]}
        assert all(math.isclose(r[k], v, rel_tol=1e-7, abs_tol=1e-7) for k, v in want.items())
        ds = (s[-1] - s[0]) / (len(s) - 1)
        half = peaked[key].wavelength * ds / 2
        assert math.isclose(r["radius"], abs(half / (2 * math.pi) - 1), rel_tol=1e-7)
        if r["r_x"] is not None and not math.isnan(r["r_x"]):
            assert math.isclose(math.hypot(r["r_x"], r["r_y"]), 1, rel_tol=1e-6)
            span = round(half / 4 / ds)
            low, high = max(0, r["peak_col"] - span), min(len(s) - 1, r["peak_col"] + span)
            mid = (low + high) // 2
            assert math.isclose(math.hypot(r["x_c"] - x[mid], r["y_c"] - y[mid]), half / (2 * math.pi), rel_tol=1e-6)


def test_meander_database(spark, sf_dir, river_tree):
    tree, points = river_tree
    spans = {(r.river_id, r.node): (r.bound_low, r.bound_high) for r in scale_tree.detected(tree).collect()}
    rows = run(spark, sf_dir, "meander_database")
    assert {(r["river_id"], r["bend_id"]) for r in rows} == {k for k, (a, b) in spans.items() if b - a >= 2}
    for r in rows:
        a, b = spans[r["river_id"], r["bend_id"]]
        s, x, y, c = (v[a : b + 1] for v in points[r["river_id"]])
        steps = np.hypot(np.diff(x), np.diff(y))
        chord = math.hypot(x[-1] - x[0], y[-1] - y[0])
        top = int(np.argmax(np.abs(c)))
        want = {"lambda_fm": steps.sum(), "L_fm": chord, "s_start": s[0], "s_end": s[-1], "s_middle": s[0] + (s[-1] - s[0]) / 2, "x_start": x[0], "y_end": y[-1], "c_max": c[top], "s_c_max": s[top]}
        assert all(math.isclose(r[k], v, rel_tol=1e-7, abs_tol=1e-7) for k, v in want.items())
        assert r["curvature_side"] == np.sign(c[top])


def test_marked_inflections(spark, sf_dir):
    """Inside their bend, in order; a bend of fewer than five points has its ends."""
    bends = {}
    for r in st.bend_points(spark, sf_dir).orderBy("river_id", "bend_id", "idx").collect():
        bends.setdefault((r.river_id, r.bend_id), []).append(r.s)
    rows = run(spark, sf_dir, "marked_inflections")
    assert {(r["river_id"], r["bend_id"]) for r in rows} == set(bends)
    for r in rows:
        s = bends[r["river_id"], r["bend_id"]]
        assert s[0] - 1e-9 <= r["s_inf_start"] <= r["s_inf_end"] <= s[-1] + 1e-9
        if len(s) < 5:
            assert (r["s_inf_start"], r["s_inf_end"]) == (s[0], s[-1])


def test_rivers_are_added_from_tables(spark):
    from thalweg.api import Rivers

    rows = [(g, k, k * 1.0 + (k % 3) * 0.1, math.sin(k / 5), 1.5 + 0.1 * k, str(k // 4), k) for g in (1, 2) for k in range(40)]
    points = spark.createDataFrame(rows, "river_id long, idx long, x double, y double, w_m double, comid string, so long")
    out = Rivers.added(points)
    got = by_river(out.points.withColumn("number", out.points.comid.cast("double")), "s", "x", "w_m", "number", "so", "c")
    s = got[1][0]
    assert np.allclose(np.diff(s), 1.5) and set(got[1][3]) <= set(range(10)) and (np.diff(got[1][4]) >= 0).all() and np.isfinite(got[1][5]).all()
    assert out.inflections().count() > 4 and Rivers.added(points, scale_by_width=True).points.count() == out.points.count()
    with pytest.raises(ValueError):
        Rivers.added(points.drop("y"))
    with pytest.raises(ValueError):
        Rivers(points).with_distances().resampled("widest")
