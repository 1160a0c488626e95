"""The numeric kernels against closed forms and brute force."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from thalweg.functions import kernels as k
from thalweg.operators.scale_tree import build, pick


def test_spline_reproduces_a_cubic():
    s = np.array([0.0, 0.7, 1.1, 2.0, 3.5, 4.0])
    f = lambda t: 2 - t + 0.5 * t**2 - 0.25 * t**3
    at = np.linspace(0, 4, 37)
    v, d1, d2 = k.spline(s, f(s), at)
    assert np.allclose(v, f(at), atol=1e-10)
    assert np.allclose(d1, -1 + at - 0.75 * at**2, atol=1e-9)
    assert np.allclose(d2, 1 - 1.5 * at, atol=1e-8)


def test_chi_square_quantiles():
    assert abs(k.chi2_quantile(0.95, 2) - 5.991464547) < 1e-7
    assert abs(k.chi2_quantile(0.95, 1) - 3.841458821) < 1e-7


def test_sine_peaks_at_its_wavelength():
    t = np.arange(512)
    wave, scales = k.cwt(np.sin(2 * math.pi * t / 32), 1.0, 0.05)
    best = scales[np.argmax((np.abs(wave) ** 2).mean(axis=1))] * k.fourier_factor("DOG", 2.0)[0]
    assert abs(best - 32) < 2


def test_every_mother_transforms():
    for mother in ("MORLET", "PAUL", "DOG"):
        wave, scales = k.cwt(np.sin(np.arange(64.0)), 1.0, 0.25, mother=mother)
        assert wave.shape == (len(scales), 64) and np.isfinite(wave).all()


@settings(max_examples=60, deadline=None)
@given(hnp.arrays(float, st.integers(3, 40), elements=st.integers(0, 4).map(float)))
def test_peaks_are_local_maxima(v):
    found = set(k.peaks(v).tolist())
    for p in range(1, len(v) - 1):
        low = p
        while low > 0 and v[low - 1] == v[p]:
            low -= 1
        high = p
        while high < len(v) - 1 and v[high + 1] == v[p]:
            high += 1
        top = low > 0 and high < len(v) - 1 and v[low - 1] < v[p] and v[high + 1] < v[p]
        assert ((p in found) == (top and p == (low + high) // 2))


def test_prominence_needs_the_higher_low():
    v = np.array([0, 5, 4, 6, 0.0])
    assert k.prominent(v, 2).tolist() == [3]
    assert k.prominent(v, 1).tolist() == [1, 3]


def test_savgol_derivative_of_a_parabola():
    t = np.arange(20.0)
    assert np.allclose(k.savgol_derivative(t**2, 2, 5), 2 * t, atol=1e-9)


def test_smoothing_keeps_the_mean():
    v = np.sin(np.arange(50) / 5)
    assert abs(k.smooth(v, 1.0, 2, 5, 7).mean() - v.mean()) < 1e-9


def test_funneling_of_a_half_circle():
    a = np.linspace(math.pi, 0, 200)
    lobe, neck, ratio = k.funneling(np.cos(a), np.sin(a), 0, 199)
    assert abs(lobe - 2) < 1e-3 and abs(neck - 2) < 1e-3 and abs(ratio - 1) < 1e-3


def test_extended_bounds_reach_the_opposite_extremes():
    c = np.sin(np.arange(0, 4 * math.pi, 0.1))
    low, high = k.extended(c, 32, 62)
    assert abs(low - 16) <= 1 and abs(high - 78) <= 1


def test_extended_bounds_of_a_line_are_found_together():
    """As windows that grow one by one, with plateaus, for many bends of a line."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40, 90):
        for c in (rng.integers(-2, 3, n).astype(float), rng.normal(size=n)):
            a = np.sort(rng.integers(0, n, 12))
            b = np.minimum(n - 1, a + rng.integers(0, 9, 12))
            want = []
            for i, j in zip(a.tolist(), b.tolist()):
                v = -c if c[i : j + 1].max() > abs(c[i : j + 1].min()) else c
                ends = []
                for at, sign in ((i, -1), (j, 1)):
                    windows = ((max(0, at - r), at) if sign < 0 else (at, min(n - 1, at + r)) for r in (j - i + t * ((j - i) // 2) for t in range(11)))
                    held = next(((lo, hi) for lo, hi in windows if len(k.peaks(v[lo : hi + 1]))), None)
                    ends.append(at if held is None else held[0] + v[held[0] : held[1] + 1].tolist().index(v[held[0] + k.peaks(v[held[0] : held[1] + 1])].max()))
                want.append(tuple(ends))
            assert list(zip(*(x.tolist() for x in k.extended_all(c, a, b)))) == want


def test_tree_is_ordered_and_nested():
    t = np.arange(300)
    wave, _ = k.cwt(np.sin(t / 8) + np.sin(t / 40), 1.0, 0.25)
    nodes = build(wave.real)
    assert nodes and all(n["parent"] < n["node"] for n in nodes)
    assert all(n["row_top"] >= n["row_bottom"] for n in nodes)
    marks = pick([n["parent"] for n in nodes], [n["peak_pwr"] for n in nodes])
    assert any(marks)
    for i, m in enumerate(marks):
        at = nodes[i]["parent"]
        while m and at >= 0:
            assert not marks[at]
            at = nodes[at]["parent"]


def test_funneling_meets_all_levels_together():
    """Widths of a line's stretch above each level, held against a look at one level after the other."""
    rng = np.random.default_rng(3)
    for n in (3, 8, 50):
        u, v, levels = np.cumsum(rng.uniform(0, 1, n)), rng.normal(0, 5, n), np.linspace(0, 9, 200)
        inside, width, at_end = (np.concatenate(p) for p in zip(*k._widths(u, v, levels), strict=True))
        for i, level in enumerate(levels):
            above = np.flatnonzero(v >= level)
            assert inside[i] == bool(len(above))
            if len(above):
                assert width[i] == u[above[-1]] - u[above[0]] and at_end[i] == (above[0] == 0 or above[-1] == n - 1)
