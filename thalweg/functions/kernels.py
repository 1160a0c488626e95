"""Small numeric kernels that run inside Arrow batches, one signal or line at a time.

Implements the numeric parts of: W14, W16-W19, W22, W23, W25, A8, C1, C4, C5, X17.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from thalweg.functions.scalar import MOTHERS, fourier_factor


def daughter(mother: str, k: np.ndarray, scales: np.ndarray, dt: float, m: float) -> np.ndarray:
    """The wavelet in Fourier space at every scale (rows), normalised to unit energy."""
    sk = scales[:, None] * k[None, :]
    norm = np.sqrt(2 * math.pi * scales / dt)[:, None]
    up = k[None, :] > 0
    if mother == "MORLET":
        return norm * math.pi**-0.25 * np.where(up, np.exp(-((sk - m) ** 2) / 2), 0.0)
    if mother == "PAUL":
        return norm * 2**m / math.sqrt(m * math.factorial(int(2 * m - 1))) * np.where(up, np.abs(sk) ** m * np.exp(-np.abs(sk)), 0.0)
    return -norm * (1j**m) / math.sqrt(math.gamma(m + 0.5)) * sk**m * np.exp(-(sk**2) / 2)


def _daughter(mother: str, n: int, dt: float, scales: tuple[float, ...], m: float) -> np.ndarray:
    """``daughter`` at the frequencies of ``n`` points."""
    k = 2 * math.pi * np.fft.fftfreq(n, dt)
    if n % 2 == 0:
        k[n // 2] *= -1  # the highest frequency counts as positive
    return daughter(mother, k, np.array(scales), dt, m)


#: Signals of a table are padded to few lengths; 8 blocks of 32 scales take 16 MB at most.
_kept_daughter = lru_cache(maxsize=8)(_daughter)


def scale_count(n: int, dt: float, s0: float, dj: float) -> int:
    return int(math.floor(math.log2(n * dt / s0) / dj)) + 1


def cwt(y: np.ndarray, dt: float, dj: float, s0: float | None = None, mother: str = "DOG", m: float | None = None, pad: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(wave, scales) of a signal, its mean removed, zero-padded to a power of two."""
    n = len(y)
    s0, m = s0 or 2 * dt, MOTHERS[mother] if m is None else m
    scales = s0 * 2.0 ** (dj * np.arange(scale_count(n, dt, s0, dj)))
    x = y - y.mean()
    if pad:
        x = np.concatenate([x, np.zeros(2 ** int(math.floor(math.log2(n) + 0.4999) + 1) - n)])
    f = np.fft.fft(x)
    wave = np.empty((len(scales), n), complex)
    for low in range(0, len(scales), 32):  # blocks of scales bound the memory of long signals
        part = slice(low, low + 32)
        wave[part] = np.fft.ifft(f[None, :] * (_kept_daughter if len(x) <= 4096 else _daughter)(mother, len(x), dt, tuple(scales[part].tolist()), m), axis=1)[:, :n]
    return wave, scales


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_quantile(p: float, dof: float) -> float:
    """Value below which a chi-square variable of ``dof`` lies with probability p."""
    low, high = 0.0, 10 * dof + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if lower_gamma(dof / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def not_a_knot(s: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the interpolating cubic spline without outer knots."""
    n = len(s)
    if n < 4:
        fit = np.polyfit(s, v, n - 1)
        return np.full(n, 2 * fit[0] if n == 3 else 0.0)
    h, d = np.diff(s), np.diff(v) / np.diff(s)
    diag, low, up = 2 * (h[:-1] + h[1:]), h[1:-1].copy(), h[1:-1].copy()
    rhs = 6 * np.diff(d)
    # the outer two second derivatives follow from equal third derivatives across the second knot
    diag[0] += h[0] * (1 + h[0] / h[1])
    up[0] -= h[0] * h[0] / h[1]
    diag[-1] += h[-1] * (1 + h[-1] / h[-2])
    low[-1] -= h[-1] * h[-1] / h[-2]
    diag, low, up, rhs, m = diag.tolist(), low.tolist(), up.tolist(), rhs.tolist(), [0.0] * n  # one by one, lists are faster
    for i in range(1, len(diag)):
        w = low[i - 1] / diag[i - 1]
        diag[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    m[n - 2] = rhs[-1] / diag[-1]
    for i in range(len(diag) - 2, -1, -1):
        m[i + 1] = (rhs[i] - up[i] * m[i + 2]) / diag[i]
    m[0] = m[1] * (1 + h[0] / h[1]) - m[2] * h[0] / h[1]
    m[-1] = m[-2] * (1 + h[-1] / h[-2]) - m[-3] * h[-1] / h[-2]
    return np.array(m)


def spline(s: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and first two derivatives of the spline at ``at``."""
    m = not_a_knot(s, v)
    i = np.clip(np.searchsorted(s, at, side="right") - 1, 0, len(s) - 2)
    h, a, b = s[i + 1] - s[i], s[i + 1] - at, at - s[i]
    value = (m[i] * a**3 + m[i + 1] * b**3) / (6 * h) + (v[i] / h - m[i] * h / 6) * a + (v[i + 1] / h - m[i + 1] * h / 6) * b
    first = (m[i + 1] * b**2 - m[i] * a**2) / (2 * h) + (v[i + 1] - v[i]) / h - (m[i + 1] - m[i]) * h / 6
    return value, first, (m[i] * a + m[i + 1] * b) / h


def savgol_derivative(v: np.ndarray, order: int, window: int) -> np.ndarray:
    """First derivative of the running polynomial fit; the outer windows fit the ends."""
    if window < order:
        raise ValueError("the window has to be longer than the order")
    half = window // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    out = np.convolve(v, fit[1][::-1], mode="same")
    if len(v) >= window:
        powers = np.arange(1, order + 1)
        for part, at in ((v[:window], t[:half]), (v[-window:], t[half + 1 :])):
            c = fit @ part
            ends = (c[1:] * powers * at[:, None] ** (powers - 1)).sum(axis=1)
            if at[0] < 0:
                out[:half] = ends
            else:
                out[len(v) - half :] = ends
    return out


def cross_faded(v: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Forward and backward smoothing of the reflected signal, faded into each other."""
    n = len(v)
    tripled = np.concatenate([v[::-1], v, v[::-1]])
    forward = np.convolve(tripled, kernel, mode="same")
    backward = np.convolve(tripled[::-1], kernel, mode="same")[::-1]
    w = np.arange(len(tripled)) / (len(tripled) - 1)
    return (backward * w + forward * (1 - w))[n : 2 * n]


def smooth(v: np.ndarray, ds: float, order: int = 2, window: int = 3, gaussian: int = 5) -> np.ndarray:
    """Smoothed derivative, integrated, set to the mean of the signal."""
    window, gaussian = window + (window % 2 == 0), gaussian + (gaussian % 2 == 0)
    sigma = gaussian / 6
    t = np.linspace(-2.7 * sigma, 2.7 * sigma, gaussian)
    kernel = np.exp(-(t**2) / (2 * sigma**2))
    slope = cross_faded(savgol_derivative(v, order, window) / ds, kernel / kernel.sum())
    steps = (slope[1:] + slope[:-1]) / 2 * ds
    total = np.concatenate([[0.0], np.cumsum(steps)])
    return total + (v - total).mean()


def peaks(v: np.ndarray) -> np.ndarray:
    """Places of strict local maxima, plateaus at their middle."""
    if len(v) < 3:
        return np.zeros(0, int)
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    value, end = v[start], np.append(start[1:], len(v)) - 1
    inner = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])) + 1
    return (start[inner] + end[inner]) // 2


def prominent(v: np.ndarray, least: float) -> np.ndarray:
    """Peaks that rise at least ``least`` above the higher of the two lows beside them."""
    found = []
    for p in peaks(v):
        higher = np.flatnonzero(v > v[p])
        left = higher[higher < p].max(initial=-1)
        right = higher[higher > p].min(initial=len(v))
        if v[p] - max(v[left + 1 : p + 1].min(), v[p:right].min()) >= least:
            found.append(p)
    return np.array(found, int)


def extended_all(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all bends of a line moved out to the highest opposite peak within growing windows.

    Runs of equal values above both neighbours are the peaks, of a window that holds a point
    of either neighbour; they are found once for the line, and the first window with one
    follows from the peak next to the bound.
    """
    last, out_a, out_b = len(c) - 1, a.copy(), b.copy()
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    end = np.append(first[1:] - 1, last)
    known = {}
    for sign in (1, -1):
        v = sign * c
        r = v[first]
        top = 1 + np.flatnonzero((r[1:-1] > r[:-2]) & (r[1:-1] > r[2:]))
        known[sign] = v, first[top], end[top]
    if not len(a):
        return out_a, out_b
    steps = np.arange(11) * ((b - a) // 2)[:, None] + (b - a)[:, None]
    pairs, padded = np.stack([a, b + 1], axis=1).ravel(), np.append(c, c[-1])
    most, least = (f.reduceat(padded, pairs)[::2] for f in (np.maximum, np.minimum))
    low, high = np.maximum(0, a[:, None] - steps), np.minimum(last, b[:, None] + steps)
    for sign in (1, -1):
        v, lo, hi = known[sign]
        own = np.flatnonzero((most > np.abs(least)) == (sign < 0))
        if not len(lo) or not len(own):
            continue
        ended = np.searchsorted(hi, a[own])  # peaks that end before the start
        t = (low[own] > lo[np.maximum(ended - 1, 0), None] - 1).sum(axis=1)
        ok = np.flatnonzero((ended > 0) & (t < low.shape[1]))
        at = low[own[ok], t[ok]]
        for i, x, k, n in zip(own[ok].tolist(), at.tolist(), np.searchsorted(lo, at + 1).tolist(), ended[ok].tolist(), strict=True):
            out_a[i] = x + int((v[x : a[i] + 1] == v[lo[k:n]].max()).argmax())
        begun = np.searchsorted(lo, b[own], "right")  # peaks that start after the end
        t = (high[own] < hi[np.minimum(begun, len(hi) - 1), None] + 1).sum(axis=1)
        ok = np.flatnonzero((begun < len(lo)) & (t < high.shape[1]))
        to = high[own[ok], t[ok]]
        for i, x, k, n in zip(own[ok].tolist(), to.tolist(), begun[ok].tolist(), np.searchsorted(hi, to).tolist(), strict=True):
            out_b[i] = b[i] + int((v[b[i] : x + 1] == v[lo[k:n]].max()).argmax())
    return out_a, out_b


def extended(c: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """``extended_all`` of one bend."""
    low, high = extended_all(c, np.array([a]), np.array([b]))
    return int(low[0]), int(high[0])


def _widths(u: np.ndarray, v: np.ndarray, levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of levels: whether v reaches them, how far apart in u it does so first and last, and whether at an end."""
    block = max(1, 2_000_000 // len(v))
    for i in range(0, len(levels), block):
        inside = v >= levels[i : i + block, None]
        first, last = inside.argmax(axis=1), len(v) - 1 - inside[:, ::-1].argmax(axis=1)
        yield inside.any(axis=1), u[last] - u[first], (first == 0) | (last == len(v) - 1)


def funneling(x: np.ndarray, y: np.ndarray, i0: int, i1: int) -> tuple[float, float, float]:
    """(lobe width, neck width, their ratio) of a bend across its chord; NaN without a neck."""
    dx, dy = x[i1] - x[i0], y[i1] - y[i0]
    t = math.atan(dy / dx) if dx else math.copysign(math.pi / 2, dy)
    u = (x - x[i0]) * math.cos(t) + (y - y[i0]) * math.sin(t)
    v = (y - y[i0]) * math.cos(t) - (x - x[i0]) * math.sin(t)
    u, v = (-u if u[i1] < 0 else u), (-v if v[(i0 + i1) // 2] < 0 else v)
    s = np.concatenate([[0], np.cumsum(np.hypot(np.diff(u), np.diff(v)))])
    at = np.linspace(0, s[-1], math.ceil(1.5 * len(u)))
    u, v = np.interp(at, s, u), np.interp(at, s, v)
    neck, lobe = 1e9, 0.0
    for inside, width, at_end in _widths(u, v, np.linspace(0, v.min(), 200)[:-5]):
        ends = np.flatnonzero(inside & at_end)
        last = ends[0] + 1 if len(ends) else len(inside)
        neck = min(neck, width[:last][inside[:last]].min(initial=1e9))
        if len(ends):
            break
    for inside, width, _ in _widths(u, v, np.linspace(0, v.max(), 200)):
        lobe = max(lobe, width[inside].max(initial=0.0))
    ratio = lobe / neck if neck not in (0.0, 1e9) else math.nan
    return (lobe, neck, ratio) if ratio >= 1e-5 else (math.nan, math.nan, math.nan)


def crossings(s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left indices and places of the sign changes of c."""
    left = np.flatnonzero((c[1:] > 0) != (c[:-1] > 0))
    return left, s[left] - (s[left + 1] - s[left]) / (c[left + 1] - c[left]) * c[left]


def plane_curvature(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """W4 on arrays."""
    x1, y1 = np.gradient(x, s), np.gradient(y, s)
    return (x1 * np.gradient(y1, s) - y1 * np.gradient(x1, s)) / (x1**2 + y1**2) ** 1.5


def marked_inflections(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The two inflections of a bend marked by hand, smoothed until two are left; else its ends."""
    n = len(s)
    if n >= 5:
        g, ds = 2 * math.ceil(n / 10), float(np.diff(s).mean())
        for k in range(6):
            left, at = crossings(s, plane_curvature(s, smooth(x, ds, 2, 3, g), smooth(y, ds, 2, 3, g)))
            if len(left) in (3, 4):
                inner = ~((left > 0.1 * n) & (n - left < 0.1 * n))
                left, at = left[inner], at[inner]
                if len(left) > 2 and 1 <= (np.diff(left) <= 0.1 * n).sum() <= 2:
                    at, left = at[[0, -1]], left[[0, -1]]
            if len(left) == 2:
                return float(at[0]), float(at[-1])
            g = g if k == 0 else min(2 * g, 2 * math.ceil(0.6 * n))
    return float(s[0]), float(s[-1])


def circle_moments(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Means of x and y, and of the products of the distances from them that a circle needs; NaN without points."""
    if not len(x):
        return (math.nan,) * 8
    n = len(x)
    mx, my = np.add.reduce(x) / n, np.add.reduce(y) / n
    u, v = x - mx, y - my
    z = u * u + v * v
    return mx, my, u @ u / n, v @ v / n, u @ v / n, u @ z / n, v @ z / n, z @ z / n


def circle_centres(moments: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Centres of Taubin's circles of ``circle_moments`` (rows), NaN for points on a line: ``metrics.fitted_circle`` on arrays."""
    mx, my, xx, yy, xy, xz, yz, zz = moments.T
    mz, cov = xx + yy, xx * yy - xy * xy
    var = zz - mz * mz
    a2 = 4 * cov - 3 * mz * mz - zz
    a1 = var * mz + 4 * cov * mz - xz * xz - yz * yz
    a0 = xz * (xz * yy - yz * xy) + yz * (yz * xx - xz * xy) - var * cov
    t = np.zeros(len(mx))
    for _ in range(rounds):
        slope = a1 + t * (2 * a2 + t * 12 * mz)
        t = t - np.where(slope == 0, 0.0, (a0 + t * (a1 + t * (a2 + t * 4 * mz))) / np.where(slope == 0, 1.0, slope))
    det = t * t - t * mz + cov
    det = np.where(np.abs(det) > 1e-12 * mz * mz, 2 * det, math.nan)
    return (xz * (yy - t) - yz * xy) / det + mx, (yz * (xx - t) - xz * xy) / det + my


__all__ = [
    "chi2_quantile", "circle_centres", "circle_moments", "crossings", "cross_faded", "cwt", "daughter", "extended", "fourier_factor", "funneling", "lower_gamma", "marked_inflections",
    "not_a_knot", "peaks", "plane_curvature", "prominent", "savgol_derivative", "scale_count", "smooth", "smoothed_values", "spline",
]
