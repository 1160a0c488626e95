"""B-splines of any order in numpy: bases, interpolation, least squares from sums, smoothing of stacks of series.

A spline of order k has knots t (the outer ones k + 1 times) and coefficients c; on the
interval from t[j] to t[j + 1] it is a polynomial, given here by its powers of (s - t[j]).

Implements: kernels of W22, W25.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np


def padded(inner: np.ndarray, low: float, high: float, k: int) -> np.ndarray:
    """All knots for the inner ones and the ends of the line."""
    return np.concatenate([np.full(k + 1, low), inner, np.full(k + 1, high)])


def basis(t: np.ndarray, k: int, j: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Values at ``s`` of the k + 1 functions that are not zero on interval ``j``, by the recursion of Cox and de Boor.

    Axes of the knots before the last one are a stack, which ``s`` then has too.
    """
    return _spread(lambda m: t[..., j + m], k, s)


def local_basis(t: np.ndarray, k: int, s: np.ndarray) -> np.ndarray:
    """``basis`` at points that each come with the 2 k knots around their interval (rows of ``t``)."""
    return _spread(lambda m: t[:, k - 1 + m], k, s)


def _spread(knot: Callable[[int], np.ndarray], k: int, s: np.ndarray) -> np.ndarray:
    out = np.ones((*s.shape, 1))
    for d in range(1, k + 1):
        wider = np.zeros((*s.shape, d + 1))
        for r in range(d):
            low, high = knot(1 - d + r), knot(1 + r)
            share = out[..., r] / (high - low)
            wider[..., r] += share * (high - s)
            wider[..., r + 1] += share * (s - low)
        out = wider
    return out


def powers(t: np.ndarray, k: int, c: np.ndarray) -> np.ndarray:
    """One row an interval between distinct knots: the polynomial's coefficients, from the constant up.

    For a stack (axes before the last) all inner knots are distinct.
    """
    j = np.flatnonzero(np.diff(t) > 0) if t.ndim == 1 else np.arange(k, t.shape[-1] - k - 1)
    out, slopes = np.zeros((*t.shape[:-1], len(j), k + 1)), c.astype(float)
    for r in range(k + 1):
        if r:
            i = np.arange(r, c.shape[-1])
            gap = t[..., i + k - r + 1] - t[..., i]
            rise = slopes[..., i] - slopes[..., i - 1]
            slopes = np.concatenate([np.zeros((*t.shape[:-1], r)), np.divide((k - r + 1) * rise, gap, out=np.zeros(gap.shape), where=gap > 0)], axis=-1)
        parts = basis(t, k - r, j, t[..., j])
        out[..., r] = (parts * slopes[..., j[:, None] - (k - r) + np.arange(k - r + 1)]).sum(axis=-1) / math.factorial(r)
    return out


def solved(band: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The solution for a matrix given by its rows' bands (column i - w to i + w), which needs no pivots.

    Axes before the last two are a stack of matrices, which are solved together.
    """
    n, width = band.shape[-2], band.shape[-1] // 2
    # the stack comes last, so that its numbers lie side by side
    a, x = np.array(np.moveaxis(band, (-2, -1), (0, 1)), float, order="C"), np.array(np.moveaxis(rhs, -1, 0), float, order="C")
    for i in range(n):
        for d in range(1, min(width, n - 1 - i) + 1):
            f = a[i + d, width - d] / a[i, width]
            a[i + d, width - d : 2 * width + 1 - d] -= f * a[i, width:]
            x[i + d] -= f * x[i]
    for i in range(n - 1, -1, -1):
        m = min(width, n - 1 - i)
        x[i] = (x[i] - (a[i, width + 1 : width + 1 + m] * x[i + 1 : i + 1 + m]).sum(axis=0)) / a[i, width]
    return np.moveaxis(x, 0, -1)


def interpolated(s: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Knots, coefficients and order of the spline through all points; fewer than k + 1 points lower the order.

    Inner knots are points for odd orders and middles between points for even ones, leaving
    out as many at either end as makes the spline unique.
    """
    n = len(s)
    k = min(k, n - 1)
    inner = s[(k + 1) // 2 : n - (k + 1) // 2] if k % 2 else (s[k // 2 : n - k // 2 - 1] + s[k // 2 + 1 : n - k // 2]) / 2
    t = padded(inner, s[0], s[-1], k)
    j = np.clip(np.searchsorted(t, s, side="right") - 1, k, n - 1)
    parts, band = basis(t, k, j, s), np.zeros((n, 2 * k + 1))
    at = j[:, None] - k + np.arange(k + 1) - np.arange(n)[:, None] + k  # column in the row's band
    ok = (at >= 0) & (at <= 2 * k)
    band[np.nonzero(ok)[0], at[ok]] = parts[ok]
    return t, solved(band, v), k


def assembled(products: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations from each interval's sums: products of basis functions (upper triangle by rows) and with the values.

    The first axis is a stack of series with equally many intervals.
    """
    count, q = products.shape[:2]
    band, rhs = np.zeros((count, q + k, 2 * k + 1)), np.zeros((count, q + k))
    at = [0, *np.cumsum(np.arange(k + 1, 0, -1))]
    for a in range(k, -1, -1):
        rhs[:, a : a + q] += values[:, :, a]
        for b in range(a, k + 1):
            own = products[:, :, at[a] + b - a]
            band[:, a : a + q, k + b - a] += own
            if b > a:
                band[:, b : b + q, k + a - b] += own
    return band, rhs


def _jumps(t: np.ndarray, k: int) -> np.ndarray:
    """Jump of the k-th derivative at each inner knot, by the k + 2 coefficients around it (a common factor aside)."""
    inner = t.shape[1] - 2 * k - 2
    scale = ((t[:, -1] - t[:, 0]) / (inner + 1))[:, None]
    here, out = t[:, k + 1 : k + 1 + inner], np.zeros((len(t), inner, k + 2))
    for e in range(k + 2):
        others = [(here - t[:, e + o : e + o + inner]) / scale for o in range(k + 2) if o != k + 1 - e]
        out[:, :, e] = (t[:, e + k + 1 : e + k + 1 + inner] - t[:, e : e + inner]) / scale / np.prod(others, axis=0)
    return out


def smoothed(t: np.ndarray, k: int, band: np.ndarray, rhs: np.ndarray, least: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Of the splines on these knots with squared distances of ``residual``, the one of least jumps; for a stack of series.

    ``least`` is the residual of the least-squares spline; any other adds the form of the normal
    equations at its distance from that one, so no sum over points is needed again.
    """
    return smoothed_stacks(k, [(t, band, rhs, least, residual)])[0]


def smoothed_stacks(k: int, stacks: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """``smoothed`` of several stacks (its arguments but ``k``), whose series of nearly equal length are tried together.

    A shorter series is filled up with rows that ask for nothing but zeros.
    """
    out, open_series = [], []
    for t, band, rhs, least, residual in stacks:
        best = solved(band, rhs)
        out.append(best)
        inner, n = t.shape[1] - 2 * k - 2, rhs.shape[1]
        open_ = np.flatnonzero(residual > least)
        if inner <= 0 or not len(open_):
            continue
        jumps, wide = _jumps(t[open_], k), np.zeros((len(open_), n, 2 * k + 3))
        for a in range(k + 1, -1, -1):
            wide[:, a : a + inner, k + 1 - a : 2 * k + 3 - a] += jumps[:, :, a, None] * jumps
        open_series.append((n, best, open_, band[open_], wide, rhs[open_], least[open_], residual[open_]))
    open_series.sort(key=lambda x: x[0])
    while open_series:
        near = [x for x in open_series if x[0] <= open_series[0][0] + max(8, open_series[0][0] // 4)]
        open_series = open_series[len(near) :]
        n = near[-1][0]
        filled = lambda i, near=near, n=n: np.concatenate([np.pad(x[i], ((0, 0), (0, n - x[0]), *[(0, 0)] * (x[i].ndim - 2))) for x in near])
        length = np.concatenate([np.full(len(x[2]), x[0]) for x in near])
        c = _least_jumps(k, length, *(filled(i) for i in (3, 4, 5)), *(np.concatenate([x[i] for x in near]) for i in (6, 7)), np.concatenate([np.pad(x[1][x[2]], ((0, 0), (0, n - x[0]))) for x in near]))
        low = 0
        for m, best, open_, *_ in near:
            best[open_] = c[low : low + len(open_), :m]
            low += len(open_)
    return out


def _least_jumps(k: int, length: np.ndarray, band: np.ndarray, wide: np.ndarray, rhs: np.ndarray, least: np.ndarray, residual: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Coefficients at the weight of the jumps (``wide``) that leaves ``residual``, by halving; a series' rows from its ``length`` on are filled up."""
    n = rhs.shape[1]
    full = np.zeros_like(wide)
    full[:, :, 1:-1] = band
    full[:, :, k + 1] += np.arange(n) >= length[:, None]

    def fit(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = solved(full + weight[:, None, None] * wide, rhs)
        off = np.pad(c - best, ((0, 0), (k, k)))
        form = sum(band[:, :, d] * off[:, d : d + n] for d in range(2 * k + 1)) * off[:, k : k + n]
        return c, least + form.sum(axis=1)

    low, high = np.full(len(rhs), -60.0), np.full(len(rhs), 60.0)  # powers of e, by the size of the equations
    size = np.abs(band).max(axis=(1, 2)) / np.abs(wide).max(axis=(1, 2))
    for _ in range(60):
        mid = (low + high) / 2
        below = fit(np.exp(mid) * size)[1] < residual
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return fit(np.exp(low) * size)[0]


def new_knots(first: list[int], last: list[int], distances: list[float], count: int) -> list[int]:
    """Points to become knots: ``count`` times the interval of largest distance is split at its middle point.

    ``first`` and ``last`` number the points inside each interval, its ends left out; an
    interval's distance is shared by its parts as its points are.
    """
    parts = [[d, a, b] for d, a, b in zip(distances, first, last, strict=True) if b >= a]
    chosen: list[int] = []
    for _ in range(count):
        if not parts:
            break
        worst = max(parts, key=lambda p: p[0])
        parts.remove(worst)
        d, a, b = worst
        middle = a + (b - a + 1) // 2
        chosen.append(middle)
        for low, high in ((a, middle - 1), (middle + 1, b)):
            if high >= low:
                parts.append([d * (high - low + 1) / (b - a + 1), low, high])
    return chosen


def judged(parts: list[float], first: list[int], last: list[int], smooth: float, tolerance: float, before: float | None, added: int) -> tuple[float, int, bool, list[int]]:
    """What becomes of a series with the squared distances ``parts`` by interval: their sum, how many knots it gets, whether it is done, and its new knots.

    ``first`` and ``last`` number the points of each interval, ``before`` and ``added`` are the sum and the knots of the last time.
    """
    total = sum(parts)
    above, enough = total - smooth, tolerance * smooth
    if above < enough:
        return total, 0, True, []
    if before is None:
        count = 1
    else:  # as many as the fall of the residual foretells, within a half and the double of the last time
        foretold = int(added * above / (before - total)) if before - total > enough else 2 * added
        count = min(2 * added, max(foretold, added // 2, 1))
    # the ends of the line are no inner points, nor is the knot that an interval starts with
    chosen = new_knots([x + 1 for x in first], [*last[:-1], last[-1] - 1], parts, count)
    return total, count, not chosen, chosen


def smoothing(s: np.ndarray, v: np.ndarray, sizes: np.ndarray, k: int, smooth: np.ndarray, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Smoothing splines of many series of more than k + 1 points, one after the other in ``s`` and ``v``, by the rounds of ``operators.splines``.

    Gives the numbers of series with equally many intervals, and for each of these its intervals'
    ends and coefficients. Every round takes the points of all unfinished series together.
    """
    starts = np.cumsum(sizes) - sizes
    v0 = v[starts]
    v = v - np.repeat(v0, sizes)
    is_knot, state = np.zeros(len(s), bool), {j: (None, 0) for j in range(len(sizes))}
    pairs, ended = np.triu_indices(k + 1), []
    while state:
        rest = np.array(list(state))
        n = sizes[rest]
        of, at = np.repeat(np.arange(len(rest)), n), np.cumsum(n) - n
        i = np.arange(len(of)) - at[of]
        place = i + starts[rest][of]
        si, vi, knot = s[place], v[place], is_knot[place]
        g = np.cumsum(knot) + of  # interval, over all series
        heads = np.flatnonzero(np.diff(g, prepend=-1))
        base = g[at]
        counts = np.diff(np.append(base, g[-1] + 1))
        # the 2 k knots around each interval: inner ones, and beyond them the ends of the line
        own, q = of[heads], np.arange(len(heads)) - base[of[heads]]
        inner, after = q[:, None] + np.arange(2 * k) - k, counts[own, None] - 1
        known = np.append(si[knot], 0.0)[np.clip(inner + (base[own] - own)[:, None], 0, np.count_nonzero(knot))]
        t = np.where(inner < 0, si[at][own, None], np.where(inner >= after, si[at + n - 1][own, None], known))
        parts = local_basis(t[g], k, si)
        products = np.add.reduceat(parts[:, pairs[0]] * parts[:, pairs[1]], heads)
        values = np.add.reduceat(parts * vi[:, None], heads)
        stacks, c = {}, np.zeros((len(heads), k + 1))
        for m in np.unique(counts).tolist():
            which = np.flatnonzero(counts == m)
            rows = base[which, None] + np.arange(m)
            stacks[m] = which, rows, *assembled(products[rows], values[rows], k)
            c[rows] = solved(*stacks[m][2:])[:, np.arange(m)[:, None] + np.arange(k + 1)]
        own = (vi - (parts * c[g]).sum(axis=1)) ** 2
        inside, shared = (np.add.reduceat(x, heads) for x in (np.where(knot, own / 2, own), np.where(knot, own / 2, 0.0)))
        shared[base] = 0.0
        inside[:-1] += shared[1:]  # a knot's distance belongs to both its intervals, by halves
        distances, first, last = inside.tolist(), i[heads].tolist(), i[np.append(heads[1:], len(i)) - 1].tolist()
        least, done = np.zeros(len(rest)), np.zeros(len(rest), bool)
        for r, (j, low, m) in enumerate(zip(rest.tolist(), base.tolist(), counts.tolist(), strict=True)):
            part = slice(low, low + m)
            least[r], added, done[r], chosen = judged(distances[part], first[part], last[part], smooth[j], tolerance, *state[j])
            state[j] = least[r], added
            is_knot[starts[j] + np.array(chosen, int)] = True
            if done[r]:
                del state[j]
        for m, (which, rows, band, rhs) in stacks.items():
            ready = np.flatnonzero(done[which])
            if not len(ready):
                continue
            which, rows = which[ready], rows[ready]
            low, high, j = t[rows, k - 1], t[rows, k], rest[which]
            knots = np.concatenate([np.repeat(low[:, :1], k + 1, axis=1), low[:, 1:], np.repeat(high[:, -1:], k + 1, axis=1)], axis=1)
            ended.append((j, low, high, knots, band[ready], rhs[ready], least[which], smooth[j]))
    for (j, low, high, knots, *_), c in zip(ended, smoothed_stacks(k, [x[3:] for x in ended]), strict=True):
        found = powers(knots, k, c)
        found[:, :, 0] += v0[j, None]
        yield j, low, high, found
