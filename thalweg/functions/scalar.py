"""Row-wise column functions of planar geometry and hydrology.

Implements: P1-P4, P6-P14, P16-P21, IO6-IO8 (column parts), C2, A17.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def step_length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def chord_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Angle of the chord in [0, pi) or (3pi/2, 2pi), by the single-argument arctangent.

    A vertical chord gives a quarter turn by its sign; equal points give null.
    """
    dx, dy = x1 - x2, y1 - y2
    flat = F.when(dy > 0, math.pi / 2).when(dy < 0, -math.pi / 2)
    theta = F.when(dx == 0, flat).otherwise(F.atan(F.try_divide(dy, dx)))
    return F.when(theta < 0, theta + 2 * math.pi).otherwise(theta)


def rotated(dx: Column, dy: Column, theta: Column) -> tuple[Column, Column]:
    """The offset (dx, dy) in axes turned by theta."""
    return dx * F.cos(theta) + dy * F.sin(theta), dy * F.cos(theta) - dx * F.sin(theta)


def direction_angle(dx: Column, dy: Column) -> Column:
    """Heading in (-pi, pi); null where dx is 0 and dy is 0."""
    alpha = F.when(dx == 0, F.when(dy > 0, math.pi / 2).when(dy < 0, -math.pi / 2)).otherwise(F.atan(F.try_divide(dy, dx)))
    return F.when((dy > 0) & (dx < 0), math.pi + alpha).when((dy < 0) & (dx < 0), alpha - math.pi).otherwise(alpha)


def direction_azimuth(dx: Column, dy: Column) -> Column:
    """Clockwise from north."""
    alpha = F.when(dx == 0, F.when(dy > 0, math.pi / 2).when(dy < 0, -math.pi / 2)).otherwise(F.atan(F.try_divide(dy, dx)))
    return F.when(dx < 0, 1.5 * math.pi - alpha).otherwise(0.5 * math.pi - alpha)


def channel_width(area: Column) -> Column:
    """Regional width of a drainage area; one metre at least, also for null or negative."""
    area = area.cast("double")
    ln = F.when(area > 0, F.ln(area))
    # fixed values: coefficients and bounds of the three regimes
    width = (
        F.when(ln < 1.6, 2.18 * F.pow(area, F.lit(0.191)))
        .when(ln < 5.820, 1.41 * F.pow(area, F.lit(0.462)))
        .when(ln >= 5.820, 7.18 * F.pow(area, F.lit(0.183)))
    )
    return F.coalesce(F.greatest(width, F.lit(1.0)), F.lit(1.0))


def sinuosity(length: Column, chord: Column) -> Column:
    """Null where the chord is zero."""
    return F.try_divide(length, chord)


def line_intersection(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[Column, Column]:
    """Meeting point of the lines ab and cd; null where they are parallel."""
    det = (ax - bx) * (cy - dy) - (ay - by) * (cx - dx)
    one, two = ax * by - ay * bx, cx * dy - cy * dx
    return F.try_divide(one * (cx - dx) - (ax - bx) * two, det), F.try_divide(one * (cy - dy) - (ay - by) * two, det)


def circumcenter(ax, ay, bx, by, cx, cy) -> tuple[Column, Column]:
    """P10: centre of the circle through three points; null where they lie on a line."""
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return (
        F.try_divide(a * (by - cy) + b * (cy - ay) + c * (ay - by), d),
        F.try_divide(a * (cx - bx) + b * (ax - cx) + c * (bx - ax), d),
    )


def gaussian(t: Column, sigma: float) -> Column:
    """The normal density."""
    return F.exp(-(t * t) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))


def huc(reach_code: Column, level: int) -> Column:
    """Hydrologic unit of 2, 4, 6, 8, 10 or 12 digits from a reach code."""
    return F.substring(reach_code, 1, level)


def middle_sign(values: Column) -> Column:
    """Sign of the middle sample of an array."""
    return F.signum(F.element_at(values, (F.size(values) / 2).cast("int") + 1))


def hover_text(**metrics: Column) -> Column:
    """The metrics as ``name: value`` with two decimals, comma-separated."""
    return F.concat_ws(", ", *(F.format_string(f"{k}: %.2f", v) for k, v in metrics.items()))


def mid_point_scale(v: Column, low: float, middle: float, high: float) -> Column:
    """Linear from low to 0, middle to 0.5, high to 1, clamped."""
    lower = 0.5 * (v - low) / (middle - low)
    upper = 0.5 + 0.5 * (v - middle) / (high - middle)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v <= middle, lower).otherwise(upper)))


def parse_vector(text: Column) -> Column:
    """IO8: ``[1. 2.\\n 3.]`` as an array of doubles."""
    inner = F.regexp_replace(F.regexp_replace(text, r"[\[\]]", ""), r"[\s,]+", ",")
    return F.transform(F.filter(F.split(inner, ","), lambda v: v != ""), lambda v: v.cast("double"))


def wkt_line(xs: Column, ys: Column) -> Column:
    """IO6: a line string of two coordinate arrays."""
    points = F.zip_with(xs, ys, lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string")))
    return F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")"))


def initial_drainage_area(is_head: Column, at_head: Column, local: Column, total: Column) -> Column:
    """Drainage area where a reach begins, from head-node, local and total areas."""
    tenth = F.when(total > 0, 0.1 * total).otherwise(F.lit(1e-5))
    head = F.when(at_head > 0, at_head).when((local > 0) & (local != total), local).otherwise(tenth)
    return F.when(is_head, head).otherwise(F.when((local > 0) & (local != total), total - local).otherwise(total))


#: C2, fixed values: default parameter of each mother wavelet.
MOTHERS = {"MORLET": 6.0, "PAUL": 4.0, "DOG": 2.0}


def fourier_factor(mother: str, param: float) -> tuple[float, float]:
    """(scale to wavelength, scale to cone of influence) of a mother wavelet."""
    if mother == "MORLET":
        f = 4 * math.pi / (param + math.sqrt(2 + param * param))
        return f, f / math.sqrt(2)
    if mother == "PAUL":
        f = 4 * math.pi / (2 * param + 1)
        return f, f * math.sqrt(2)
    if mother == "DOG":
        f = 2 * math.pi * math.sqrt(2 / (2 * param + 1))
        return f, f / math.sqrt(2)
    raise ValueError(f"unknown mother wavelet {mother}")
