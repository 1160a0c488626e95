"""Operators over the ordered points of each river, as window expressions.

Frames have river_id and idx (the order) and, where named, s, x, y, c. All windows share
one partitioning, so a chain of them shuffles once; with the frame hash-partitioned by
river_id they do not shuffle at all.

Implements: W1-W11, W13, W15, W20, W21, P5, P6, P15, A16, U5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from thalweg.functions.scalar import chord_angle, direction_angle, rotated, step_length

def in_order() -> WindowSpec:
    return Window.partitionBy("river_id").orderBy("idx")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def distances(points: DataFrame) -> DataFrame:
    """Adds s, the length of the line up to each point."""
    dx, dy = F.col("x") - F.lag("x").over(in_order()), F.col("y") - F.lag("y").over(in_order())
    return points.withColumn("s", F.sum(F.coalesce(step_length(dx, dy), F.lit(0.0))).over(so_far()))


def step_statistics(points: DataFrame) -> DataFrame:
    """Least, mean and geometric mean step of s, and whether steps are even."""
    steps = points.withColumn("ds", F.col("s") - F.lag("s").over(in_order())).where("ds is not null")
    mean = F.avg("ds").over(Window.partitionBy("river_id"))
    steps = steps.withColumn("even", F.abs(F.col("ds") - mean) <= 1e-8 + 1e-2 * F.abs(mean))
    return steps.groupBy("river_id").agg(
        F.min("ds").alias("ds_min"), F.avg("ds").alias("ds_mean"),
        F.pow(F.lit(10.0), F.avg(F.log10(F.when(F.col("ds") > 0, F.col("ds"))))).alias("ds_geometric"),
        F.bool_and("even").alias("even"),
    )


def gradient(f: Column, s: Column, order: WindowSpec | None = None) -> Column:
    """Second-order derivative of f by uneven s, one-sided at the ends; null at repeated s."""
    order = order or in_order()
    return _gradient(*((F.lag(v).over(order), v, F.lead(v).over(order)) for v in (f, s)))


def _gradient(of: tuple[Column, Column, Column], by: tuple[Column, Column, Column]) -> Column:
    """``gradient`` from f and s at the point before, the point and the point after."""
    (f0, f, f2), (s0, s, s2) = of, by
    h1, h2 = s - s0, s2 - s
    inner = F.try_divide(h1 * h1 * f2 + (h2 * h2 - h1 * h1) * f - h2 * h2 * f0, h1 * h2 * (h1 + h2))
    return F.coalesce(inner, F.try_divide(f - f0, h1), F.try_divide(f2 - f, h2))


def curvature(points: DataFrame) -> DataFrame:
    """Adds c, r (null where c is 0) and the running heading, from x, y and s."""
    # each neighbour is looked up once and named: Spark makes a window function of every place where one stands
    beside = lambda *columns: {f"_{c}_{k}": f(c).over(in_order()) for c in columns for k, f in (("lag", F.lag), ("lead", F.lead))}
    three = lambda c: (F.col(f"_{c}_lag"), F.col(c), F.col(f"_{c}_lead"))
    out = points.withColumns(beside("s", "x", "y")).withColumns({f"{c}1": _gradient(three(c), three("s")) for c in "xy"})
    out = out.withColumns(beside("x1", "y1")).withColumns({f"{c}2": _gradient(three(f"{c}1"), three("s")) for c in "xy"})
    out = out.drop(*beside("s", "x", "y", "x1", "y1"))
    speed = F.pow(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1"), F.lit(1.5))
    out = out.withColumn("c", F.try_divide(F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2"), speed))
    out = out.withColumn("r", F.try_divide(F.lit(-1.0), F.col("c")))
    dx, dy = F.first("x1").over(whole()), F.first("y1").over(whole())
    alpha = F.when(dx == 0, F.when(dy > 0, math.pi / 2).when(dy < 0, -math.pi / 2)).otherwise(F.atan(F.try_divide(dy, dx)))
    start = F.when((dy > 0) & (dx < 0), math.pi + alpha).when((dy < 0) & (dx < 0), 1.5 * math.pi - alpha).otherwise(alpha)
    turn = F.coalesce(F.col("c") * (F.col("s") - F.lag("s").over(in_order())), F.lit(0.0))
    return out.withColumn("turn", turn).withColumn("heading", start + F.sum("turn").over(so_far())).drop("x1", "y1", "x2", "y2", "turn")


def from_curvature(points: DataFrame) -> DataFrame:
    """Adds rebuilt_x and rebuilt_y, the line that starts like x, y and turns by c."""
    first = lambda c, k: F.nth_value(c, k).over(whole())
    ds_before = F.lag("s").over(in_order()) - F.lag("s", 2).over(in_order())
    out = points.withColumn("angle0", F.atan2(first("y", 2) - first("y", 1), first("x", 2) - first("x", 1)))
    out = out.withColumn("turn", F.when(F.col("idx") >= 2, F.col("c") * F.coalesce(ds_before, F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("angle", F.col("angle0") + F.sum("turn").over(so_far()))
    ds = F.when(F.col("idx") >= 2, F.col("s") - F.lag("s").over(in_order())).otherwise(0.0)
    out = out.withColumn("mx", ds * F.cos("angle")).withColumn("my", ds * F.sin("angle"))
    at = lambda a, m: F.when(F.col("idx") == 0, F.col(a)).otherwise(first(a, 2) + F.sum(m).over(so_far()))
    return out.withColumn("rebuilt_x", at("x", "mx")).withColumn("rebuilt_y", at("y", "my")).drop("angle0", "turn", "angle", "mx", "my")


def runs(points: DataFrame, value: Column) -> DataFrame:
    """Run-length encoding of ``value``: river_id, run, start, length, value."""
    marked = points.withColumn("_v", value)
    new = F.coalesce((~F.col("_v").eqNullSafe(F.lag("_v").over(in_order()))).cast("long"), F.lit(1))
    marked = marked.withColumn("_new", F.when(F.row_number().over(in_order()) == 1, 0).otherwise(new))
    marked = marked.withColumn("run", F.sum("_new").over(so_far()).cast("long"))
    return marked.groupBy("river_id", "run").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("length"), F.first("_v").alias("value"))


def inflections(points: DataFrame) -> DataFrame:
    """Where c changes sign (0 counts as negative): s, by a straight line, and both neighbours."""
    nxt = lambda c: F.lead(c).over(in_order())
    ahead = points.select("river_id", "idx", "s", "c", nxt("idx").alias("ind_r"), nxt("s").alias("s_r"), nxt("c").alias("c_r"))
    crossing = ahead.where((F.col("c") > 0) != (F.col("c_r") > 0))
    at = F.col("s") - (F.col("s_r") - F.col("s")) / (F.col("c_r") - F.col("c")) * F.col("c")
    return crossing.select("river_id", F.col("idx").alias("ind_l"), "ind_r", at.alias("s_inf"))


def local_peaks(points: DataFrame, value: str) -> DataFrame:
    """Strict local maxima; a plateau counts once, at its middle (rounded down); ends never."""
    r = runs(points, F.col(value))
    o = Window.partitionBy("river_id").orderBy("run")
    top = r.withColumn("before", F.lag("value").over(o)).withColumn("after", F.lead("value").over(o))
    top = top.where((F.col("value") > F.col("before")) & (F.col("value") > F.col("after")))
    return top.select("river_id", F.expr("(start + start + length - 1) div 2").alias("peak_idx"), F.col("value").alias("peak_value"))


def extreme_curvature(points: DataFrame) -> DataFrame:
    """The first point of largest |c| of each river."""
    best = F.max_by(F.struct("idx", "s", "x", "y", "c"), F.struct(F.abs("c"), -F.col("idx")))
    out = points.where("c is not null").groupBy("river_id").agg(best.alias("b"))
    return out.select("river_id", *(F.col(f"b.{c}").alias(n) for c, n in (("idx", "idx_c_max"), ("s", "s_c_max"), ("x", "x_c_max"), ("y", "y_c_max"), ("c", "c_max"))))


def translated(points: DataFrame) -> DataFrame:
    """P5: x and y from the river's first point."""
    return points.withColumn("x", F.col("x") - F.first("x").over(whole())).withColumn("y", F.col("y") - F.first("y").over(whole()))


def scaled(points: DataFrame, factor: float) -> DataFrame:
    """S, x, y divided by a factor."""
    return points.withColumns({c: F.col(c) / factor for c in ("s", "x", "y") if c in points.columns})


def chord_aligned(points: DataFrame) -> DataFrame:
    """X and y from the first point, in axes along the chord from first to last."""
    x0, y0, x1, y1 = (f(c).over(whole()) for f, c in ((F.first, "x"), (F.first, "y"), (F.last, "x"), (F.last, "y")))
    out = points.withColumns({"_x": F.col("x") - x0, "_y": F.col("y") - y0, "_t": F.coalesce(chord_angle(x0, y0, x1, y1), F.lit(0.0))})
    rx, ry = rotated(F.col("_x"), F.col("_y"), F.col("_t"))
    return out.withColumns({"x": rx, "y": ry}).drop("_x", "_y", "_t")


def width_scaled(points: DataFrame) -> DataFrame:
    """X, y and s over the geometric mean of w_m, c times it."""
    mean = F.pow(F.lit(10.0), F.avg(F.log10("w_m")).over(Window.partitionBy("river_id")))
    out = points.withColumn("w_gm", mean)
    out = out.withColumns({c: F.col(c) / F.col("w_gm") for c in ("x", "y", "s") if c in points.columns})
    return out.withColumn("c", F.col("c") * F.col("w_gm")) if "c" in points.columns else out


def regular_grid(points: DataFrame, step: float | None = None) -> DataFrame:
    """Stations at a fixed step over s; by default the river's mean step."""
    ends = points.groupBy("river_id").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.count(F.lit(1)).alias("n"))
    ds = F.lit(step) if step is not None else F.try_divide(F.col("s1") - F.col("s0"), F.col("n") - 1)
    ends = ends.withColumn("ds", ds).where("ds > 0")
    k = F.sequence(F.lit(0).cast("long"), F.ceil((F.col("s1") - F.col("s0") + F.col("ds") / 2) / F.col("ds")).cast("long") - 1)
    return ends.select("river_id", "s0", "ds", F.explode(k).alias("k")).select("river_id", "k", (F.col("s0") + F.col("k") * F.col("ds")).alias("s"))


def _bracketed(points: DataFrame, stations: DataFrame, columns: list[str]) -> DataFrame:
    """Stations with the knot at or before them and the one after, in one sorted pass.

    Knots and stations share a window by s, so any number of each costs one shuffle and
    no range join.
    """
    knot = F.struct("s", *columns)
    two = points.select("river_id", "idx", F.col("s").alias("at"), F.struct(
        knot.alias("here"), F.lag(knot).over(in_order()).alias("before"), F.lead(knot).over(in_order()).alias("next"),
        F.lead(knot, 2).over(in_order()).alias("second")).alias("k"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("station"))
    asked = stations.select("river_id", F.lit(None).cast("long").alias("idx"), F.col("s").alias("at"), F.lit(None).alias("k"), F.lit(1).alias("kind"), F.col("k").alias("station"))
    w = Window.partitionBy("river_id").orderBy("at", "kind", "idx", "station")
    both = two.unionByName(asked).withColumn("low", F.last("k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the next knot by the reverse order: a frame that grows from its start stays linear
    back = Window.partitionBy("river_id").orderBy(*(F.desc(c) for c in ("at", "kind", "idx", "station")))
    both = both.withColumn("high", F.last("k", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("kind = 1")


def interpolated(points: DataFrame, stations: DataFrame, column: str) -> DataFrame:
    """``column`` at the stations by straight lines, carried on beyond the ends."""
    b = _bracketed(points, stations, [column])
    left = F.when(F.col("low").isNull(), F.col("high.here")).when(F.col("low.next").isNull(), F.col("low.before")).otherwise(F.col("low.here"))
    right = F.when(F.col("low").isNull(), F.col("high.next")).when(F.col("low.next").isNull(), F.col("low.here")).otherwise(F.col("low.next"))
    b = b.select("river_id", F.col("station").alias("k"), F.col("at").alias("s"), left.alias("l"), right.alias("r"))
    slope = F.try_divide(F.col(f"r.{column}") - F.col(f"l.{column}"), F.col("r.s") - F.col("l.s"))
    return b.select("river_id", "k", "s", (F.col(f"l.{column}") + slope * (F.col("s") - F.col("l.s"))).alias(column))


def previous(points: DataFrame, stations: DataFrame, column: str) -> DataFrame:
    """``column`` of the last point at or before each station; the first one's before it."""
    b = _bracketed(points, stations, [column])
    return b.select("river_id", F.col("station").alias("k"), F.col("at").alias("s"), F.coalesce(f"low.here.{column}", f"high.here.{column}").alias(column))


def nearest(points: DataFrame, stations: DataFrame) -> DataFrame:
    """Idx of the point nearest to each station, the first on a tie."""
    b = _bracketed(points, stations, ["idx"])
    low, high = F.col("low.here"), F.col("high.here")
    closer = high.isNotNull() & (low.isNull() | (F.abs(high["s"] - F.col("at")) < F.abs(F.col("at") - low["s"])))
    return b.select("river_id", F.col("station").alias("k"), F.when(closer, high["idx"]).otherwise(low["idx"]).alias("idx"))


def distinct_x(points: DataFrame) -> DataFrame:
    """The first point of every distinct x, in order."""
    first = F.min("idx").over(Window.partitionBy("river_id", "x"))
    return points.withColumn("_f", first).where("_f = idx").drop("_f")


def headings(points: DataFrame) -> DataFrame:
    """P12 of every step, from the point before."""
    dx, dy = F.col("x") - F.lag("x").over(in_order()), F.col("y") - F.lag("y").over(in_order())
    return points.withColumns({"dx": dx, "dy": dy}).where("dx is not null").withColumn("angle", direction_angle(F.col("dx"), F.col("dy")))
