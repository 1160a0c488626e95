"""Metrics of bends and reaches.

A bend is a run of points of one river; bend tables have river_id, bend_id, idx_start and
idx_end. Points meet bends by river_id with the index range as a residual.

Implements: A1-A7, A9-A12, A14-A16, A21, F5, X14-X16, X18, W12.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions.scalar import chord_angle, rotated, step_length
from thalweg.operators.ordered import in_order, whole

BEND = ["river_id", "bend_id"]


def side_runs(points: DataFrame, level: float = 0.0) -> DataFrame:
    """Points with bend_id: runs on one side of the river's mean y (moved by ``level``)."""
    above = F.col("y") - F.avg("y").over(whole()) > level  # summed in order, however the rows come
    out = points.withColumn("side", above)
    new = F.coalesce((F.col("side") != F.lag("side").over(in_order())).cast("long"), F.lit(0).cast("long"))
    return out.withColumn("_n", new).withColumn("bend_id", F.sum("_n").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def bends(points: DataFrame) -> DataFrame:
    """One row per bend from points with bend_id and s."""
    o = Window.partitionBy(*BEND).orderBy("idx")
    step = step_length(F.col("x") - F.lag("x").over(o), F.col("y") - F.lag("y").over(o))
    p = points.withColumn("_d", F.coalesce(step, F.lit(0.0)))
    ends = {f"{c}_{e}": f(c, "idx") for c in ("x", "y", "s") for e, f in (("start", F.min_by), ("end", F.max_by))}
    b = p.groupBy(*BEND).agg(
        F.min("idx").alias("idx_start"), F.max("idx").alias("idx_end"), F.count(F.lit(1)).alias("n_points"),
        F.sum("_d").alias("lambda_fm"), *(v.alias(k) for k, v in ends.items()),
    )
    chord = step_length(F.col("x_end") - F.col("x_start"), F.col("y_end") - F.col("y_start"))
    b = b.withColumn("L_fm", chord).withColumn("sigma_fm", F.try_divide("lambda_fm", "L_fm"))
    return b.withColumn("s_middle", F.col("s_start") + (F.col("s_end") - F.col("s_start")) / 2)


def amplitude(points: DataFrame) -> DataFrame:
    """Extent of each bend across its chord."""
    w = Window.partitionBy(*BEND).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x0, y0, x1, y1 = (f(c).over(w) for f, c in ((F.first, "x"), (F.first, "y"), (F.last, "x"), (F.last, "y")))
    p = points.withColumns({"_dx": F.col("x") - x0, "_dy": F.col("y") - y0, "_t": F.coalesce(chord_angle(x0, y0, x1, y1), F.lit(0.0))})
    across = rotated(F.col("_dx"), F.col("_dy"), F.col("_t"))[1]
    return p.withColumn("_a", across).groupBy(*BEND).agg((F.max("_a") - F.min("_a")).alias("amplitude"))


def asymmetry(points: DataFrame) -> DataFrame:
    """(up - down) / all of the lengths on both sides of the point of largest |c|."""
    o = Window.partitionBy(*BEND).orderBy("idx")
    whole = Window.partitionBy(*BEND)
    step = step_length(F.col("x") - F.lag("x").over(o), F.col("y") - F.lag("y").over(o))
    top = F.max_by("idx", F.struct(F.abs("c"), -F.col("idx"))).over(whole)
    p = points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("_top", top)
    a = p.groupBy(*BEND).agg(
        F.sum(F.when(F.col("idx") <= F.col("_top"), F.col("_d")).otherwise(0.0)).alias("lambda_u"),
        F.sum(F.when(F.col("idx") > F.col("_top"), F.col("_d")).otherwise(0.0)).alias("lambda_d"),
    )
    return a.withColumn("a_fm", F.try_divide(F.col("lambda_u") - F.col("lambda_d"), F.col("lambda_u") + F.col("lambda_d")))


def fitted_circle(points: DataFrame, group: list[str] = BEND, rounds: int = 30) -> DataFrame:
    """Taubin's circle of each group: cx, cy, radius; null for points on a line.

    Two aggregations give the centre and the moments, a fixed number of Newton steps on
    the moments gives the circle: no point leaves Spark.
    """
    w = Window.partitionBy(*group).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({"_mx": F.avg("x").over(w), "_my": F.avg("y").over(w)})
    p = p.withColumns({"_u": F.col("x") - F.col("_mx"), "_v": F.col("y") - F.col("_my")}).withColumn("_z", F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v"))
    pairs = {"xx": "_u * _u", "yy": "_v * _v", "xy": "_u * _v", "xz": "_u * _z", "yz": "_v * _z", "zz": "_z * _z"}
    m = p.groupBy(*group).agg(F.max("_mx").alias("mx"), F.max("_my").alias("my"), *(F.avg(F.expr(e)).alias(k) for k, e in pairs.items()))
    mz, cov = F.col("xx") + F.col("yy"), F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    m = m.withColumn("mz", mz).withColumn("cov", cov).withColumn("var", F.col("zz") - F.col("mz") * F.col("mz"))
    m = m.withColumn("a2", 4 * F.col("cov") - 3 * F.col("mz") * F.col("mz") - F.col("zz") + 0.0)
    a1 = F.col("var") * F.col("mz") + 4 * F.col("cov") * F.col("mz") - F.col("xz") * F.col("xz") - F.col("yz") * F.col("yz")
    a0 = F.col("xz") * (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) + F.col("yz") * (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) - F.col("var") * F.col("cov")
    m = m.withColumn("a1", a1).withColumn("a0", a0)

    def newton(t, _):
        f = F.col("a0") + t * (F.col("a1") + t * (F.col("a2") + t * 4 * F.col("mz")))
        slope = F.col("a1") + t * (2 * F.col("a2") + t * 12 * F.col("mz"))
        return t - F.coalesce(F.try_divide(f, slope), F.lit(0.0))

    m = m.withColumn("t", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.0), newton))
    det = F.col("t") * F.col("t") - F.col("t") * F.col("mz") + F.col("cov")
    m = m.withColumn("det", det).withColumn("det", F.when(F.abs("det") > 1e-12 * F.col("mz") * F.col("mz"), F.col("det")))
    cx = F.try_divide(F.col("xz") * (F.col("yy") - F.col("t")) - F.col("yz") * F.col("xy"), 2 * F.col("det"))
    cy = F.try_divide(F.col("yz") * (F.col("xx") - F.col("t")) - F.col("xz") * F.col("xy"), 2 * F.col("det"))
    m = m.withColumn("ux", cx).withColumn("uy", cy)
    return m.select(*group, (F.col("ux") + F.col("mx")).alias("cx"), (F.col("uy") + F.col("my")).alias("cy"), F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("mz")).alias("radius"))


def radius_of_curvature(points: DataFrame) -> DataFrame:
    """A5: omega = length / 4 pi, and the distance at which the bend's centre is set.

    The centre lies on the line from the middle point to the fitted circle's centre at
    omega times the reach of that line over the radius.
    """
    circle = fitted_circle(points)
    o = Window.partitionBy(*BEND).orderBy("idx")
    step = step_length(F.col("x") - F.lag("x").over(o), F.col("y") - F.lag("y").over(o))
    p = points.withColumn("_s", F.sum(F.coalesce(step, F.lit(0.0))).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("_half", F.max("_s").over(Window.partitionBy(*BEND)) / 2)
    mid = p.groupBy(*BEND).agg(F.min_by(F.struct("x", "y"), F.struct(F.abs(F.col("_s") - F.col("_half")), F.col("idx"))).alias("m"), F.max("_s").alias("lambda_hm"))
    out = mid.join(circle, BEND)
    omega = F.col("lambda_hm") / (4 * math.pi)
    reach = step_length(F.col("cx") - F.col("m.x"), F.col("cy") - F.col("m.y"))
    return out.select(*BEND, "cx", "cy", "radius", (F.try_divide(reach, F.col("radius")) * omega).alias("R_hm"))


def most_frequent(points: DataFrame, column: str) -> DataFrame:
    """The commonest value of each bend, the least on a tie."""
    counts = points.where(F.col(column).isNotNull()).groupBy(*BEND, column).count()
    return counts.groupBy(*BEND).agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias(column))


def reach_metrics(bend_table: DataFrame) -> DataFrame:
    """Sinuosities of every tree and, as tree_id -1, of the whole river.

    Grouping sets give both levels from one pass; full meanders step over every second
    bend, numbered inside each level.
    """
    both = bend_table.withColumn("tree_id", F.explode(F.array(F.lit(-1).cast("long"), F.col("tree_id").cast("long"))))
    level = Window.partitionBy("river_id", "tree_id").orderBy("bend_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("river_id", "tree_id"))
    b = both.withColumn("k", F.row_number().over(level) - 1).withColumn("n", n)
    # stations of full meanders: starts of every second bend, then the last end
    at = b.where((F.col("k") % 2 == 0) & (F.col("k") < F.col("n") - 1)).select("river_id", "tree_id", "k", F.col("x_start").alias("px"), F.col("y_start").alias("py"))
    last = b.where("k = n - 1").select("river_id", "tree_id", F.col("n").alias("k"), F.col("x_end").alias("px"), F.col("y_end").alias("py"))
    w = Window.partitionBy("river_id", "tree_id").orderBy("k")
    steps = at.unionByName(last).withColumn("X", step_length(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)))
    full = steps.groupBy("river_id", "tree_id").agg(F.sum("X").alias("sum_X"))
    half = b.groupBy("river_id", "tree_id").agg(
        F.sum("lambda_fm").alias("sum_l"), F.sum("L_fm").alias("sum_Y"), F.avg("lambda_fm").alias("mean_half_meander_length"),
        F.min_by("x_start", "k").alias("x0"), F.min_by("y_start", "k").alias("y0"), F.max_by("x_end", "k").alias("x1"), F.max_by("y_end", "k").alias("y1"),
    )
    d = step_length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    out = half.join(full, ["river_id", "tree_id"], "left").withColumn("D", d)
    return out.select(
        "river_id", "tree_id", "D", F.try_divide("sum_l", "D").alias("total_sinuosity"), F.try_divide("sum_l", "sum_Y").alias("half_meander_sinuosity"),
        F.try_divide("sum_Y", "sum_X").alias("full_meander_sinuosity"), F.try_divide("sum_X", "D").alias("residual_meander_sinuosity"), "mean_half_meander_length",
    )


def valid_bends(bend_table: DataFrame, n_points: DataFrame) -> DataFrame:
    """bends of more than one point and at most 0.8 of the river, renumbered in order of s."""
    b = bend_table.join(n_points, "river_id")
    b = b.where("idx_end > idx_start and (idx_end - idx_start) <= 0.8 * n_river")
    order = Window.partitionBy("river_id").orderBy("s_middle", "bend_id")
    return b.withColumn("meander_id", (F.row_number().over(order) - 1).cast("long"))


def clipped(bend_table: DataFrame, side: str) -> DataFrame:
    """Starts moved back to the end before (downstream), or ends on to the start after (upstream)."""
    order = Window.partitionBy("river_id").orderBy("idx_start", "bend_id")
    if side == "downstream":
        return bend_table.withColumn("idx_start", F.least("idx_start", F.lag("idx_end").over(order)))
    if side == "upstream":
        return bend_table.withColumn("idx_end", F.greatest("idx_end", F.lead("idx_start").over(order)))
    raise ValueError(f"unknown side {side}")
