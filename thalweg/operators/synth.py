"""Kinoshita meander trains as table generators.

Implements: C14, C15. Both give river_id, idx, s, c, x, y.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Points whose steps are added up in one task.
BLOCK = 1 << 16


def _stations(spark: SparkSession, wavelength: float, n: int, m_points: int, ds: float | None, more: int = 0) -> tuple[DataFrame, int, float]:
    """Stations (and ``more`` rows after them), their number and step.

    With ``ds`` they run from zero below the length plus one step.
    """
    step = n * wavelength / (m_points - 1) if ds is None else ds
    m = m_points if ds is None else math.ceil((n * wavelength + ds) / ds)
    s = F.lit(n) * F.lit(wavelength) / F.lit(float(m_points - 1)) * F.col("id") if ds is None else F.col("id") * ds
    return spark.range(m + more).select(F.col("id").alias("idx"), s.cast("double").alias("s")), m, step


def _drawn(points: DataFrame, theta: Column, step: float, m: int, river: str) -> DataFrame:
    """Steps along the heading added up: inside blocks, then over the blocks' sums."""
    out = points.withColumns({"river_id": F.lit(river), "block": F.floor(F.col("idx") / BLOCK), "theta": theta})
    out = out.withColumns({"dx": F.lit(step) * F.cos("theta"), "dy": F.lit(step) * F.sin("theta")})
    inside = Window.partitionBy("river_id", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("river_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = out.groupBy("river_id", "block").agg(F.sum("dx").alias("bx"), F.sum("dy").alias("by"))
    sums = sums.select("river_id", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("bx", "by")))
    own = {x: F.coalesce(F.sum(f"d{x}").over(inside), F.lit(0.0)) for x in "xy"}
    out = out.withColumns(own).join(sums, ["river_id", "block"])
    known = lambda c: F.when(F.col("idx") < m, F.col(c)).alias(c)
    return out.select("river_id", "idx", known("s"), known("c"), (F.col("x") + F.col("bx")).alias("x"), (F.col("y") + F.col("by")).alias("y"))


def zolezzi(spark: SparkSession, theta0: float, wavelength: float, theta_s: float, theta_f: float, n: int, m_points: int = 1000, ds: float | None = None, river: str = "kinoshita") -> DataFrame:
    """Heading theta0 cos ks + theta_s sin 3ks + theta_f cos 3ks.

    The last station's step is drawn too, so one point follows that has no s and c.
    """
    p, m, step = _stations(spark, wavelength, n, m_points, ds, more=1)
    k = 2 * math.pi / wavelength
    a, b = k * F.col("s"), 3 * k * F.col("s")
    p = p.withColumn("c", -k * (theta0 * F.sin(a) - 3 * theta_s * F.cos(b) + 3 * theta_f * F.sin(b)))
    return _drawn(p, theta0 * F.cos(a) + theta_s * F.sin(b) + theta_f * F.cos(b), step, m, river)


def abad(spark: SparkSession, theta0: float, wavelength: float, j_s: float, j_f: float, n: int, m_points: int = 1000, ds: float | None = None, legacy: bool = False, river: str = "kinoshita") -> DataFrame:
    """C14: heading theta0 sin ks + theta0^3 (Js cos 3ks - Jf sin 3ks); c is its derivative.

    ``legacy`` takes the Jf term out of the cubic bracket, as older outputs have it.
    """
    p, m, step = _stations(spark, wavelength, n, m_points, ds)
    k = 2 * math.pi / wavelength
    a, b = k * F.col("s"), 3 * k * F.col("s")
    bracket = j_s * F.sin(b) if legacy else j_s * F.sin(b) + j_f * F.cos(b)
    c = k * theta0 * F.cos(a) - 3 * k * theta0**3 * bracket
    p = p.withColumn("c", c + j_f * F.cos(b) if legacy else c)
    return _drawn(p, theta0 * F.sin(a) + theta0**3 * (j_s * F.cos(b) - j_f * F.sin(b)), step, m, river)
