"""Operators that need a river's or a bend's points as arrays: splines, smoothing, shapes.

Points of a group are gathered in order into one row and go through a numpy kernel in
Arrow batches. A group here is one river or one bend: what a kernel needs whole.

Implements: W14, W16-W19, W22-W25, A8, X17.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions import kernels
from thalweg.functions.batches import slices
from thalweg.operators import splines
from thalweg.operators.ordered import gradient, interpolated, previous
from thalweg.sources.scratch import written


def per_group(points: DataFrame, group: list[str], columns: list[str], kernel: Callable[..., dict[str, np.ndarray | list]], result: str) -> DataFrame:
    """Rows that ``kernel`` makes of each group's column arrays (ordered by idx).

    ``result`` is the schema of the kernel's columns; the group's keys come before them.
    """
    gathered = F.sort_array(F.collect_list(F.struct("idx", *columns)))
    rows = points.groupBy(*group).agg(gathered.alias("p"))
    rows = rows.select(*group, *(F.col(f"p.{c}").alias(c) for c in columns))
    keys = ", ".join(f"{g} {points.schema[g].dataType.simpleString()}" for g in group)
    names = [x.split()[0] for x in result.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept: list[list] = [[] for _ in group]
            made: dict[str, list] = {n: [] for n in names}
            for i in range(batch.num_rows):
                arrays = [np.array(batch.column(c)[i].as_py(), float) for c in columns]
                out = kernel(*arrays)
                count = len(out[names[0]])
                for k, g in enumerate(group):
                    kept[k] += [batch.column(g)[i].as_py()] * count
                for n in names:
                    made[n] += [None if isinstance(v, float) and np.isnan(v) else v for v in (out[n].tolist() if isinstance(out[n], np.ndarray) else out[n])]
            types = [batch.schema.field(g).type for g in group]
            arrays_ = [pa.array(v, t) for v, t in zip(kept, types, strict=True)]
            kinds = {"long": pa.int64(), "double": pa.float64()}
            arrays_ += [pa.array(made[x.split()[0]], kinds[x.split()[1]]) for x in result.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays_, names=[*group, *names])

    return rows.mapInArrow(each, f"{keys}, {result}")


STEPS = ("geometric_mean", "mean", "min", "min_width", "geometric_mean_width")


def _step(rule: str | float, s: np.ndarray, w: np.ndarray) -> float:
    if not isinstance(rule, str):
        return float(rule)
    if rule.endswith("width") and not np.isfinite(w).all():
        raise ValueError(f"the step {rule} needs every width")
    d = np.diff(s)
    known = {"geometric_mean": lambda: 10 ** np.log10(d).mean(), "mean": d.mean, "min": d.min, "min_width": lambda: w.min(), "geometric_mean_width": lambda: 10 ** np.log10(w).mean()}
    return float(known[rule]())


def _checked(step: str | float | None) -> str | float:
    rule = step or "geometric_mean"
    if isinstance(rule, str) and rule not in STEPS:
        raise ValueError(f"unknown step {rule}; known are {', '.join(STEPS)}")
    return rule


def resampled(points: DataFrame, step: str | float | None = None, smooth: float = 0.0, order: int = 3, ext: int = 0, per_point: bool = False) -> DataFrame:
    """The spline through (s, x, y) at a regular step, with its derivatives.

    ``step`` is a length or one of ``STEPS``, by each river's own steps (the geometric mean
    by default) or widths w_m. With a positive ``smooth``, or another order than 3, the
    curve comes from ``splines.fitted`` and ``ext`` says what lies beyond the last point;
    derivatives of a line of order 1 are differences. Repeated s keep their first point.
    """
    rule = _checked(step)
    if smooth > 0 or order != 3 or ext:
        return resampled_from(splines.fitted(points, order, smooth, per_point=per_point), points, rule, ext)

    def kernel(s: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
        s, first = np.unique(s, return_index=True)
        x, y, w = x[first], y[first], w[first]
        if len(s) < 2:
            return {k: np.zeros(0) for k in ("k", "s", "x", "y", "dxds", "dyds", "d2xds2", "d2yds2")}
        ds = _step(rule, s, w)
        at = np.arange(s[0], s[-1] + ds / 2, ds)
        (xs, x1, x2), (ys, y1, y2) = kernels.spline(s, x, at), kernels.spline(s, y, at)
        return {"k": np.arange(len(at)), "s": at, "x": xs, "y": ys, "dxds": x1, "dyds": y1, "d2xds2": x2, "d2yds2": y2}

    width = F.col("w_m") if "w_m" in points.columns else F.lit(None).cast("double")
    result = "k long, s double, x double, y double, dxds double, dyds double, d2xds2 double, d2yds2 double"
    return per_group(points.withColumn("_w", width), ["river_id"], ["s", "x", "y", "_w"], kernel, result)


def stations(points: DataFrame, step: str | float | None = None) -> DataFrame:
    """river_id, k, s at a regular step from the first point, by one of ``STEPS`` or a length."""
    rule = _checked(step)
    width = F.col("w_m") if "w_m" in points.columns else F.lit(None).cast("double")
    first = points.groupBy("river_id", "s").agg(F.min_by(F.struct(width.alias("w")), "idx").alias("f"))
    rows = first.select("river_id", "s", F.col("f.w").alias("w"), (F.col("s") - F.lag("s").over(Window.partitionBy("river_id").orderBy("s"))).alias("d"))
    whole = F.when(F.count_if(F.col("w").isNull() | F.isnan("w")) > 0, F.raise_error(F.lit(f"the step {rule} needs every width")).cast("double"))
    length = {
        "geometric_mean": F.pow(F.lit(10.0), F.avg(F.log10("d"))), "mean": F.avg("d"), "min": F.min("d"),
        "min_width": whole.otherwise(F.min("w")), "geometric_mean_width": whole.otherwise(F.pow(F.lit(10.0), F.avg(F.log10("w")))),
    }
    ds = length[rule] if isinstance(rule, str) else F.lit(float(rule))
    ends = rows.groupBy("river_id").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), ds.alias("ds")).where("s1 > s0")
    k = F.sequence(F.lit(0).cast("long"), F.ceil((F.col("s1") - F.col("s0") + F.col("ds") / 2) / F.col("ds")).cast("long") - 1)
    return ends.select("river_id", "s0", "ds", F.explode(k).alias("k")).select("river_id", "k", (F.col("s0") + F.col("k") * F.col("ds")).alias("s"))


def resampled_from(table: DataFrame, points: DataFrame, step: str | float | None = None, ext: int = 0) -> DataFrame:
    """``resampled`` from a table of splines that is at hand: a table of order 1 has differences for derivatives."""
    table = written(table, "spline-table")
    out = splines.at_stations(table, stations(points, step), derivatives=(0, 1, 2), ext=ext)
    straight = table.groupBy("river_id").agg((F.max(F.size("c")) == 2).alias("straight"))
    by_k = Window.partitionBy("river_id").orderBy("k")
    first = {f"_{c}1": gradient(F.col(c), F.col("s"), by_k) for c in "xy"}
    second = {f"_{c}2": gradient(F.col(f"_{c}1"), F.col("s"), by_k) for c in "xy"}
    out = out.join(straight, "river_id").withColumns(first).withColumns(second)
    slope = lambda c, own: F.when(F.col("straight"), F.col(own)).otherwise(F.col(c)).alias(c)
    return out.select("river_id", "k", "s", "x", "y", slope("dxds", "_x1"), slope("dyds", "_y1"), slope("d2xds2", "_x2"), slope("d2yds2", "_y2"))


def resampled_table(points: DataFrame, step: str | float | None = None, smooth: float = 0.0, order: int = 3, ext: int = 0) -> DataFrame:
    """``resampled`` with all that the points have: river_id, idx, s, x, y and derivatives; z, da_sqkm and w_m
    by straight lines, carried on beyond the ends; comid, so and within_waterbody from the point before.
    ``smooth`` is the mean squared distance of x and of y from the points.
    """
    out = written(resampled(points, step, smooth, order, ext, per_point=True), "resampled")
    at = out.select("river_id", "s", "k")
    for names, how in ((("z", "da_sqkm", "w_m"), interpolated), (("comid", "so", "within_waterbody"), previous)):
        for c in names:
            if c in points.columns:
                out = out.join(how(points, at, c).select("river_id", "k", c), ["river_id", "k"])
    return out.withColumnRenamed("k", "idx")


def smoothed(points: DataFrame, order: int, window: int, gaussian: int) -> DataFrame:
    """X and y smoothed; s stays that of the unsmoothed line."""

    def kernel(idx: np.ndarray, s: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
        if len(s) <= max(window, gaussian):
            return {"k": idx.astype(int), "s": s, "x_smooth": x, "y_smooth": y}
        ds = float(np.diff(s).mean())
        return {"k": idx.astype(int), "s": s, "x_smooth": kernels.smooth(x, ds, order, window, gaussian), "y_smooth": kernels.smooth(y, ds, order, window, gaussian)}

    return per_group(points.withColumn("at", F.col("idx")), ["river_id"], ["at", "s", "x", "y"], kernel, "k long, s double, x_smooth double, y_smooth double")


def extended_bounds(points: DataFrame, bends: DataFrame) -> DataFrame:
    """Bend bounds moved out to the next opposite extremes of c on either side.

    ``bends`` has river_id, bend_id, idx_start, idx_end. A river's curvature and its
    bends meet once, as two arrays.
    """
    c = points.groupBy("river_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("c", F.lit(0.0)).alias("c")))).alias("p"))
    b = bends.groupBy("river_id").agg(F.sort_array(F.collect_list(F.struct("bend_id", "idx_start", "idx_end"))).alias("b"))
    both = c.join(b, "river_id").select("river_id", F.col("p.c").alias("c"), F.col("b.bend_id").alias("bend_id"), F.col("b.idx_start").cast("array<long>").alias("a"), F.col("b.idx_end").cast("array<long>").alias("z"))
    kind = points.schema["river_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            lists = [pc.list_flatten(batch.column(i)) for i in (2, 3, 4)]
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            a, z = (x.to_numpy(zero_copy_only=False) for x in lists[1:])
            made, low = [], 0
            for i, n in enumerate(size.tolist()):
                made.append(kernels.extended_all(batch.column(1)[i].values.to_numpy(zero_copy_only=False), a[low : low + n], z[low : low + n]))
                low += n
            starts, ends = (np.concatenate(x) for x in zip(*made, strict=True))
            of = pa.array(np.repeat(np.arange(len(size)), size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), lists[0].cast(pa.int64()), pa.array(starts), pa.array(ends)], names=["river_id", "bend_id", "ext_start", "ext_end"])

    return both.mapInArrow(each, f"river_id {kind}, bend_id long, ext_start long, ext_end long")


def funneling(points: DataFrame) -> DataFrame:
    """Lobe width, neck width and their ratio of each bend; null without a neck."""

    def kernel(x: np.ndarray, y: np.ndarray) -> dict:
        lobe, neck, ratio = kernels.funneling(x, y, 0, len(x) - 1) if len(x) > 2 else (np.nan,) * 3
        return {"L_l": [lobe], "L_n": [neck], "FF": [ratio]}

    return per_group(points, ["river_id", "bend_id"], ["x", "y"], kernel, "L_l double, L_n double, FF double")


def marked_inflections(points: DataFrame) -> DataFrame:
    """S of the two inflections of each bend marked by hand."""

    def kernel(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
        a, b = kernels.marked_inflections(s, x, y)
        return {"s_inf_start": [a], "s_inf_end": [b]}

    return per_group(points, ["river_id", "bend_id"], ["s", "x", "y"], kernel, "s_inf_start double, s_inf_end double")
