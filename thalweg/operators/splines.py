"""Splines of rivers as tables: fitted once, stored, evaluated anywhere.

A table of splines has one row for each interval between knots: river_id, dim (the
column that was fitted), low, high and ``c``, the polynomial's coefficients in powers of
s - low. Stations look their interval up in one sorted pass and are evaluated by Spark
expressions.

Splines through all points are solved by river. Smoothing splines choose their knots from
the residual: the points give the products of their basis functions, summed by
interval; the small band system of a river gives its coefficients; residuals are summed by
interval again and the worst intervals are split at their middle point, as many as the fall
of the residual foretells, until it is at most ``smooth``; then, of the splines on these
knots with just that residual, the one of least jumps is taken. A river of at most
``MOST_POINTS`` goes through these rounds as an array, many rivers together; for longer ones
every round is a few jobs, whose sums are made where the points lie, and a task meets a
river's knots, never its points.

Implements: W22, W25.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions import bsplines
from thalweg.functions.batches import slices
from thalweg.operators.ordered import whole
from thalweg.sources.scratch import dropped, written

ORDERS = range(1, 6)
#: Share of ``smooth`` by which a residual may miss it.
TOLERANCE = 1e-3
#: Points up to which a smoothed river is an array of one task; a longer one goes by rounds of jobs.
MOST_POINTS = 20_000
#: Values that are smoothed together in a task; a point takes some 400 bytes there.
MOST_VALUES = 100_000

_TABLE = "low double, high double, c array<double>"
_KEY = ["river_id", "dim"]


def _values(points: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """river_id, dim, s, idx, v: each column's known values."""
    rows = points.where("s is not null").select("river_id", "idx", "s", F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.col(c).cast("double").alias("v")) for c in columns))).alias("d"))
    return rows.select("river_id", "d.dim", "s", "idx", "d.v").where("v is not null")


def _series(points: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """river_id, dim, i, s, v: each column's values in order of s, the first point of each s."""
    rows = _values(points, columns).groupBy(*_KEY, "s").agg(F.min_by("v", "idx").alias("v"))
    return rows.withColumn("i", (F.row_number().over(Window.partitionBy(*_KEY).orderBy("s")) - 1).cast("long"))


def _through(series: DataFrame, order: int) -> DataFrame:
    """Splines through all points, solved by river and column."""
    gathered = series.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("s", "v"))).alias("p")).where(F.size("p") > 1)
    kind = series.schema["river_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i in range(batch.num_rows):
                s, v = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                t, c, k = bsplines.interpolated(s, v, order)
                ends = np.unique(t)
                n = len(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type), pa.array([batch.column(1)[i].as_py()] * n), pa.array(ends[:-1]), pa.array(ends[1:]),
                     pa.array(bsplines.powers(t, k, c).tolist(), pa.list_(pa.float64()))],
                    names=[*_KEY, "low", "high", "c"],
                )

    return gathered.select(*_KEY, F.col("p.s").alias("s"), F.col("p.v").alias("v")).mapInArrow(each, f"river_id {kind}, dim string, {_TABLE}")


def _straight(series: DataFrame) -> DataFrame:
    """``_through`` of order 1: from each point a straight line to the next."""
    by = Window.partitionBy(*_KEY).orderBy("s")
    both = series.select(*_KEY, F.col("s").alias("low"), "v", F.lead("s").over(by).alias("high"), F.lead("v").over(by).alias("next")).where("high is not null")
    return both.select(*_KEY, "low", "high", F.array("v", (F.col("next") - F.col("v")) / (F.col("high") - F.col("low"))).alias("c"))


def _basis(order: int, local: str = "t", s: str = "s") -> tuple[list[dict[str, Column]], list[str]]:
    """Columns of the recursion of Cox and de Boor, level by level, and the names of the last.

    ``local`` holds the 2 * order knots around the interval.
    """
    levels, names = [], ["_b0_0"]
    levels.append({"_b0_0": F.lit(1.0)})
    knot = lambda m: F.col(local)[m]  # noqa: E731  of t[j + 1 - order + m]
    for d in range(1, order + 1):
        shares = [F.col(names[r]) / (knot(order + r) - knot(order - d + r)) for r in range(d)]
        parts = [F.lit(0.0)] * (d + 1)
        for r, share in enumerate(shares):
            parts[r] = parts[r] + share * (knot(order + r) - F.col(s))
            parts[r + 1] = parts[r + 1] + share * (F.col(s) - knot(order - d + r))
        names = [f"_b{d}_{r}" for r in range(d + 1)]
        levels.append(dict(zip(names, parts, strict=True)))
    return levels, names


def _in_intervals(series: DataFrame, knots: DataFrame, ends: DataFrame, order: int) -> DataFrame:
    """The points with their interval ``q``, the knots ``t`` around it and whether they are one (``at_knot``)."""
    marked = series.join(knots.withColumn("at_knot", F.lit(1)), [*_KEY, "i"], "left")
    so_far = Window.partitionBy(*_KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"at_knot": F.coalesce("at_knot", F.lit(0)), "q": F.coalesce(F.sum("at_knot").over(so_far), F.lit(0)).cast("long")})
    inner = series.join(knots, [*_KEY, "i"], "left_semi").groupBy(*_KEY).agg(F.sort_array(F.collect_list("s")).alias("inner"))
    rows = ends.join(inner, _KEY, "left").withColumn("inner", F.coalesce("inner", F.array().cast("array<double>")))
    full = F.concat(F.array_repeat(F.col("s0"), order + 1), F.col("inner"), F.array_repeat(F.col("s1"), order + 1))
    every = F.sequence(F.lit(0), F.size("inner"))
    rows = rows.withColumn("full", full).select(*_KEY, "v0", F.posexplode(F.transform(every, lambda q: F.slice("full", q + 2, 2 * order))).alias("q", "t"))
    return marked.join(rows.withColumn("q", F.col("q").cast("long")), [*_KEY, "q"])


def _sums(points: DataFrame, order: int) -> DataFrame:
    """For each interval the sums of the products of its basis functions, with each other and with v - v0, and its points."""
    levels, names = _basis(order)
    for level in levels:
        points = points.withColumns(level)
    v = F.col("v") - F.col("v0")
    pairs = [F.sum(F.col(names[a]) * F.col(names[b])) for a in range(order + 1) for b in range(a, order + 1)]
    return points.groupBy(*_KEY, "q").agg(
        F.array(*pairs).alias("products"), F.array(*(F.sum(F.col(b) * v) for b in names)).alias("values"), F.first("t").alias("t"), F.first("v0").alias("v0"),
    )


def _solve(sums: DataFrame, order: int, final: bool) -> DataFrame:
    """Each river's system from its intervals' sums: river_id, dim, q, low, high, c.

    In the ``final`` pass the rows also carry ``least`` and ``smooth``, and the spline of least jumps is taken.
    """
    last = [F.first("least").alias("least"), F.first("smooth").alias("smooth")] if final else []
    by = sums.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("q", "products", "values", "t"))).alias("p"), F.first("v0").alias("v0"), *last)
    kind = sums.schema["river_id"].dataType.simpleString()
    rows = by.select(*_KEY, "v0", F.col("p.products").alias("products"), F.col("p.values").alias("values"), F.col("p.t").alias("t"), *(["least", "smooth"] if final else []))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stacks: dict[int, list[dict]] = {}  # series of equally many intervals are solved together
            for row in batch.to_pylist():
                stacks.setdefault(len(row["t"]), []).append(row)
            for n, stack in stacks.items():
                of = lambda name, stack=stack: np.array([row[name] for row in stack])
                local = of("t")
                low, high = local[:, :, order - 1], local[:, :, order]
                t = np.concatenate([np.repeat(low[:, :1], order + 1, axis=1), low[:, 1:], np.repeat(high[:, -1:], order + 1, axis=1)], axis=1)
                band, rhs = bsplines.assembled(of("products"), of("values"), order)
                c = bsplines.smoothed(t, order, band, rhs, of("least"), of("smooth")) if final else bsplines.solved(band, rhs)
                for i, row in enumerate(stack):
                    coefficients = bsplines.powers(t[i], order, c[i])
                    coefficients[:, 0] += row["v0"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["river_id"]] * n, batch.schema.field(0).type), pa.array([row["dim"]] * n), pa.array(np.arange(n)), pa.array(low[i]), pa.array(high[i]),
                         pa.array(coefficients.tolist(), pa.list_(pa.float64()))],
                        names=[*_KEY, "q", "low", "high", "c"],
                    )

    return rows.mapInArrow(each, f"river_id {kind}, dim string, q long, {_TABLE}")


def polynomial(c: Column, u: Column, order: int = 0) -> Column:
    """Value, or derivative of that order, of the polynomial with coefficients ``c``."""
    falling = lambda i: reduce(lambda p, m: p * (i - m), range(order), F.lit(1.0))
    terms = F.slice(F.transform(c, lambda x, i: x * falling(i)), order + 1, F.greatest(F.size(c) - order, F.lit(0)))
    return F.aggregate(F.reverse(terms), F.lit(0.0), lambda done, x: done * u + x)


def _residuals(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """By interval: squared distances inside, those of its first point where that is a knot (half), and its inner points."""
    both = points.join(pieces, [*_KEY, "q"]).withColumn("d", F.col("v") - polynomial(F.col("c"), F.col("s") - F.col("low")))
    own = F.col("d") * F.col("d")
    return both.groupBy(*_KEY, "q").agg(
        F.sum(F.when(F.col("at_knot") == 0, own).otherwise(own / 2)).alias("inside"), F.sum(F.when(F.col("at_knot") == 1, own / 2).otherwise(0.0)).alias("shared"),
        F.min("i").alias("first"), F.max("i").alias("last"),
    )


def _split(residuals: DataFrame, state: DataFrame) -> DataFrame:
    """The next state of each series: river_id, dim, smooth, before (residual), added, least, done and ``chosen`` (new knots)."""
    listed = residuals.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("q", "inside", "shared", "first", "last"))).alias("p"))
    rows = listed.join(state, _KEY)
    kind = state.schema["river_id"].dataType.simpleString()

    def judge(row: dict) -> dict:
        p, smooth = row["p"], row["smooth"]
        shared = [x["shared"] for x in p[1:]] + [0.0]
        parts = [x["inside"] + more for x, more in zip(p, shared, strict=True)]
        total, added, done, chosen = bsplines.judged(parts, [x["first"] for x in p], [x["last"] for x in p], smooth, TOLERANCE, row["before"], row["added"])
        return {"smooth": smooth, "before": total, "least": total, "done": done, "added": added, "chosen": chosen}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["smooth", "before", "added", "least", "done", "chosen"]
        kinds = [pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int64())]
        for batch in slices(batches):
            made = [judge(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[n] for m in made], k) for n, k in zip(names, kinds, strict=True))], names=[*_KEY, *names])

    picked = rows.select(*_KEY, "p", "smooth", "before", "added")
    return picked.mapInArrow(each, f"river_id {kind}, dim string, smooth double, before double, added long, least double, done boolean, chosen array<long>")


def _as_arrays(points: DataFrame, columns: tuple[str, ...], order: int, smooth: float, per_point: bool) -> DataFrame:
    """Smoothing splines of rivers whose points fit into an array: the same rounds, inside one task for the rivers of a slice."""
    rows = _values(points, columns).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("s", "idx", "v"))).alias("p"))
    kind = points.schema["river_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, MOST_VALUES):
            series, found = [], []
            for i in range(batch.num_rows):
                s, v = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                s, first = np.unique(s, return_index=True)
                series.append((s, v[first]))
            sizes = np.array([len(s) for s, _ in series], int)
            for i in np.flatnonzero((sizes > 1) & (sizes <= order + 1)).tolist():
                t, c, k = bsplines.interpolated(*series[i], order)
                ends = np.unique(t)
                found.append((np.array([i]), ends[None, :-1], ends[None, 1:], bsplines.powers(t, k, c)[None]))
            some = np.flatnonzero(sizes > order + 1)
            if len(some):
                s, v = (np.concatenate([series[i][k] for i in some.tolist()]) for k in (0, 1))
                limits = smooth * (sizes[some] if per_point else np.ones(len(some)))
                found += [(some[j], *rest) for j, *rest in bsplines.smoothing(s, v, sizes[some], order, limits, TOLERANCE)]
            for j, low, high, c in found:
                of = pa.array(np.repeat(j, low.shape[1]))
                width = c.shape[2]
                coefficients = pa.ListArray.from_arrays(pa.array(np.arange(0, low.size * width + 1, width), pa.int32()), pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(low.ravel()), pa.array(high.ravel()), coefficients], names=[*_KEY, "low", "high", "c"])

    return rows.select(*_KEY, F.col("p.s").alias("s"), F.col("p.v").alias("v")).mapInArrow(each, f"river_id {kind}, dim string, {_TABLE}")


def _smoothing(series: DataFrame, order: int, smooth: float, per_point: bool) -> DataFrame:
    """Smoothing splines of long rivers, in rounds that leave out the finished ones."""
    series = written(series, "series")
    ends = series.groupBy(*_KEY).agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min_by("v", "i").alias("v0"), F.count(F.lit(1)).alias("n"))
    ends = written(ends.withColumn("smooth", F.lit(float(smooth)) * (F.col("n") if per_point else 1)), "series-ends")
    short = ends.where(F.col("n") <= order + 1)  # a spline through all points
    out = [_through(series.join(short, _KEY, "left_semi"), order)]
    state = ends.where(F.col("n") > order + 1).select(*_KEY, "smooth", F.lit(None).cast("double").alias("before"), F.lit(0).cast("long").alias("added"))
    none = series.sparkSession.createDataFrame([], series.select(*_KEY, "i").schema)
    knots, spent = none, []
    while True:  # each round ends a series or gives it more knots, of which its points are the limit
        open_ = series.join(state.select(*_KEY), _KEY, "left_semi")
        points = _in_intervals(open_, knots, ends.select(*_KEY, "s0", "s1", "v0"), order)
        sums = written(_sums(points, order), "spline-sums")
        pieces = written(_solve(sums, order, False), "spline-pieces")
        now = written(_split(_residuals(points, pieces), state), "spline-state")
        finished = now.where("done").select(*_KEY, "least", "smooth")
        out.append(written(_solve(sums.join(finished, _KEY), order, True).drop("q"), "splines"))
        state = now.where("not done").select(*_KEY, "smooth", "before", "added")
        if not state.limit(1).count():
            break
        new = now.where("not done").select(*_KEY, F.explode("chosen").alias("i"))
        kept = knots.join(state.select(*_KEY), _KEY, "left_semi") if spent else none
        last, knots = knots, written(kept.unionByName(new), "spline-knots")
        for table in (sums, pieces, *([last] if spent else [])):
            dropped(table)
        spent.append(now)
    for table in spent:
        dropped(table)
    return reduce(DataFrame.unionByName, out)


def fitted(points: DataFrame, order: int = 3, smooth: float = 0.0, columns: tuple[str, ...] = ("x", "y"), per_point: bool = False) -> DataFrame:
    """The table of splines of ``columns`` over s: river_id, dim, low, high, c.

    With ``smooth`` 0 they go through all points; otherwise squared distances sum to it (to
    ``smooth`` times the number of points with ``per_point``), or to less where a single
    polynomial does that. A river of too few points gets a lower order, and one of a
    single point no spline; repeated s keep their first point.
    """
    if order not in ORDERS:
        raise ValueError(f"the order has to be one of {ORDERS.start} to {ORDERS.stop - 1}")
    if smooth < 0:
        raise ValueError("smooth has to be at least 0")
    if smooth > 0:
        size = F.count(F.lit(1)).over(whole())
        points = written(points.select("river_id", "idx", "s", *(c for c in columns if c != "s"), size.alias("_n")), "spline-points")
        # dealt by the number of points, which the files' footers know, not by bytes: the work is in the points
        parts = max(points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // MOST_VALUES))
        out = _as_arrays(points.where(F.col("_n") <= MOST_POINTS).repartition(parts, "river_id"), columns, order, smooth, per_point)
        long = points.where(F.col("_n") > MOST_POINTS)
        return out.unionByName(_smoothing(_series(long, columns), order, smooth, per_point)) if long.limit(1).count() else out
    series = _series(points, columns)
    return _straight(series) if order == 1 else _through(series, order)


#: What is made of stations beyond the ends: the outer polynomial, nothing but 0, an error, the value at the end.
EXTENSIONS = ("extrapolate", "zeros", "raise", "boundary")


def _met(table: DataFrame, stations: DataFrame, ext: int, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The stations by dim, each with the piece ``own`` that it lies in, and the line's ``start`` and ``end``.

    With ``columns`` given the table is read once, else a second time for what it holds.
    """
    if not 0 <= ext < len(EXTENSIONS):
        raise ValueError(f"ext numbers {', '.join(EXTENSIONS)}")
    piece = F.struct("low", "high", "c")
    knots = table.select("river_id", "dim", F.col("low").alias("at"), piece.alias("p"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("k"))
    asked = stations.select("river_id", F.col("k").cast("long").alias("k"), F.col("s").alias("at"))
    if columns is None:
        asked = asked.join(table.select("river_id", "dim").distinct(), "river_id")
    else:
        knots, asked = knots.where(F.col("dim").isin(*columns)), asked.withColumn("dim", F.explode(F.array(*(F.lit(c) for c in columns))))
    asked = asked.select("river_id", "dim", "at", F.lit(None).alias("p"), F.lit(1).alias("kind"), "k")
    by = Window.partitionBy("river_id", "dim")
    order = by.orderBy("at", "kind", "k").rowsBetween(Window.unboundedPreceding, 0)
    both = knots.unionByName(asked).withColumns({
        "own": F.last("p", ignorenulls=True).over(order), "outer": F.min_by("p", F.when(F.col("kind") == 0, F.col("at"))).over(by), "end": F.max("p.high").over(by),
    }).where("kind = 1 and outer is not null")
    return both.withColumns({"own": F.coalesce("own", "outer"), "start": F.col("outer.low")})


def _value(derivative: int, ext: int) -> Column:
    """Value, or derivative, of the station's own piece of ``_met``."""
    outside = (F.col("at") < F.col("start")) | (F.col("at") > F.col("end"))
    s = F.greatest("start", F.least("end", "at")) if ext == 3 else F.col("at")
    value = polynomial(F.col("own.c"), s - F.col("own.low"), derivative)
    if ext == 1:
        value = F.when(outside, 0.0).otherwise(value)
    elif ext == 2:
        value = F.when(outside, F.raise_error(F.concat(F.lit("station beyond the ends of the line: "), F.col("at").cast("string"))).cast("double")).otherwise(value)
    elif ext == 3 and derivative:
        value = F.when(outside, 0.0).otherwise(value)
    return value


def evaluated(table: DataFrame, stations: DataFrame, derivative: int = 0, ext: int = 0) -> DataFrame:
    """The splines at stations (river_id, k, s): river_id, k, s and a column for each dim, in long form as (dim, value).

    ``ext`` numbers ``EXTENSIONS``. Intervals and stations are sorted together by s, so
    a station meets its own interval alone; a river without splines gives no row.
    """
    return _met(table, stations, ext).select("river_id", "k", F.col("at").alias("s"), "dim", _value(derivative, ext).alias("value"))


def at_stations(table: DataFrame, stations: DataFrame, columns: tuple[str, ...] = ("x", "y"), derivatives: tuple[int, ...] = (0,), ext: int = 0) -> DataFrame:
    """``evaluated`` with a column for each of ``columns`` and derivative: x, dxds, d2xds2 and so on; all from one sort."""
    name = lambda c, d: c if d == 0 else f"d{c}ds" if d == 1 else f"d{d}{c}ds{d}"
    rows = _met(table, stations, ext, columns).select("river_id", "k", F.col("at").alias("s"), "dim", *(_value(d, ext).alias(f"_{d}") for d in derivatives))
    picked = [F.max(F.when(F.col("dim") == c, F.col(f"_{d}"))).alias(name(c, d)) for d in derivatives for c in columns]
    return rows.groupBy("river_id", "k", "s").agg(*picked)
