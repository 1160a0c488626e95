"""Wavelet spectra of the signals of rivers.

The transform is a kernel per signal inside Arrow batches; everything after it is plain
aggregation over the long table (river_id, j, n, re, im, power).

Implements: C1-C4, C6-C13, F10, F11, X5, A18.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions import kernels
from thalweg.functions.batches import slices
from thalweg.functions.distributions import chi2_quantile
from thalweg.functions.scalar import MOTHERS, fourier_factor

#: Reconstruction factor and value at 0 of the mother wavelets at their defaults.
C_DELTA = {"MORLET": 0.776, "PAUL": 1.132, "DOG": 3.541}
PSI_0 = {"MORLET": math.pi**-0.25, "PAUL": 1.079, "DOG": 0.867}
#: Degrees of freedom, and how fast the mother wavelets forget in time and over scales.
DOF = {"MORLET": 2.0, "PAUL": 2.0, "DOG": 1.0}
DECORRELATION = {"MORLET": (2.32, 0.60), "PAUL": (1.17, 1.5), "DOG": (1.43, 1.4)}


def signals(points: DataFrame, column: str) -> DataFrame:
    """river_id and the column's values in order: a kernel needs one river's signal whole."""
    ordered = F.sort_array(F.collect_list(F.struct("idx", F.col(column).alias("v"))))
    return points.groupBy("river_id").agg(F.transform(ordered, lambda p: p["v"]).alias("signal"))


def cwt(
    signal: DataFrame, dt: float = 1.0, dj: float = 0.05, s0: float | None = None, mother: str = "DOG", m: float | None = None, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Long table of the transform of (river_id, signal). Scales leave one batch at a time.

    Columns of the signal that are ``carried`` stand in every row: what is known of a
    signal as a whole then needs no join with the many rows of its transform.
    """
    kind = signal.schema["river_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y = batch.column(1)[i].as_py()
                if not y or len(y) < 4:
                    continue
                wave, scales = kernels.cwt(np.array(y, float), dt, dj, s0, mother, m)
                n = wave.shape[1]
                for low in range(0, len(scales), 16):
                    part = wave[low : low + 16]
                    rows = part.size
                    same = np.full(rows, i)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([batch.column(0)[i].as_py()] * rows, batch.schema.field(0).type), pa.array(np.repeat(np.arange(low, low + len(part)), n)),
                        pa.array(np.tile(np.arange(n), len(part))), pa.array(np.repeat(scales[low : low + 16], n)),
                        pa.array(part.real.ravel()), pa.array(part.imag.ravel()), pa.array((np.abs(part) ** 2).ravel()),
                        *(batch.column(c).take(pa.array(same)) for c in range(2, 2 + len(carried))),
                    ], names=["river_id", "j", "n", "scale", "re", "im", "power", *carried])

    schema = f"river_id {kind}, j long, n long, scale double, re double, im double, power double"
    schema += "".join(f", {c} {signal.schema[c].dataType.simpleString()}" for c in carried)
    return signal.select("river_id", "signal", *carried).mapInArrow(each, schema)


def coi(n: Column, length: Column, dt: float = 1.0, mother: str = "DOG", m: float | None = None) -> Column:
    """E-folding time at each place; 0 at the two outer places of either end."""
    factor = fourier_factor(mother, MOTHERS[mother] if m is None else m)[1]
    return F.greatest(F.lit(0), F.least(n - 1, length - 2 - n)) * (factor * dt)


def global_spectrum(wave: DataFrame) -> DataFrame:
    """Mean power of each scale."""
    return wave.groupBy("river_id", "j").agg(F.first("scale").alias("scale"), F.avg("power").alias("gws"))


def spectrum_peaks(gws: DataFrame) -> DataFrame:
    """Scales whose mean power is above both neighbours'."""
    w = Window.partitionBy("river_id").orderBy("j")
    top = gws.withColumn("_a", F.lag("gws").over(w)).withColumn("_b", F.lead("gws").over(w))
    return top.where((F.col("gws") > F.col("_a")) & (F.col("gws") > F.col("_b"))).drop("_a", "_b")


def scale_averaged(wave: DataFrame, dt: float, dj: float, mother: str = "DOG") -> DataFrame:
    """Power over scale, summed over the scales, at each place."""
    return wave.groupBy("river_id", "n").agg((F.sum(F.col("power") / F.col("scale")) * (dj * dt / C_DELTA[mother])).alias("sawp"))


def measured(signal: DataFrame) -> DataFrame:
    """The signals that are not empty with n_points and var, their population variance."""
    mean = F.aggregate("signal", F.lit(0.0), lambda a, v: a + v) / F.size("signal")
    var = F.aggregate(F.transform("signal", lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v) / F.size("signal")
    return signal.where(F.size("signal") > 0).withColumns({"n_points": F.size("signal").cast("long"), "var": var})


def variances(signal: DataFrame) -> DataFrame:
    """river_id, n_points and var: the population variance of each signal."""
    return measured(signal).select("river_id", "n_points", "var")


def _exceeded(level: float, mother: str) -> Column:
    """C4: the power that white noise of the variance ``var`` seldom exceeds, at any scale."""
    return F.col("var") * (kernels.chi2_quantile(level, DOF[mother]) / DOF[mother])


def tested(
    signal: DataFrame, dt: float = 1.0, dj: float = 0.05, s0: float | None = None, mother: str = "DOG", m: float | None = None, level: float = 0.95, noise: str = "DOG"
) -> DataFrame:
    """``cwt`` with n_points and ``signif``, the test for white noise by the wavelet ``noise``, in every row, ready for ``masked``."""
    known = measured(signal).withColumn("signif", _exceeded(level, noise))
    return cwt(known, dt, dj, s0, mother, m, carried=("signif", "n_points"))


def scales(signal: DataFrame, dt: float = 1.0, dj: float = 0.05, s0: float | None = None) -> DataFrame:
    """river_id, n_points, var, j and scale: what ``cwt`` of these signals has."""
    first = s0 or 2 * dt
    last = F.floor(F.log2(F.col("n_points") * dt / first) / dj)
    rows = variances(signal).where(F.col("n_points") >= 4).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("j"))
    return rows.withColumn("scale", F.lit(first) * F.pow(F.lit(2.0), F.col("j") * dj))


def _background(mother: str, m: float | None, dt: float, lag1: float, table: DataFrame, background: DataFrame | None) -> DataFrame:
    """``table`` (of ``scales``) with ``noise``: red noise of the signal's variance, or the spectrum (river_id, j, gws) given."""
    if background is None:
        return table.withColumn("noise", F.col("var") * noise_spectrum(F.col("scale"), dt, lag1, mother, m))
    return table.join(background.select("river_id", "j", F.col("gws").alias("noise")), ["river_id", "j"])


def significance(
    signal: DataFrame, level: float = 0.95, lag1: float = 0.0, mother: str = "DOG", m: float | None = None, dt: float = 1.0, dj: float = 0.05,
    s0: float | None = None, averaged: int | None = None, background: DataFrame | None = None,
) -> DataFrame:
    """The power that noise seldom exceeds: river_id, signif where it is the same at every scale, else river_id, j, signif.

    The noise is white (``lag1`` 0) or red, of the signal's variance, or has the spectrum
    ``background`` (river_id, j, gws). With ``averaged`` the test is for spectra averaged
    over so many places (0: all of the signal's), whose degrees of freedom grow as the scale falls.
    """
    least = DOF[mother]
    if averaged is None and background is None and not lag1:
        return variances(signal).select("river_id", _exceeded(level, mother).alias("signif"))
    rows = _background(mother, m, dt, lag1, scales(signal, dt, dj, s0), background)
    if averaged is None:
        return rows.select("river_id", "j", (F.col("noise") * (kernels.chi2_quantile(level, least) / least)).alias("signif"))
    if m is not None and m != MOTHERS[mother]:
        raise ValueError("averages are known for the mother wavelets' own parameters alone")
    places = F.col("n_points") if averaged == 0 else F.lit(max(1, averaged))
    ratio = places * dt / DECORRELATION[mother][0] / F.col("scale")
    # the degrees of freedom depend on scale and length alone, so each pair of them is solved once
    rows = rows.withColumn("dof", F.greatest(F.lit(least), least * F.sqrt(1 + ratio * ratio)))
    solved = rows.select("dof").distinct().withColumn("share", chi2_quantile(level, F.col("dof")) / F.col("dof"))
    return rows.join(solved, "dof").select("river_id", "j", (F.col("noise") * F.col("share")).alias("signif"))


def band_significance(
    signal: DataFrame, low: float, high: float, level: float = 0.95, lag1: float = 0.0, mother: str = "DOG", dt: float = 1.0, dj: float = 0.05,
    s0: float | None = None, background: DataFrame | None = None,
) -> DataFrame:
    """C4: river_id and the power, averaged over scales from ``low`` up to below ``high``, that noise seldom exceeds.

    A river whose scales all lie outside the band gives no row.
    """
    rows = _background(mother, None, dt, lag1, scales(signal, dt, dj, s0), background).where((F.col("scale") >= low) & (F.col("scale") < high))
    one = rows.groupBy("river_id").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("scale")).alias("inverse"), F.sum(F.col("noise") / F.col("scale")).alias("noise"))
    middle = math.sqrt(low * high)
    spread = F.col("n") * (dj / DECORRELATION[mother][1])
    one = one.withColumn("dof", DOF[mother] * F.col("n") / F.col("inverse") / middle * F.sqrt(1 + spread * spread))
    solved = one.select("dof").distinct().withColumn("share", chi2_quantile(level, F.col("dof")) / F.col("dof"))
    # the mean noise is its sum over the inverse sum, by which the average divides again
    return one.join(solved, "dof").select("river_id", (F.col("noise") * F.col("share") * (dj * dt / C_DELTA[mother])).alias("signif"))


def noise_spectrum(scale: Column, dt: float, lag1: float, mother: str = "DOG", m: float | None = None) -> Column:
    """C4: power of red noise at a scale, relative to its variance."""
    factor = fourier_factor(mother, MOTHERS[mother] if m is None else m)[0]
    freq = F.lit(dt) / (scale * factor)
    return (1 - lag1 * lag1) / (1 - 2 * lag1 * F.cos(2 * math.pi * freq) + lag1 * lag1)


def _significant(dt: float, mother: str, m: float | None) -> Column:
    """Power where it is above ``signif`` and inside the cone of influence, else 0."""
    factor = fourier_factor(mother, MOTHERS[mother] if m is None else m)[0]
    inside = F.col("scale") * factor <= coi(F.col("n"), F.col("n_points"), dt, mother, m)
    return F.when(inside & (F.col("power") > F.col("signif")), F.col("power")).otherwise(0.0)


def masked(
    wave: DataFrame, signif: DataFrame | None = None, length: DataFrame | None = None, dt: float = 1.0, mother: str = "DOG", m: float | None = None
) -> DataFrame:
    """power where it is significant and inside the cone of influence, else 0.

    ``length`` has river_id and n_points; ``signif`` is by river, or by river and scale.
    Those not given are columns of the wave (``tested``). Given ones are sorted with it:
    Spark takes the transform for as small as its signals and would broadcast it.
    """
    j = wave
    if signif is not None:
        j = j.hint("merge").join(signif, [c for c in ("river_id", "j") if c in signif.columns])
    if length is not None:
        j = j.hint("merge").join(length, "river_id")
    return j.withColumn("power", _significant(dt, mother, m)).drop("signif", "n_points")


def unwrapped(points: DataFrame, angle: str) -> DataFrame:
    """``points`` with jumps of ``angle`` by more than half a turn taken out: a running sum of the steps, each within half a turn."""
    order = Window.partitionBy("river_id").orderBy("idx")
    step = F.col(angle) - F.lag(angle).over(order)
    turn = 2 * math.pi
    # a step of exactly half a turn keeps its sign
    short = step - turn * F.floor((step + math.pi) / turn)
    short = F.when((short == -math.pi) & (step > 0), math.pi).otherwise(short)
    rows = points.withColumns({"_step": F.coalesce(short, F.lit(0.0)), "_first": F.first(angle).over(order)})
    return rows.withColumn(angle, F.col("_first") + F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step", "_first")


def analysed(signal: DataFrame, dt: float = 1.0, dj: float = 0.05, s0: float | None = None, mother: str = "DOG", m: float | None = None) -> dict[str, DataFrame]:
    """C11: the transform and what follows from it, as tables.

    ``wave`` (C1), ``gws`` and ``gws_sig`` (mean power by scale; the second of the power that is
    significant and outside the cone of influence; ``spectra`` has both from one pass), ``sawp`` and ``sawp_sig`` likewise by place,
    ``peaks`` of gws, and ``signif``. The test is the one for white noise and the
    real wavelet, whatever the mother is.
    """
    own = tested(signal, dt, dj, s0, mother, m)
    wave, kept = own.drop("signif", "n_points"), masked(own, dt=dt, mother=mother, m=m)
    gws = global_spectrum(wave)
    both = own.withColumn("_sig", _significant(dt, mother, m)).groupBy("river_id", "j").agg(F.first("scale").alias("scale"), F.avg("power").alias("gws"), F.avg("_sig").alias("gws_sig"))
    return {
        "wave": wave, "power_sig": kept, "gws": gws, "gws_sig": global_spectrum(kept), "spectra": both, "peaks": spectrum_peaks(gws),
        "sawp": scale_averaged(wave, dt, dj, mother), "sawp_sig": scale_averaged(kept, dt, dj, mother), "signif": significance(signal),
    }


def inverse(wave: DataFrame, dt: float, dj: float, mother: str = "DOG", scales: list[int] | None = None) -> DataFrame:
    """The signal (its mean removed) from the transform; some scales only give a band."""
    w = wave if scales is None else wave.where(F.col("j").isin(scales))
    factor = dj * math.sqrt(dt) / (C_DELTA[mother] * PSI_0[mother])
    return w.groupBy("river_id", "n").agg((F.sum(F.col("re") / F.sqrt("scale")) * factor).alias("y"))


def saddle_ids(wave: DataFrame) -> DataFrame:
    """Half the changes of "neighbour above centre" around a ring of six; 0 is an extremum.

    Borders take the id of the nearest inner cell: of the neighbour in the row, then of that in
    the column. A river's cells meet in one place, so the long table shuffles once.
    """
    row = Window.partitionBy("river_id", "j").orderBy("n")
    column = Window.partitionBy("river_id", "n").orderBy("j")
    w = wave.select("river_id", "j", "n", "re").repartition("river_id")
    w = w.withColumns({"tc": F.lag("re").over(column), "bc": F.lead("re").over(column)})
    w = w.select(
        "river_id", "j", "n", "re", "tc", "bc", F.lag("tc").over(row).alias("tl"), F.lead("bc").over(row).alias("br"),
        F.lag("re").over(row).alias("ml"), F.lead("re").over(row).alias("mr"),
    )
    ring = ["tl", "ml", "bc", "br", "mr", "tc"]
    above = [F.col(c) > F.col("re") for c in ring]
    changes = sum(((a != b).cast("long") for a, b in zip(above, above[1:] + above[:1], strict=True)), F.lit(0))
    w = w.select("river_id", "j", "n", (changes / 2).cast("long").alias("id"))  # null at borders
    for by in (row, column):
        w = w.withColumn("id", F.coalesce("id", F.lead("id").over(by), F.lag("id").over(by)))
    return w.where("id is not null")


def leaf_spectrum(wave: DataFrame, spans: DataFrame) -> DataFrame:
    """Mean power by scale over each node's span (river_id, node_id, low, high).

    Spans list their places, and a river's nodes by place meet its wave in one row: work follows the
    spans, and the long table shuffles once, for the means are made where it then lies.
    """
    places = spans.select("river_id", "node_id", F.explode(F.sequence("low", "high")).alias("n"))
    places = places.groupBy("river_id", "n").agg(F.collect_list("node_id").alias("nodes"))
    at = places.groupBy("river_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "nodes"))).alias("at"))
    w = wave.select("river_id", "j", "n", "power").repartition("river_id")
    j = w.join(at.hint("shuffle_hash"), "river_id").select("river_id", "j", "power", F.explode(F.try_element_at("at", F.col("n"))).alias("node_id"))
    return j.groupBy("river_id", "node_id", "j").agg(F.avg("power").alias("gws"))


def bend_shape(wave: DataFrame, bends: DataFrame, ds: float) -> DataFrame:
    """Skewness and flatness of each bend (river_id, bend_id, low, high, j_shape, peak).

    Correlates the wave at the shape scale with cos 3 phi and sin 3 phi, phi running from
    0 to pi over the bend, relative to the bend's own peak.
    """
    places = bends.withColumn("n", F.explode(F.sequence("low", "high"))).withColumnRenamed("j_shape", "j")
    j = wave.join(places, ["river_id", "j", "n"])
    phi = F.try_divide((F.col("n") - F.col("low")) * math.pi, F.col("high") - F.col("low"))
    j = j.withColumn("c3", F.cos(3 * phi)).withColumn("s3", F.sin(3 * phi))
    norm = F.sqrt(F.lit(ds) / F.first("scale")) * F.try_divide(F.max("re"), F.first("peak"))
    return j.groupBy("river_id", "bend_id").agg(
        (norm * F.try_divide(F.sum(F.col("re") * F.col("c3")), F.sum(F.col("c3") * F.col("c3")))).alias("skewness"),
        (norm * F.try_divide(F.sum(F.col("re") * F.col("s3")), F.sum(F.col("s3") * F.col("s3")))).alias("flatness"),
    )


def spectrum_cuts(signal: DataFrame, dt: float = 1.0, dj: float = 0.05) -> DataFrame:
    """Places where the Morlet power summed over scales has a prominent minimum."""
    kind = signal.schema["river_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, cuts = [], []
            for river, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not y or len(y) < 4:
                    continue
                total = (np.abs(kernels.cwt(np.array(y, float), dt, dj, None, "MORLET", 2.0)[0]) ** 2).sum(axis=0)
                found = kernels.prominent(-total, float(np.std(total)))
                ids += [river] * len(found)
                cuts += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(cuts, pa.int64())], names=["river_id", "cut"])

    return signal.select("river_id", "signal").mapInArrow(each, f"river_id {kind}, cut long")
