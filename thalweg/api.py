"""A river collection as chained calls; every call returns a new one over lazy frames.

Implements: D1-D5, X11, X12, X18-X20, W22-W25, IO13, IO14 (façade).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators import compare, lines, metrics, ordered, scale_tree, spectral, splines
from thalweg.operators.ranking import ranked
from thalweg.sources.files import Store

SOURCES = ("original", "resample", "smooth")


@dataclass(frozen=True)
class Network:
    """IO14: what a data set holds of some rivers, brought together.

    ``order`` ranks them by length, the longest first; ``trees`` and ``spectra`` are theirs
    as stored; ``bends`` are those of their start_comid or else of their uid, with the
    metrics computed anew on the points; a table that the data set lacks is None.
    """

    rivers: Rivers
    order: DataFrame
    bends: DataFrame | None = None
    trees: DataFrame | None = None
    spectra: DataFrame | None = None

    @classmethod
    def loaded(cls, store: Store, rivers: Iterable | None = None, recalculate: bool = True, **options) -> Network:
        ids = None if rivers is None else list(rivers)
        loaded = Rivers.loaded(store, ids, recalculate, **options)
        length = loaded._measured().groupBy("river_id").agg(F.max("s").alias("length"))
        order = ranked(length, [F.col("length").desc(), F.col("river_id").asc()], "place")

        def stored(table: str) -> DataFrame | None:
            try:
                return store.read(table, ids)
            except KeyError:
                return None

        try:
            bends = store.read("bends")  # by comid or uid, so not by river
        except KeyError:
            bends = None
        if bends is not None:
            names = loaded.points.groupBy("river_id").agg(*(F.first(c).alias(c) if c in loaded.points.columns else F.lit(None).cast("string").alias(c) for c in ("start_comid", "uid")))
            spans = compare.matched_rivers(bends.drop("river_id"), names).where("river_id is not null").select("river_id", "bend_id", "idx_start", "idx_end")
            bends = scale_tree.bend_database(spans, loaded.points)
        return cls(loaded, order, bends, stored("trees"), stored("spectra"))

    def save(self, store: Store) -> None:
        """IO13: every table that is there, under its own name."""
        self.rivers.save(store)
        for name in ("bends", "trees", "spectra"):
            if getattr(self, name) is not None:
                store.write(name, getattr(self, name))


@dataclass(frozen=True)
class Rivers:
    """Points (river_id, idx, x, y, and s, c once computed) of any number of rivers."""

    points: DataFrame
    source: str = "original"

    @classmethod
    def added(cls, points: DataFrame, resample: bool = True, scale_by_width: bool = False, smooth: float = 0.0, order: int = 3, ext: int = 0) -> Rivers:
        """Rivers from a table of points, checked, measured, resampled and curved.

        Needs river_id, idx, x, y. The step is the least width where there are widths, else
        the geometric mean of the steps; with ``scale_by_width`` lengths are in widths.
        ``smooth``, ``order`` and ``ext`` are those of ``lines.resampled_table``.
        """
        lacking = {"river_id", "idx", "x", "y"} - set(points.columns)
        if lacking:
            raise ValueError(f"points lack {', '.join(sorted(lacking))}")
        p = ordered.distances(points.where("x is not null and y is not null"))
        out = cls(p)
        if resample:
            out = cls(lines.resampled_table(p, "min_width" if "w_m" in p.columns else "geometric_mean", smooth, order, ext), "resample")
        out = out.curvature()
        return replace(out, points=ordered.width_scaled(out.points)) if scale_by_width else out

    @classmethod
    def loaded(cls, store: Store, rivers: Iterable | None = None, recalculate: bool = True, **options) -> Rivers:
        """IO14: the rivers of a data set (all, or those named): as ``added``, or as they were stored."""
        points = store.read("points", rivers)
        return cls.added(points, **options) if recalculate else cls(points, "resample" if "dxds" in points.columns else "original")

    def inflections(self) -> DataFrame:
        """Where the curvature changes its sign."""
        return ordered.inflections(self._curved().points)

    def with_distances(self) -> Rivers:
        return replace(self, points=ordered.distances(self.points))

    def _measured(self) -> DataFrame:
        return self.with_distances().points if "s" not in self.points.columns else self.points

    def resampled(self, step: float | None = None, smooth: float = 0.0, order: int = 3, ext: int = 0) -> Rivers:
        """Splines at an even step; the source becomes resample."""
        p = lines.resampled(self._measured(), step, smooth, order, ext)
        return Rivers(p.withColumnRenamed("k", "idx"), "resample")

    def splines(self, order: int = 3, smooth: float = 0.0) -> DataFrame:
        """The table of splines of x and y over s, to be stored, or read by ``splines.at_stations``."""
        return splines.fitted(self._measured(), order, smooth)

    def smoothed(self, order: int = 2, window: int = 3, gaussian: int = 5) -> Rivers:
        p = lines.smoothed(self.points, order, window, gaussian)
        return Rivers(p.select("river_id", F.col("k").alias("idx"), "s", F.col("x_smooth").alias("x"), F.col("y_smooth").alias("y")), "smooth")

    def curvature(self) -> Rivers:
        return replace(self, points=ordered.curvature(self.points))

    def river(self, river_id: object) -> Rivers:
        """X20."""
        return replace(self, points=self.points.where(F.col("river_id") == river_id))

    def bends(self, level: float = 0.0) -> DataFrame:
        return metrics.bends(metrics.side_runs(self.points, level))

    def spectrum(self, dt: float, dj: float = 0.05, mother: str | None = None, of: str = "curvature", m: float | None = None) -> DataFrame:
        """C11: the transform of the curvature (by default with the wavelet DOG) or of the direction ``angle`` (MORLET of 2)."""
        return self.spectra(dt, dj, mother, of, m)["wave"]

    def spectra(self, dt: float, dj: float = 0.05, mother: str | None = None, of: str = "curvature", m: float | None = None) -> dict[str, DataFrame]:
        """C11: the tables of ``spectral.analysed`` of the curvature or of the unwrapped direction angle."""
        points = self._curved().points
        if of == "curvature":
            return spectral.analysed(spectral.signals(points, "c"), dt, dj, None, mother or "DOG", m)
        if of != "angle":
            raise ValueError("spectra are of curvature or angle")
        turned = spectral.unwrapped(points, "heading")
        return spectral.analysed(spectral.signals(turned, "heading"), dt, dj, None, mother or "MORLET", 2.0 if m is None and mother in (None, "MORLET") else m)

    def scale_tree(self, dt: float, dj: float = 0.05) -> DataFrame:
        """Nodes of the curvature's scale-space tree."""
        return scale_tree.nodes(spectral.signals(self._curved().points, "c"), dt, dj)

    def refined_tree(self, dt: float, dj: float = 0.05, table: DataFrame | None = None) -> DataFrame:
        """X11: the tree's nodes with their places, extended spans, inflections and leaf spans; ``table`` as from ``splines``."""
        points = self._curved().points.withColumn("c", F.coalesce("c", F.lit(0.0)))
        return scale_tree.refined(scale_tree.nodes(spectral.signals(points, "c"), dt, dj), points, table)

    def meanders(self, dt: float, dj: float = 0.05) -> DataFrame:
        return scale_tree.detected(self.scale_tree(dt, dj))

    def _curved(self) -> Rivers:
        if "c" not in self.points.columns:
            raise ValueError("curvature has to be computed first")
        return self

    def save(self, store: Store) -> None:
        store.write("points", self.points)
