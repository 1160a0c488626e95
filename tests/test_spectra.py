"""Quantile columns, significance by scale and band, and transforms of angles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.api import Rivers
from thalweg.functions import distributions, kernels
from thalweg.operators import spectral


def test_quantile_columns_equal_bisection(spark):
    rows = [(x,) for x in (0.5, 1.0, 1.3, 2.0, 7.7, 31.0, 100.0, 999.5)]
    frame = spark.createDataFrame(rows, "dof double")
    for level in (0.05, 0.5, 0.95, 0.999):
        for r in frame.select("dof", distributions.chi2_quantile(level, F.col("dof")).alias("q"), distributions.log_gamma(F.col("dof")).alias("g")).collect():
            assert math.isclose(r.q, kernels.chi2_quantile(level, r.dof), rel_tol=1e-8)
            assert math.isclose(r.g, math.lgamma(r.dof), rel_tol=1e-11, abs_tol=1e-11)


def test_noise_seldom_exceeds_its_level(spark):
    """Red noise itself: its local, averaged and band power pass the levels about as often as they say."""
    rng = np.random.default_rng(6)
    rows = []
    for river in range(60):
        e, x = rng.normal(size=512), 0.0
        y = [x := 0.6 * x + v for v in e.tolist()]
        rows.append((river, y))
    s = spark.createDataFrame(rows, "river_id long, signal array<double>")
    wave = spectral.cwt(s, dj=0.5).cache()
    local = wave.join(spectral.significance(s, lag1=0.6, dj=0.5), ["river_id", "j"]).where("scale < 40 and n between 60 and 450")
    assert abs(local.agg(F.avg((F.col("power") > F.col("signif")).cast("double"))).first()[0] - 0.05) < 0.02
    averaged = spectral.global_spectrum(wave).join(spectral.significance(s, lag1=0.6, dj=0.5, averaged=0), ["river_id", "j"]).where("scale < 40")
    assert averaged.agg(F.avg((F.col("gws") > F.col("signif")).cast("double"))).first()[0] < 0.12
    band = spectral.scale_averaged(wave.where("scale >= 4 and scale < 16"), 1.0, 0.5).join(spectral.band_significance(s, 4, 16, lag1=0.6, dj=0.5), "river_id").where("n between 60 and 450")
    assert abs(band.agg(F.avg((F.col("sawp") > F.col("signif")).cast("double"))).first()[0] - 0.05) < 0.04
    flat = spectral.significance(s, background=spectral.global_spectrum(wave), dj=0.5)
    assert flat.count() == wave.select("river_id", "j").distinct().count()
    assert spectral.band_significance(s, 1e6, 1e7).count() == 0 and spectral.significance(s.limit(0), lag1=0.5).count() == 0
    with pytest.raises(ValueError):
        spectral.significance(s, mother="MORLET", m=2.0, averaged=0)


def test_directions_unwrap_and_transform(spark):
    t = np.linspace(0, 30, 200)
    turned = 4 * np.sin(t / 3) + t
    rows = [(1, i, float((v + math.pi) % (2 * math.pi) - math.pi)) for i, v in enumerate(turned)] + [(2, 0, 1.0), (2, 1, 1.0 + math.pi)]
    got = spectral.unwrapped(spark.createDataFrame(rows, "river_id long, idx long, a double"), "a").orderBy("river_id", "idx").collect()
    back = np.array([r.a for r in got if r.river_id == 1])
    assert np.allclose(back - back[0], turned - turned[0]) and got[-1].a == pytest.approx(1 + math.pi)
    points = spark.createDataFrame([(1, i, float(i), math.sin(i / 4)) for i in range(120)], "river_id long, idx long, x double, y double")
    river = Rivers.added(points)
    tables = river.spectra(1.0, 0.25, of="angle")
    assert tables["wave"].where("abs(im) > 1e-3").count() > 0 and tables["peaks"].count() >= 1
    top = tables["gws"].orderBy(F.desc("gws")).first()
    assert 1 < top.scale * 2 < 60 and tables["gws_sig"].count() == tables["gws"].count() and tables["sawp_sig"].count() == tables["sawp"].count()
    assert river.spectrum(1.0, 0.25).where("abs(im) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        river.spectra(1.0, of="width")
