"""Quantiles of the chi-square distribution as Spark columns, for degrees of freedom that differ by row.

Implements: C5.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of Newton's method; each roughly doubles the digits that are right.
STEPS = 14


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function of a positive column: Stirling's series eight units further up, and back down."""
    z = a + 8
    down = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda done, k: done + F.log(a + k))
    inverse = 1 / (z * z)
    series = (1 / (12 * z)) * (1 - inverse * (1 / 30.0 - inverse * (1 / 105.0 - inverse * (1 / 140.0 - inverse / 99.0))))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - down


def chi2_quantile(level: float, dof: Column) -> Column:
    """Value below which a chi-square variable of ``dof`` degrees of freedom lies with probability ``level``.

    Newton's method on the series of the incomplete gamma function, from the cube-root approximation.
    The series has as many terms as its sum needs at these degrees of freedom.
    """
    a = dof.cast("double") / 2
    z = NormalDist().inv_cdf(level)
    start = a * F.pow(F.greatest(1 - 1 / (9 * a) + z * F.sqrt(1 / (9 * a)), F.lit(0.05)), F.lit(3.0))
    terms = F.sequence(F.lit(1), F.least(F.ceil(20 * F.sqrt(a) + 80), F.lit(2_000_000)).cast("int"))
    own = F.struct(a.alias("a"), log_gamma(a).alias("g"), terms.alias("terms"), start.alias("start"))

    def solved(s: Column) -> Column:
        def better(h: Column, _: Column) -> Column:
            first = F.struct((F.lit(1.0) / s["a"]).alias("term"), (F.lit(1.0) / s["a"]).alias("total"))

            def add(done: Column, n: Column) -> Column:
                term = done["term"] * h / (s["a"] + n)
                return F.struct(term.alias("term"), (done["total"] + term).alias("total"))

            total = F.aggregate(s["terms"], first, add)["total"]
            # probability over density: the series times h, less the level over the density
            density = F.exp((s["a"] - 1) * F.log(h) - h - s["g"])
            step = total * h - F.lit(level) / density
            return F.greatest(h / 4, F.least(h * 4, h - step))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), s["start"], better) * 2

    return F.element_at(F.transform(F.array(own), solved), 1)
