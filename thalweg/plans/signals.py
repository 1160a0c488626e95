"""Queries of wavelet spectra, splines, smoothing and scale-space trees."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from thalweg.functions.kernels import chi2_quantile
from thalweg.functions.scalar import fourier_factor
from thalweg.operators import lines, ordered, scale_tree, spectral
from thalweg.plans import standins as st
from thalweg.plans.geometry import r, rounded, transects

QUERIES: dict[str, tuple] = {}
DJ = 0.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def wave(spark, sf_dir):
    return spectral.cwt(st.signals(spark, sf_dir), 1.0, DJ)


#: The transform as sums over 128 frequencies: the second derivative of a Gaussian, scales 2 to 64 in half octaves.
_WAVE = f"""sg AS (SELECT vec_id AS river_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
sm AS (SELECT river_id, n, v - avg(v) OVER (PARTITION BY river_id) AS v FROM sg),
ft AS (SELECT river_id, k, sum(v * cos(2 * pi() * k * n / 128)) AS a, -sum(v * sin(2 * pi() * k * n / 128)) AS b FROM sm, range(1, 65) t(k) GROUP BY 1, 2),
sc AS (SELECT j, 2 * pow(2, {DJ} * j) AS scale FROM range(0, 11) t(j)),
ds AS (SELECT j, scale, k, sqrt(2 * pi() * scale) / sqrt({math.gamma(2.5)!r}) * pow(scale * 2 * pi() * k / 128, 2) * exp(-pow(scale * 2 * pi() * k / 128, 2) / 2) * (CASE WHEN k = 64 THEN 1 ELSE 2 END) / 128 AS d FROM sc, range(1, 65) t(k)),
tw AS (SELECT k, n, cos(2 * pi() * k * n / 128) AS co, sin(2 * pi() * k * n / 128) AS si FROM range(1, 65) t(k), range(0, 64) u(n)),
wv AS (SELECT river_id, j, n, any_value(scale) AS scale, sum(d * (a * co - b * si)) AS re FROM ft JOIN ds USING (k) JOIN tw USING (k) GROUP BY 1, 2, 3),
wp AS (SELECT *, re * re AS power FROM wv)"""


@query(f"WITH {_WAVE} SELECT river_id, j, n, {r('scale', 're', 'power')} FROM wp")
def cwt_power(spark, sf_dir):
    return rounded(wave(spark, sf_dir).select("river_id", "j", "n", "scale", "re", "power"), "scale", "re", "power")


@query(f"WITH {_WAVE}, g AS (SELECT river_id, j, avg(power) AS gws FROM wp GROUP BY 1, 2) SELECT river_id, j, {r('gws')} FROM g")
def gws(spark, sf_dir):
    return rounded(spectral.global_spectrum(wave(spark, sf_dir)).select("river_id", "j", "gws"), "gws")


@query(f"WITH {_WAVE}, g AS (SELECT river_id, j, avg(power) AS gws FROM wp GROUP BY 1, 2), h AS (SELECT *, lag(gws) OVER w AS a, lead(gws) OVER w AS b FROM g WINDOW w AS (PARTITION BY river_id ORDER BY j)) SELECT river_id, j, {r('gws')} FROM h WHERE gws > a AND gws > b")
def gws_peaks(spark, sf_dir):
    return rounded(spectral.spectrum_peaks(spectral.global_spectrum(wave(spark, sf_dir))).select("river_id", "j", "gws"), "gws")


@query(f"WITH {_WAVE}, g AS (SELECT river_id, n, sum(power / scale) * {DJ / 3.541} AS sawp FROM wp GROUP BY 1, 2) SELECT river_id, n, {r('sawp')} FROM g")
def sawp(spark, sf_dir):
    return rounded(spectral.scale_averaged(wave(spark, sf_dir), 1.0, DJ), "sawp")


_FF = 2 * math.pi * math.sqrt(2 / 5)


@query(f"SELECT vec_id AS river_id, n, round(greatest(0, least(n - 1, 62 - n)) * {_FF / math.sqrt(2)!r}, 6) AS coi FROM embeddings, range(0, 64) t(n)")
def coi(spark, sf_dir):
    s = st.signals(spark, sf_dir).select("river_id", F.size("signal").alias("m"), F.posexplode("signal").alias("n", "v"))
    return rounded(s.select("river_id", F.col("n").cast("long").alias("n"), spectral.coi(F.col("n"), F.col("m")).alias("coi")), "coi")


@query(f"WITH {_WAVE}, vr AS (SELECT river_id, var_pop(v) * {chi2_quantile(0.95, 1)!r} AS lim FROM sm GROUP BY 1) SELECT river_id, j, n, round(CASE WHEN power > lim AND scale * {_FF!r} <= greatest(0, least(n - 1, 62 - n)) * {_FF / math.sqrt(2)!r} THEN power ELSE 0.0 END, 6) AS power FROM wp JOIN vr USING (river_id)")
def significance_mask(spark, sf_dir):
    m = spectral.masked(spectral.tested(st.signals(spark, sf_dir), 1.0, DJ))
    return rounded(m.select("river_id", "j", "n", "power"), "power")


@query(f"WITH {_WAVE}, g AS (SELECT river_id, n, sum(re / sqrt(scale)) * {DJ / (3.541 * 0.867)!r} AS y FROM wp GROUP BY 1, 2) SELECT river_id, n, {r('y')} FROM g")
def inverse_cwt(spark, sf_dir):
    return rounded(spectral.inverse(wave(spark, sf_dir), 1.0, DJ), "y")


@query(f"""WITH {_WAVE}, a AS (SELECT river_id, j, n, re, lag(re) OVER w AS tc, lead(re) OVER w AS bc FROM wp WINDOW w AS (PARTITION BY river_id, n ORDER BY j)),
b AS (SELECT *, lag(tc) OVER w AS tl, lead(bc) OVER w AS br, lag(re) OVER w AS ml, lead(re) OVER w AS mr FROM a WINDOW w AS (PARTITION BY river_id, j ORDER BY n)),
c AS (SELECT river_id, j, n, (((tl > re) <> (ml > re))::INT + ((ml > re) <> (bc > re))::INT + ((bc > re) <> (br > re))::INT + ((br > re) <> (mr > re))::INT + ((mr > re) <> (tc > re))::INT + ((tc > re) <> (tl > re))::INT) // 2 AS id FROM b)
SELECT w.river_id, w.j, w.n, c.id::BIGINT AS id FROM wp w JOIN c ON c.river_id = w.river_id AND c.j = greatest(1, least(w.j, 9)) AND c.n = greatest(1, least(w.n, 62))""")
def saddle_extrema(spark, sf_dir):
    return spectral.saddle_ids(wave(spark, sf_dir))


@query()
def spectrum_cuts(spark, sf_dir):
    return spectral.spectrum_cuts(spectral.signals(st.lineitems(spark, sf_dir), "y"), 1.0, 0.25)


_CARRIED = f"""{st.SQL_EVENTS}, {st.sql_distance()}, q AS (SELECT river_id, idx, s, 1 + (idx * 7 % 5)::DOUBLE AS w_m, idx % 4 AS so FROM p),
g AS (SELECT river_id, min(s) AS s0, max(s) AS s1, pow(10, avg(log10(nullif(d, 0)))) AS ds FROM p GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT river_id, unnest(range(0, ceil((s1 - s0 + ds / 2) / ds)::BIGINT)) AS k, s0, ds FROM g), a AS (SELECT river_id, k, s0 + k * ds AS sk FROM k),
n AS (SELECT *, lead(s) OVER w AS s2, lead(w_m) OVER w AS w2, lag(s) OVER w AS s9, lag(w_m) OVER w AS w9 FROM q WINDOW w AS (PARTITION BY river_id ORDER BY s)),
j AS (SELECT a.*, n.* EXCLUDE (river_id) FROM a ASOF JOIN n ON a.river_id = n.river_id AND a.sk >= n.s)"""


@query(f"WITH {_CARRIED} SELECT river_id, k AS idx, round(sk, 4) AS s, round(CASE WHEN s2 IS NULL THEN w9 + (w_m - w9) / (s - s9) * (sk - s9) ELSE w_m + (w2 - w_m) / (s2 - s) * (sk - s) END, 4) AS w_m, so FROM j")
def resampled_table(spark, sf_dir):
    p = transects(spark, sf_dir).withColumns({"w_m": 1 + (F.col("idx") * 7 % 5).cast("double"), "so": F.col("idx") % 4})
    return rounded(lines.resampled_table(p, "geometric_mean").select("river_id", "idx", "s", "w_m", "so"), "s", "w_m", digits=4)


@query()
def smooth_savgol(spark, sf_dir):
    return rounded(lines.smoothed(transects(spark, sf_dir), 2, 5, 9), "x_smooth", "y_smooth")


@query()
def funneling(spark, sf_dir):
    return lines.funneling(st.bend_points(spark, sf_dir))


@query()
def marked_inflections(spark, sf_dir):
    return lines.marked_inflections(st.bend_points(spark, sf_dir))


@query()
def scale_tree_nodes(spark, sf_dir):
    return scale_tree.nodes(st.signals(spark, sf_dir), 1.0, 0.25)


@query()
def detected_bends(spark, sf_dir):
    return scale_tree.detected(scale_tree.nodes(st.signals(spark, sf_dir), 1.0, 0.25))


#: dt and dj of the long transects' trees.
RIVER_TREE = (1.0, 0.25)


def _long_rivers(spark, sf_dir):
    p = ordered.curvature(ordered.distances(st.lineitems(spark, sf_dir)))
    return p.withColumn("c", F.coalesce("c", F.lit(0.0)))


def _river_tree(spark, sf_dir):
    """Nodes of the curvature of the long transects."""
    p = _long_rivers(spark, sf_dir)
    return scale_tree.nodes(spectral.signals(p, "c"), *RIVER_TREE), p


@query()
def placed_nodes(spark, sf_dir):
    tree, p = _river_tree(spark, sf_dir)
    return scale_tree.placed(tree, p)


@query()
def meander_database(spark, sf_dir):
    tree, p = _river_tree(spark, sf_dir)
    bends = scale_tree.detected(tree).select("river_id", F.col("node").alias("bend_id"), F.col("bound_low").alias("idx_start"), F.col("bound_high").alias("idx_end"))
    return scale_tree.bend_database(bends, p)


_SPANS = "sp AS (SELECT vec_id AS river_id, k AS node_id, (k * 7)::BIGINT AS low, (k * 7 + 20)::BIGINT AS high FROM embeddings, range(0, 4) t(k))"


def _spans(spark, sf_dir):
    s = st.signals(spark, sf_dir).select("river_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("node_id"))
    return s.withColumns({"low": F.col("node_id") * 7, "high": F.col("node_id") * 7 + 20})


@query(f"WITH {_WAVE}, {_SPANS}, g AS (SELECT wp.river_id, node_id, j, avg(power) AS gws FROM wp JOIN sp ON sp.river_id = wp.river_id AND n BETWEEN low AND high GROUP BY 1, 2, 3) SELECT river_id, node_id, j, {r('gws')} FROM g")
def leaf_spectrum(spark, sf_dir):
    return rounded(spectral.leaf_spectrum(wave(spark, sf_dir), _spans(spark, sf_dir)), "gws")


@query(f"""WITH {_WAVE}, {_SPANS}, q AS (SELECT wp.river_id, node_id AS bend_id, re, scale, cos(3 * pi() * (n - low) / (high - low)) AS c3, sin(3 * pi() * (n - low) / (high - low)) AS s3 FROM wp JOIN sp ON sp.river_id = wp.river_id AND n BETWEEN low AND high WHERE j = 4),
g AS (SELECT river_id, bend_id, sqrt(1.0 / any_value(scale)) * max(re) / 0.5 * sum(re * c3) / sum(c3 * c3) AS skewness, sqrt(1.0 / any_value(scale)) * max(re) / 0.5 * sum(re * s3) / sum(s3 * s3) AS flatness FROM q GROUP BY 1, 2)
SELECT river_id, bend_id, {r('skewness', 'flatness')} FROM g""")
def bend_shape(spark, sf_dir):
    b = _spans(spark, sf_dir).withColumnRenamed("node_id", "bend_id").withColumns({"j_shape": F.lit(4).cast("long"), "peak": F.lit(0.5)})
    return rounded(spectral.bend_shape(wave(spark, sf_dir), b, 1.0), "skewness", "flatness")


@query(f"WITH s AS (SELECT vec_id AS river_id, j, 2 * pow(2, {DJ} * j) AS scale FROM embeddings, range(0, 11) t(j)) SELECT river_id, j, round((1 - 0.49) / (1 - 1.4 * cos(2 * pi() / (scale * {_FF!r})) + 0.49), 6) AS noise FROM s")
def noise_spectrum(spark, sf_dir):
    g = spectral.global_spectrum(wave(spark, sf_dir))
    return rounded(g.select("river_id", "j", spectral.noise_spectrum(F.col("scale"), 1.0, 0.7).alias("noise")), "noise")


def _sql_quantile(level: float, dof: str) -> str:
    """Chi-square quantile by bisection on the series of the incomplete gamma function."""
    a, h = f"({dof} / 2)", "((s.lo + s.hi) / 4)"
    series = f"list_sum(list_transform(range(0, 400), lambda i: exp(i * ln({h}) + lgamma({a} + 1) - lgamma({a} + i + 1))))"
    below = f"exp({a} * ln({h}) - {h} - lgamma({a} + 1)) * {series} < {level}"
    half = "(s.lo + s.hi) / 2"
    start = "list_transform(range(81), lambda i: {'lo': 0.0::DOUBLE, 'hi': 200.0::DOUBLE})"
    return f"list_reduce({start}, lambda s, x: CASE WHEN {below} THEN {{'lo': {half}, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': {half}}} END).hi"


#: Scales of the signals of 64 values, their variance, and red noise at each scale.
_NOISE = f"""sg AS (SELECT vec_id AS river_id, unnest(embedding)::DOUBLE AS v FROM embeddings), vr AS (SELECT river_id, var_pop(v) AS var FROM sg GROUP BY 1),
sc AS (SELECT j, 2 * pow(2, {DJ} * j) AS scale FROM range(0, 11) t(j)),
ns AS (SELECT river_id, j, scale, var * (1 - 0.49) / (1 - 1.4 * cos(2 * pi() / (scale * {_FF!r})) + 0.49) AS noise FROM vr, sc)"""


@query(f"WITH {_NOISE} SELECT river_id, j, round(noise * {chi2_quantile(0.95, 1)!r}, 6) + 0.0 AS signif FROM ns")
def significance_red_noise(spark, sf_dir):
    return rounded(spectral.significance(st.signals(spark, sf_dir), lag1=0.7, dj=DJ), "signif")


@query(f"""WITH {_NOISE}, df AS (SELECT j, greatest(1.0, sqrt(1 + pow(64 / 1.43 / scale, 2))) AS dof FROM sc), qt AS (SELECT j, {_sql_quantile(0.95, 'dof')} / dof AS share FROM df)
SELECT river_id, j, round(noise * share, 6) + 0.0 AS signif FROM ns JOIN qt USING (j)""")
def significance_time_averaged(spark, sf_dir):
    return rounded(spectral.significance(st.signals(spark, sf_dir), lag1=0.7, dj=DJ, averaged=0), "signif")


@query(f"""WITH {_NOISE}, b AS (SELECT river_id, count(*) AS n, sum(1 / scale) AS inv, sum(noise / scale) AS noise FROM ns WHERE scale >= 2 AND scale < 8 GROUP BY 1),
df AS (SELECT DISTINCT n / inv / 4 * sqrt(1 + pow(n * {DJ} / 1.4, 2)) AS dof, n FROM b), qt AS (SELECT n, {_sql_quantile(0.95, 'dof')} / dof AS share FROM (SELECT n, min(dof) AS dof FROM df GROUP BY 1))
SELECT river_id, round(noise * share * {DJ} / 3.541, 6) + 0.0 AS signif FROM b JOIN qt USING (n)""")
def significance_band(spark, sf_dir):
    return rounded(spectral.band_significance(st.signals(spark, sf_dir), 2, 8, lag1=0.7, dj=DJ), "signif")


_M2 = fourier_factor("MORLET", 2.0)


# Steps between the values, each within half a turn, summed up; then the transform by positive frequencies alone.
_ANGLE = f"""sg AS (SELECT vec_id AS river_id, unnest(embedding)::DOUBLE * 3 AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
st AS (SELECT *, v - lag(v) OVER w AS d, first_value(v) OVER w AS v0 FROM sg WINDOW w AS (PARTITION BY river_id ORDER BY n)),
un AS (SELECT river_id, n, v0 + sum(coalesce(d - 2 * pi() * floor((d + pi()) / (2 * pi())), 0)) OVER (PARTITION BY river_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS v FROM st),
vr AS (SELECT river_id, var_pop(v) * {chi2_quantile(0.95, 1)!r} AS lim FROM un GROUP BY 1),
sm AS (SELECT river_id, n, v - avg(v) OVER (PARTITION BY river_id) AS v FROM un),
ft AS (SELECT river_id, k, sum(v * cos(2 * pi() * k * n / 128)) AS a, -sum(v * sin(2 * pi() * k * n / 128)) AS b FROM sm, range(1, 65) t(k) GROUP BY 1, 2),
sc AS (SELECT j, 2 * pow(2, {DJ} * j) AS scale FROM range(0, 11) t(j)),
ds AS (SELECT j, scale, k, sqrt(2 * pi() * scale) * pow(pi(), -0.25) * exp(-pow(scale * 2 * pi() * k / 128 - 2, 2) / 2) / 128 AS d FROM sc, range(1, 65) t(k)),
tw AS (SELECT k, n, cos(2 * pi() * k * n / 128) AS co, sin(2 * pi() * k * n / 128) AS si FROM range(1, 65) t(k), range(0, 64) u(n)),
wv AS (SELECT river_id, j, n, any_value(scale) AS scale, sum(d * (a * co - b * si)) AS re, sum(d * (a * si + b * co)) AS im FROM ft JOIN ds USING (k) JOIN tw USING (k) GROUP BY 1, 2, 3)"""


@query(f"""WITH {_ANGLE} SELECT river_id, j, round(avg(re * re + im * im), 6) + 0.0 AS gws,
round(avg(CASE WHEN re * re + im * im > lim AND scale * {_M2[0]!r} <= greatest(0, least(n - 1, 62 - n)) * {_M2[1]!r} THEN re * re + im * im ELSE 0 END), 6) + 0.0 AS gws_sig FROM wv JOIN vr USING (river_id) GROUP BY 1, 2""")
def cwt_angle(spark, sf_dir):
    """Mean power of directions, whole and significant: the embeddings' values, times three, as angles."""
    s = st.signals(spark, sf_dir)
    p = s.select("river_id", F.posexplode("signal").alias("idx", "a")).withColumn("a", F.col("a") * 3)
    t = spectral.analysed(spectral.signals(spectral.unwrapped(p, "a"), "a"), 1.0, DJ, None, "MORLET", 2.0)
    return rounded(t["spectra"].select("river_id", "j", "gws", "gws_sig"), "gws", "gws_sig")
