"""Queries of ordered geometry, bend metrics and comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import scalar
from thalweg.operators import compare, metrics, ordered, synth
from thalweg.plans import standins as st

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Six decimals and no negative zero, as the SQL gives them: it rounds the double times a power of ten.

    ``F.round`` with decimals rounds the shortest decimal number of a double, which at halves may lie on the other side.
    """
    scale = float(10**digits)
    return df.withColumns({c: F.round(F.col(c) * scale) / scale + 0.0 for c in columns})


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


E, D, C = st.SQL_EVENTS, st.sql_distance(), st.sql_curvature()
TL, DL = st.SQL_LINES, st.sql_distance("tl")
B = st.sql_bends()
W = "WINDOW w AS (PARTITION BY river_id ORDER BY idx)"


def transects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.distances(st.events(spark, sf_dir))


def curved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.curvature(transects(spark, sf_dir))


@query(f"WITH {E}, {D} SELECT river_id, idx, {r('s')} FROM p")
def reach_distance(spark, sf_dir):
    return rounded(transects(spark, sf_dir).select("river_id", "idx", "s"), "s")


@query(f"""WITH {E}, {D}, a AS (SELECT river_id, max(s) AS length, sqrt(pow(arg_max(x, idx) - arg_min(x, idx), 2) + pow(arg_max(y, idx) - arg_min(y, idx), 2)) AS chord FROM p GROUP BY 1)
SELECT river_id, {r('length', 'chord')}, round(length / nullif(chord, 0), 6) AS sinuosity FROM a""")
def reach_length_chord(spark, sf_dir):
    a = transects(spark, sf_dir).groupBy("river_id").agg(
        F.max("s").alias("length"),
        scalar.step_length(F.max_by("x", "idx") - F.min_by("x", "idx"), F.max_by("y", "idx") - F.min_by("y", "idx")).alias("chord"),
    )
    return rounded(a.withColumn("sinuosity", scalar.sinuosity(F.col("length"), F.col("chord"))), "length", "chord", "sinuosity")


_SUMMARY = f"""WITH {E}, {D}, {C}, a AS (SELECT river_id, max(s) AS length, sqrt(pow(arg_max(x, idx) - arg_min(x, idx), 2) + pow(arg_max(y, idx) - arg_min(y, idx), 2)) AS chord FROM p GROUP BY 1),
k AS (SELECT river_id, c > 0 AS pos, lead(c > 0) OVER w AS nxt FROM cv {W}), n AS (SELECT river_id, count(*) FILTER (WHERE pos <> nxt) AS n_inflections FROM k GROUP BY 1)
SELECT river_id, {r('length', 'chord')}, round(length / nullif(chord, 0), 6) AS sinuosity, n_inflections FROM a JOIN n USING (river_id)"""


@query(_SUMMARY)
def transect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ordered.inflections(curved(spark, sf_dir)).groupBy("river_id").agg(F.count(F.lit(1)).alias("n_inflections"))
    return reach_length_chord(spark, sf_dir).join(n, "river_id", "left").withColumn("n_inflections", F.coalesce("n_inflections", F.lit(0)))


@query(f"""WITH {E}, {D}, t AS (SELECT river_id, s - lag(s) OVER w AS ds FROM p {W}), m AS (SELECT *, avg(ds) OVER (PARTITION BY river_id) AS mn FROM t WHERE ds IS NOT NULL)
SELECT river_id, round(min(ds), 6) AS ds_min, round(avg(ds), 6) AS ds_mean, round(pow(10, avg(log10(ds)) ), 6) AS ds_geometric, bool_and(abs(ds - mn) <= 1e-8 + 1e-2 * abs(mn)) AS even FROM m GROUP BY 1""")
def step_stats(spark, sf_dir):
    return rounded(ordered.step_statistics(transects(spark, sf_dir)), "ds_min", "ds_mean", "ds_geometric")


@query(f"WITH {E}, {D}, g AS (SELECT river_id, idx, {st.sql_gradient('x')} AS dxds, {st.sql_gradient('y')} AS dyds FROM p {W}) SELECT river_id, idx, {r('dxds', 'dyds')} FROM g")
def gradient(spark, sf_dir):
    p = transects(spark, sf_dir)
    g = p.select("river_id", "idx", ordered.gradient(F.col("x"), F.col("s")).alias("dxds"), ordered.gradient(F.col("y"), F.col("s")).alias("dyds"))
    return rounded(g, "dxds", "dyds")


_HEAD = f"""hd AS (SELECT *, first_value(x1) OVER w AS fx, first_value(y1) OVER w AS fy, coalesce(c * (s - lag(s) OVER w), 0.0) AS turn FROM cv {W}),
he AS (SELECT *, CASE WHEN fy > 0 AND fx < 0 THEN {math.pi} + atan(fy / fx) WHEN fy < 0 AND fx < 0 THEN {1.5 * math.pi} - atan(fy / fx) WHEN fx = 0 THEN CASE WHEN fy > 0 THEN {math.pi / 2} WHEN fy < 0 THEN {-math.pi / 2} END ELSE atan(fy / fx) END
 + sum(turn) OVER (PARTITION BY river_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS heading, -1.0 / nullif(c, 0) AS r FROM hd)"""


@query(f"WITH {E}, {D}, {C}, {_HEAD} SELECT river_id, idx, {r('c', 'heading')}, round(CASE WHEN abs(c) > 1e-6 THEN r END, 4) AS r FROM he")
def curvature_radius(spark, sf_dir):
    c = curved(spark, sf_dir).withColumn("r", F.when(F.abs("c") > 1e-6, F.col("r")))
    return rounded(rounded(c.select("river_id", "idx", "c", "heading", "r"), "c", "heading"), "r", digits=4)


@query(f"WITH {TL}, {DL}, {C} SELECT river_id, idx, {r('c')} FROM cv")
def curvature_long(spark, sf_dir):
    c = ordered.curvature(ordered.distances(st.lineitems(spark, sf_dir)))
    return rounded(c.select("river_id", "idx", "c"), "c")


_DIR = f"""d AS (SELECT river_id, idx, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM tr {W}), a AS (SELECT *, atan(dy / dx) AS al FROM d WHERE dx IS NOT NULL)"""


@query(f"""WITH {E}, {_DIR} SELECT river_id, idx, round(CASE WHEN dy > 0 AND dx < 0 THEN {math.pi} + al WHEN dy < 0 AND dx < 0 THEN al - {math.pi} ELSE al END, 6) + 0.0 AS angle,
round(CASE WHEN dx < 0 THEN {1.5 * math.pi} - al ELSE {0.5 * math.pi} - al END, 6) + 0.0 AS azimuth FROM a""")
def direction_angle(spark, sf_dir):
    h = ordered.headings(st.events(spark, sf_dir)).withColumn("azimuth", scalar.direction_azimuth(F.col("dx"), F.col("dy")))
    return rounded(h.select("river_id", "idx", "angle", "azimuth"), "angle", "azimuth")


_REBUILT = f"""q AS (SELECT *, nth_value(x, 1) OVER v AS xa, nth_value(x, 2) OVER v AS xb, nth_value(y, 1) OVER v AS ya, nth_value(y, 2) OVER v AS yb,
 CASE WHEN idx >= 2 THEN c * coalesce(lag(s) OVER w - lag(s, 2) OVER w, 0.0) ELSE 0.0 END AS turn, CASE WHEN idx >= 2 THEN s - lag(s) OVER w ELSE 0.0 END AS ds
 FROM cv WINDOW w AS (PARTITION BY river_id ORDER BY idx), v AS (PARTITION BY river_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q2 AS (SELECT *, atan2(yb - ya, xb - xa) + sum(turn) OVER (PARTITION BY river_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ang FROM q),
q3 AS (SELECT river_id, idx, CASE WHEN idx = 0 THEN x ELSE xb + sum(ds * cos(ang)) OVER o END AS rebuilt_x, CASE WHEN idx = 0 THEN y ELSE yb + sum(ds * sin(ang)) OVER o END AS rebuilt_y
 FROM q2 WINDOW o AS (PARTITION BY river_id ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {E}, {D}, {C}, {_REBUILT} SELECT river_id, idx, {r('rebuilt_x', 'rebuilt_y', digits=3)} FROM q3")
def coords_from_curvature(spark, sf_dir):
    out = ordered.from_curvature(curved(spark, sf_dir)).select("river_id", "idx", "rebuilt_x", "rebuilt_y")
    return rounded(out, "rebuilt_x", "rebuilt_y", digits=3)


@query(f"""WITH {E}, m AS (SELECT *, y > 50 AS v FROM tr), n AS (SELECT *, coalesce((v IS DISTINCT FROM lag(v) OVER w)::BIGINT, 1) AS nw, row_number() OVER w AS rn FROM m {W}),
k AS (SELECT *, (sum(CASE WHEN rn = 1 THEN 0 ELSE nw END) OVER (PARTITION BY river_id ORDER BY idx ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM n)
SELECT river_id, run, min(idx) AS start, count(*) AS length, any_value(v) AS value FROM k GROUP BY 1, 2""")
def rle_runs(spark, sf_dir):
    return ordered.runs(st.events(spark, sf_dir), F.col("y") > 50)


@query(f"""WITH {E}, {D}, {C}, k AS (SELECT river_id, idx AS ind_l, s, c, lead(idx) OVER w AS ind_r, lead(s) OVER w AS sr, lead(c) OVER w AS cr FROM cv {W})
SELECT river_id, ind_l, ind_r, round(s - (sr - s) / (cr - c) * c, 6) + 0.0 AS s_inf FROM k WHERE (c > 0) <> (cr > 0)""")
def inflection_points(spark, sf_dir):
    return rounded(ordered.inflections(curved(spark, sf_dir)), "s_inf")


@query(f"""WITH {TL}, n AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE (y IS DISTINCT FROM lag(y) OVER w)::BIGINT END AS nw FROM tl {W}),
k AS (SELECT *, sum(nw) OVER (PARTITION BY river_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n),
g AS (SELECT river_id, run, min(idx) AS st, count(*) AS ln, any_value(y) AS v FROM k GROUP BY 1, 2),
h AS (SELECT *, lag(v) OVER o AS b, lead(v) OVER o AS a FROM g WINDOW o AS (PARTITION BY river_id ORDER BY run))
SELECT river_id, ((st + st + ln - 1) // 2)::BIGINT AS peak_idx, v AS peak_value FROM h WHERE v > b AND v > a""")
def local_peaks(spark, sf_dir):
    return ordered.local_peaks(st.lineitems(spark, sf_dir), "y")


@query(f"""WITH {E}, {D}, {C}, k AS (SELECT *, row_number() OVER (PARTITION BY river_id ORDER BY abs(c) DESC, idx) AS rn FROM cv WHERE c IS NOT NULL)
SELECT river_id, idx AS idx_c_max, {r('s', 'x', 'y', 'c').replace('AS s', 'AS s_c_max').replace('AS x', 'AS x_c_max').replace('AS y', 'AS y_c_max').replace('AS c', 'AS c_max')} FROM k WHERE rn = 1""")
def argmax_curvature(spark, sf_dir):
    return rounded(ordered.extreme_curvature(curved(spark, sf_dir)), "s_c_max", "x_c_max", "y_c_max", "c_max")


@query(f"WITH {E}, t AS (SELECT river_id, idx, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y FROM tr {W}) SELECT river_id, idx, {r('x', 'y')} FROM t")
def translate_start(spark, sf_dir):
    return rounded(ordered.translated(st.events(spark, sf_dir)), "x", "y")


@query(f"WITH {E}, {D}, t AS (SELECT river_id, idx, x / 30.0 AS x, y / 30.0 AS y, s / 30.0 AS s FROM p) SELECT river_id, idx, {r('x', 'y', 's')} FROM t")
def scale_coords(spark, sf_dir):
    return rounded(ordered.scaled(transects(spark, sf_dir), 30.0), "x", "y", "s")


_CHORD = f"""f AS (SELECT *, first_value(x) OVER v AS xa, first_value(y) OVER v AS ya, last_value(x) OVER v AS xb, last_value(y) OVER v AS yb FROM {{0}} WINDOW v AS (PARTITION BY {{1}} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t0 AS (SELECT *, CASE WHEN xa - xb = 0 THEN CASE WHEN ya - yb > 0 THEN {math.pi / 2} WHEN ya - yb < 0 THEN {-math.pi / 2} END ELSE atan((ya - yb) / (xa - xb)) END AS t1 FROM f),
t2 AS (SELECT *, coalesce(CASE WHEN t1 < 0 THEN t1 + {2 * math.pi} ELSE t1 END, 0.0) AS th FROM t0)"""


@query(f"WITH {E}, {_CHORD.format('tr', 'river_id')}, o AS (SELECT river_id, idx, (x - xa) * cos(th) + (y - ya) * sin(th) AS x, (y - ya) * cos(th) - (x - xa) * sin(th) AS y FROM t2) SELECT river_id, idx, {r('x', 'y')} FROM o")
def translate_rotate(spark, sf_dir):
    return rounded(ordered.chord_aligned(st.events(spark, sf_dir)), "x", "y")


@query(f"WITH {TL}, g AS (SELECT *, pow(10, avg(log10(w_m)) OVER (PARTITION BY river_id)) AS w_gm FROM tl), o AS (SELECT river_id, idx, x / w_gm AS x, y / w_gm AS y, w_m, w_gm FROM g) SELECT river_id, idx, w_m, {r('x', 'y', 'w_gm')} FROM o")
def width_scaled(spark, sf_dir):
    return rounded(ordered.width_scaled(st.lineitems(spark, sf_dir)), "x", "y", "w_gm")


_GRID = """ge AS (SELECT river_id, min(s) AS s0, max(s) AS s1, count(*) AS n FROM p GROUP BY 1), gd AS (SELECT *, (s1 - s0) / nullif(n - 1, 0) AS ds FROM ge),
gr AS (SELECT river_id, k, s0 + k * ds AS s FROM (SELECT *, unnest(range(0, ceil((s1 - s0 + ds / 2) / ds)::BIGINT)) AS k FROM gd WHERE ds > 0))"""


@query(f"WITH {E}, {D}, {_GRID} SELECT river_id, k, {r('s')} FROM gr")
def regular_grid(spark, sf_dir):
    return rounded(ordered.regular_grid(transects(spark, sf_dir)), "s")


_KNOT = """kn AS (SELECT river_id, idx, s, y, lead(s) OVER w AS s2, lead(y) OVER w AS y2, lag(s) OVER w AS s0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY river_id ORDER BY idx)),
sa AS (SELECT river_id, k, s + 0.4 AS s FROM gr), aj AS (SELECT sa.river_id, sa.k, sa.s AS sq, kn.* EXCLUDE (river_id) FROM sa ASOF JOIN kn ON sa.river_id = kn.river_id AND sa.s >= kn.s)"""


def stations(points: DataFrame) -> DataFrame:
    return ordered.regular_grid(points).withColumn("s", F.col("s") + 0.4)


@query(f"""WITH {E}, {D}, {_GRID}, {_KNOT} SELECT river_id, k, round(sq, 6) AS s,
round(CASE WHEN s2 IS NULL THEN y0 + (y - y0) / (s - s0) * (sq - s0) ELSE y + (y2 - y) / (s2 - s) * (sq - s) END, 6) + 0.0 AS y FROM aj""")
def interp_linear(spark, sf_dir):
    p = transects(spark, sf_dir)
    return rounded(ordered.interpolated(p, stations(p), "y"), "s", "y")


@query(f"WITH {E}, {D}, {_GRID}, {_KNOT} SELECT river_id, k, round(sq, 6) AS s, y FROM aj")
def interp_previous(spark, sf_dir):
    p = transects(spark, sf_dir)
    return rounded(ordered.previous(p, stations(p), "y"), "s")


@query(f"WITH {E}, {D}, {_GRID}, {_KNOT} SELECT river_id, k, CASE WHEN s2 IS NOT NULL AND s2 - sq < sq - s THEN idx + 1 ELSE idx END AS idx FROM aj")
def nearest_station(spark, sf_dir):
    p = transects(spark, sf_dir)
    return ordered.nearest(p, stations(p))


_BEND_COLS = ("lambda_fm", "L_fm", "x_start", "x_end", "y_start", "y_end", "s_start", "s_end", "s_middle")


@query(f"WITH {B} SELECT river_id, bend_id, idx_start, idx_end, n_points, {r(*_BEND_COLS)}, round(lambda_fm / nullif(L_fm, 0), 6) AS sigma_fm FROM bends")
def bend_table(spark, sf_dir):
    return rounded(metrics.bends(st.bend_points(spark, sf_dir)), *_BEND_COLS, "sigma_fm")


@query(f"WITH {B}, {_CHORD.format('bp', 'river_id, bend_id')}, o AS (SELECT river_id, bend_id, (y - ya) * cos(th) - (x - xa) * sin(th) AS a FROM t2) SELECT river_id, bend_id, round(max(a) - min(a), 6) + 0.0 AS amplitude FROM o GROUP BY 1, 2")
def bend_amplitude(spark, sf_dir):
    return rounded(metrics.amplitude(st.bend_points(spark, sf_dir)), "amplitude")


@query(f"""WITH {E}, {D}, {C}, {st.SQL_BENDS.format(level=0.0).replace('FROM p)', 'FROM cv)', 1)}, m AS (SELECT *, first_value(idx) OVER (PARTITION BY river_id, bend_id ORDER BY abs(c) DESC, idx) AS top FROM bs),
a AS (SELECT river_id, bend_id, sum(CASE WHEN idx <= top THEN bd ELSE 0.0 END) AS lambda_u, sum(CASE WHEN idx > top THEN bd ELSE 0.0 END) AS lambda_d FROM m GROUP BY 1, 2)
SELECT river_id, bend_id, {r('lambda_u', 'lambda_d')}, round((lambda_u - lambda_d) / nullif(lambda_u + lambda_d, 0), 6) + 0.0 AS a_fm FROM a""")
def bend_asymmetry(spark, sf_dir):
    a = metrics.asymmetry(metrics.side_runs(curved(spark, sf_dir)))
    return rounded(a, "lambda_u", "lambda_d", "a_fm")


_CIRCLE = """mo0 AS (SELECT *, avg(x) OVER v AS mx, avg(y) OVER v AS my FROM bp WINDOW v AS (PARTITION BY river_id, bend_id)),
mo1 AS (SELECT *, x - mx AS u, y - my AS v, (x - mx) * (x - mx) + (y - my) * (y - my) AS z FROM mo0),
mo AS (SELECT river_id, bend_id, count(*) AS n, max(mx) AS mx, max(my) AS my, avg(u * u) AS xx, avg(v * v) AS yy, avg(u * v) AS xy, avg(u * z) AS xz, avg(v * z) AS yz, avg(z * z) AS zz FROM mo1 GROUP BY 1, 2),
co AS (SELECT *, xx + yy AS mz, xx * yy - xy * xy AS cov, zz - (xx + yy) * (xx + yy) AS vr FROM mo),
cf AS (SELECT *, 4 * cov - 3 * mz * mz - zz AS a2, vr * mz + 4 * cov * mz - xz * xz - yz * yz AS a1, xz * (xz * yy - yz * xy) + yz * (yz * xx - xz * xy) - vr * cov AS a0 FROM co),
nt AS (SELECT *, list_reduce(range(0, 31)::DOUBLE[], lambda t, i: t - coalesce((a0 + t * (a1 + t * (a2 + t * 4 * mz))) / nullif(a1 + t * (2 * a2 + t * 12 * mz), 0), 0.0)) AS t FROM cf),
dt AS (SELECT *, t * t - t * mz + cov AS det FROM nt),
ci AS (SELECT river_id, bend_id, n, CASE WHEN abs(det) > 1e-12 * mz * mz THEN (xz * (yy - t) - yz * xy) / (2 * det) END AS ux, CASE WHEN abs(det) > 1e-12 * mz * mz THEN (yz * (xx - t) - xz * xy) / (2 * det) END AS uy, mx, my, mz FROM dt)"""


@query(f"WITH {B}, {_CIRCLE}, o AS (SELECT river_id, bend_id, ux + mx AS cx, uy + my AS cy, sqrt(ux * ux + uy * uy + mz) AS radius FROM ci WHERE n > 3) SELECT river_id, bend_id, {r('cx', 'cy', 'radius', digits=3)} FROM o WHERE radius < 1e4")
def bend_circle(spark, sf_dir):
    p = st.bend_points(spark, sf_dir)
    n = p.groupBy(*metrics.BEND).count().where("count > 3").drop("count")
    return rounded(metrics.fitted_circle(p).join(n, metrics.BEND).where("radius < 1e4"), "cx", "cy", "radius", digits=3)


@query(f"""WITH {B}, {_CIRCLE}, q0 AS (SELECT *, sum(bd) OVER (PARTITION BY river_id, bend_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS bsum FROM bs), q1 AS (SELECT *, max(bsum) OVER (PARTITION BY river_id, bend_id) AS lam FROM q0),
md AS (SELECT river_id, bend_id, x, y, lam, row_number() OVER (PARTITION BY river_id, bend_id ORDER BY abs(bsum - lam / 2), idx) AS rn FROM q1)
SELECT river_id, bend_id, round(sqrt((ux + mx - x) * (ux + mx - x) + (uy + my - y) * (uy + my - y)) / sqrt(ux * ux + uy * uy + mz) * lam / {4 * math.pi}, 4) AS R_hm FROM ci JOIN md USING (river_id, bend_id) WHERE rn = 1 AND n > 3 AND sqrt(ux * ux + uy * uy + mz) < 1e4""")
def bend_radius(spark, sf_dir):
    p = st.bend_points(spark, sf_dir)
    n = p.groupBy(*metrics.BEND).count().where("count > 3").drop("count")
    out = metrics.radius_of_curvature(p).join(n, metrics.BEND).where("radius < 1e4")
    return rounded(out.select(*metrics.BEND, "R_hm"), "R_hm", digits=4)


@query(f"WITH {B}, n AS (SELECT river_id, bend_id, floor(y / 10)::BIGINT AS so, count(*) AS n FROM bp GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY river_id, bend_id ORDER BY n DESC, so) AS rn FROM n) SELECT river_id, bend_id, so FROM k WHERE rn = 1")
def bend_mode_attr(spark, sf_dir):
    p = st.bend_points(spark, sf_dir).withColumn("so", F.floor(F.col("y") / 10).cast("long"))
    return metrics.most_frequent(p, "so")


_REACH = """lv AS (SELECT *, bend_id % 3 AS tree FROM bends), bo AS (SELECT *, unnest([-1, tree]) AS tree_id FROM lv),
rk AS (SELECT *, row_number() OVER (PARTITION BY river_id, tree_id ORDER BY bend_id) - 1 AS k, count(*) OVER (PARTITION BY river_id, tree_id) AS n FROM bo),
pt AS (SELECT river_id, tree_id, k, x_start AS px, y_start AS py FROM rk WHERE k % 2 = 0 AND k < n - 1 UNION ALL SELECT river_id, tree_id, n, x_end, y_end FROM rk WHERE k = n - 1),
sx AS (SELECT river_id, tree_id, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)) AS X FROM pt WINDOW w AS (PARTITION BY river_id, tree_id ORDER BY k)),
fu AS (SELECT river_id, tree_id, sum(X) AS sx FROM sx GROUP BY 1, 2),
ha AS (SELECT river_id, tree_id, sum(lambda_fm) AS sl, sum(L_fm) AS sy, avg(lambda_fm) AS mean_half_meander_length, sqrt(pow(arg_max(x_end, k) - arg_min(x_start, k), 2) + pow(arg_max(y_end, k) - arg_min(y_start, k), 2)) AS D FROM rk GROUP BY 1, 2)
SELECT river_id, tree_id, round(D, 6) AS D, round(sl / nullif(D, 0), 6) AS total_sinuosity, round(sl / nullif(sy, 0), 6) AS half_meander_sinuosity, round(sy / nullif(sx, 0), 6) AS full_meander_sinuosity,
round(sx / nullif(D, 0), 6) AS residual_meander_sinuosity, round(mean_half_meander_length, 6) AS mean_half_meander_length FROM ha LEFT JOIN fu USING (river_id, tree_id)"""


@query(f"WITH {B}, {_REACH}")
def reach_metrics(spark, sf_dir):
    b = metrics.bends(st.bend_points(spark, sf_dir)).withColumn("tree_id", F.col("bend_id") % 3)
    m = metrics.reach_metrics(b)
    return rounded(m, *(c for c in m.columns if c not in ("river_id", "tree_id")))


@query(f"""WITH {B}, n AS (SELECT river_id, count(*) AS n_river FROM tr GROUP BY 1)
SELECT river_id, bend_id, row_number() OVER (PARTITION BY river_id ORDER BY s_middle, bend_id) - 1 AS meander_id FROM bends JOIN n USING (river_id) WHERE idx_end > idx_start AND (idx_end - idx_start) <= 0.8 * n_river""")
def bend_validity(spark, sf_dir):
    p = st.bend_points(spark, sf_dir)
    n = p.groupBy("river_id").agg(F.count(F.lit(1)).alias("n_river"))
    return metrics.valid_bends(metrics.bends(p), n).select("river_id", "bend_id", "meander_id")


_WIDE = "wd AS (SELECT river_id, bend_id, idx_start - bend_id % 3 AS idx_start, idx_end + bend_id % 2 AS idx_end FROM bends)"


def wide_bends(spark, sf_dir):
    """Bends that overlap or leave gaps, so that clipping has work."""
    b = metrics.bends(st.bend_points(spark, sf_dir))
    return b.select("river_id", "bend_id", (F.col("idx_start") - F.col("bend_id") % 3).alias("idx_start"), (F.col("idx_end") + F.col("bend_id") % 2).alias("idx_end"))


@query(f"WITH {B}, {_WIDE} SELECT river_id, bend_id, least(idx_start, lag(idx_end) OVER (PARTITION BY river_id ORDER BY idx_start, bend_id)) AS idx_start, idx_end FROM wd")
def clip_downstream(spark, sf_dir):
    return metrics.clipped(wide_bends(spark, sf_dir), "downstream")


@query(f"WITH {B}, {_WIDE} SELECT river_id, bend_id, idx_start, greatest(idx_end, lead(idx_start) OVER (PARTITION BY river_id ORDER BY idx_start, bend_id)) AS idx_end FROM wd")
def clip_upstream(spark, sf_dir):
    return metrics.clipped(wide_bends(spark, sf_dir), "upstream")


def marked(spark, sf_dir, level: float) -> DataFrame:
    p = st.bend_points(spark, sf_dir, level)
    arrays = p.groupBy(*metrics.BEND).agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    arrays = arrays.select(*metrics.BEND, F.transform("p", lambda v: v["x"]).alias("x"), F.transform("p", lambda v: v["y"]).alias("y"))
    return metrics.bends(p).select(*metrics.BEND, "x_start", "y_start", "x_end", "y_end").join(arrays, metrics.BEND)


def _sql_marked(name: str, level: float) -> str:
    inner = st.SQL_BENDS.format(level=level)
    return f"{name} AS (WITH {inner} SELECT b.*, a.xs, a.ys FROM bends b JOIN (SELECT river_id, bend_id, list(x ORDER BY idx) AS xs, list(y ORDER BY idx) AS ys FROM bp GROUP BY 1, 2) a USING (river_id, bend_id))"


@query(f"""WITH {E}, {D}, {_sql_marked('m1', 0.0)}, {_sql_marked('m2', 10.0)},
j AS (SELECT a.river_id, a.bend_id AS bend_id_1, b.bend_id AS bend_id_2, a.xs AS xa, b.xs AS xb, len(list_distinct(list_intersect(a.xs, b.xs))) AS nx, len(list_distinct(list_intersect(a.ys, b.ys))) AS ny,
 row_number() OVER (PARTITION BY a.river_id, a.bend_id ORDER BY sqrt((a.x_start - b.x_start) * (a.x_start - b.x_start) + (a.y_start - b.y_start) * (a.y_start - b.y_start)), b.bend_id) AS rs,
 row_number() OVER (PARTITION BY a.river_id, a.bend_id ORDER BY sqrt((a.x_end - b.x_end) * (a.x_end - b.x_end) + (a.y_end - b.y_end) * (a.y_end - b.y_end)), b.bend_id) AS re FROM m1 a JOIN m2 b USING (river_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY river_id, bend_id_1 ORDER BY CASE WHEN nx = ny THEN nx ELSE 0 END DESC, CASE WHEN rs <= 2 THEN rs ELSE re + 2 END) AS rb FROM j WHERE rs <= 2 OR re <= 2),
z AS (SELECT river_id, bend_id_1, bend_id_2, nx / len(xb) AS f_oa, nx / len(xa) AS f_om FROM k WHERE rb = 1)
SELECT river_id, bend_id_1, bend_id_2, {r('f_oa', 'f_om')}, (CASE WHEN f_oa >= 0.8 AND f_om >= 0.8 THEN 1 WHEN f_oa >= 0.8 THEN 2 WHEN f_om >= 0.8 THEN 3 ELSE 4 END)::BIGINT AS zone FROM z""")
def closest_bends(spark, sf_dir):
    c = compare.closest(marked(spark, sf_dir, 0.0), marked(spark, sf_dir, 10.0), "river_id")
    return rounded(c.select("river_id", "bend_id_1", "bend_id_2", "f_oa", "f_om", F.col("Zone").alias("zone")), "f_oa", "f_om")


@query(f"""WITH {E}, {D}, {_sql_marked('m1', 0.0)}, {_sql_marked('m2', 10.0)}, j AS (SELECT a.river_id, a.bend_id, len(list_intersect(a.xs, b.xs)) / len(b.xs) AS f_oa, len(list_intersect(a.xs, b.xs)) / len(a.xs) AS f_om FROM m1 a JOIN m2 b USING (river_id, bend_id))
SELECT river_id, bend_id, {r('f_oa', 'f_om')}, (CASE WHEN f_oa >= 0.8 AND f_om >= 0.8 THEN 1 WHEN f_oa >= 0.8 THEN 2 WHEN f_om >= 0.8 THEN 3 ELSE 4 END)::BIGINT AS zone FROM j""")
def compare_zones(spark, sf_dir):
    one = marked(spark, sf_dir, 0.0).select(*metrics.BEND, F.col("x").alias("x_1"))
    j = one.join(marked(spark, sf_dir, 10.0).select(*metrics.BEND, F.col("x").alias("x_2")), metrics.BEND)
    f_oa, f_om = compare.overlaps(F.col("x_1"), F.col("x_2"))
    j = j.withColumns({"f_oa": f_oa, "f_om": f_om}).withColumn("zone", compare.zone(F.col("f_oa"), F.col("f_om")))
    return rounded(j.select(*metrics.BEND, "f_oa", "f_om", "zone"), "f_oa", "f_om")


@query(f"WITH {TL}, m AS (SELECT *, min(idx) OVER (PARTITION BY river_id, y) AS f FROM tl) SELECT river_id, idx, y FROM m WHERE f = idx")
def first_occurrence(spark, sf_dir):
    p = st.lineitems(spark, sf_dir).select("river_id", "idx", F.col("y").alias("x"))
    return ordered.distinct_x(p).select("river_id", "idx", F.col("x").alias("y"))


@query(f"""WITH k AS (SELECT i, 2 * {math.pi} / 100 AS w, 5 * 100.0 / 999 * i AS s FROM range(0, 1001) t(i)), a AS (SELECT *, {math.radians(110)} * cos(w * s) + 0.344 * sin(3 * w * s) + 0.031 * cos(3 * w * s) AS th FROM k),
b AS (SELECT i, s, -w * ({math.radians(110)} * sin(w * s) - 3 * 0.344 * cos(3 * w * s) + 3 * 0.031 * sin(3 * w * s)) AS c, th FROM a),
d AS (SELECT i AS idx, CASE WHEN i < 1000 THEN s END AS s, CASE WHEN i < 1000 THEN c END AS c, coalesce(sum(500.0 / 999 * cos(th)) OVER o, 0.0) AS x, coalesce(sum(500.0 / 999 * sin(th)) OVER o, 0.0) AS y FROM b WINDOW o AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT idx, {r('s', 'c', 'x', 'y')} FROM d""")
def kinoshita_zolezzi(spark, sf_dir):
    return rounded(synth.zolezzi(spark, math.radians(110), 100.0, 0.344, 0.031, 5, 1000).drop("river_id"), "s", "c", "x", "y")


@query(f"""WITH k AS (SELECT i, 2 * {math.pi} / 100 AS w, 5 * 100.0 / 999 * i AS s FROM range(0, 1000) t(i)), a AS (SELECT *, {math.radians(110)} * sin(w * s) + pow({math.radians(110)}, 3) * (0.1 * cos(3 * w * s) - 0.05 * sin(3 * w * s)) AS th FROM k),
b AS (SELECT i, s, w * {math.radians(110)} * cos(w * s) - 3 * w * pow({math.radians(110)}, 3) * (0.1 * sin(3 * w * s) + 0.05 * cos(3 * w * s)) AS c, th FROM a),
d AS (SELECT i AS idx, s, c, coalesce(sum(500.0 / 999 * cos(th)) OVER o, 0.0) AS x, coalesce(sum(500.0 / 999 * sin(th)) OVER o, 0.0) AS y FROM b WINDOW o AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT idx, {r('s', 'c', 'x', 'y')} FROM d""")
def kinoshita_abad(spark, sf_dir):
    return rounded(synth.abad(spark, math.radians(110), 100.0, 0.1, 0.05, 5, 1000).drop("river_id"), "s", "c", "x", "y")


@query("SELECT supp, n, names FROM (SELECT s_suppkey AS supp, len(s_name) AS n, 'LINESTRING (' || s_suppkey::VARCHAR || ' ' || s_nationkey::VARCHAR || ')' AS names FROM supplier)")
def wkt_points(spark, sf_dir):
    s = st.read(spark, sf_dir, "supplier")
    line = scalar.wkt_line(F.array("s_suppkey"), F.array("s_nationkey"))
    return s.select(F.col("s_suppkey").alias("supp"), F.length("s_name").cast("long").alias("n"), line.alias("names"))


@query("SELECT o_orderkey, 3 AS n, o_orderkey::DOUBLE AS v1, 2.5::DOUBLE AS v2, -1.0::DOUBLE AS v3 FROM orders")
def parsed_vectors(spark, sf_dir):
    text = F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(". 2.5\n  -1.]"))
    return st.read(spark, sf_dir, "orders").select("o_orderkey", scalar.parse_vector(text).alias("v")).select(
        "o_orderkey", F.size("v").alias("n"), *(F.element_at("v", i).alias(f"v{i}") for i in (1, 2, 3))
    )


_TRI = "c_acctbal::DOUBLE AS ax, c_nationkey::DOUBLE AS ay, c_custkey::DOUBLE % 97 AS bx, c_custkey::DOUBLE % 31 + 5 AS by_, c_custkey::DOUBLE % 53 + 100 AS cx, c_custkey::DOUBLE % 11 - 50 AS cy"


@query(f"""WITH t AS (SELECT c_custkey, {_TRI} FROM customer), u AS (SELECT *, 2 * (ax * (by_ - cy) + bx * (cy - ay) + cx * (ay - by_)) AS d, ax * ax + ay * ay AS qa, bx * bx + by_ * by_ AS qb, cx * cx + cy * cy AS qc FROM t)
SELECT c_custkey, round((qa * (by_ - cy) + qb * (cy - ay) + qc * (ay - by_)) / nullif(d, 0), 4) + 0.0 AS ux, round((qa * (cx - bx) + qb * (ax - cx) + qc * (bx - ax)) / nullif(d, 0), 4) + 0.0 AS uy FROM u""")
def triangle_centres(spark, sf_dir):
    k = F.col("c_custkey").cast("double")
    c = st.read(spark, sf_dir, "customer")
    ux, uy = scalar.circumcenter(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"), k % 97, k % 31 + 5, k % 53 + 100, k % 11 - 50)
    return rounded(c.select("c_custkey", ux.alias("ux"), uy.alias("uy")), "ux", "uy", digits=4)


@query("""WITH t AS (SELECT c_custkey, c_acctbal::DOUBLE AS v FROM customer) SELECT c_custkey, round(exp(-(v / 1000 * v / 1000) / 2) / sqrt(2 * pi()), 6) AS g,
round(greatest(0.0, least(1.0, CASE WHEN v <= 1000 THEN 0.5 * (v + 1000) / 2000 ELSE 0.5 + 0.5 * (v - 1000) / 9000 END)), 8) AS shade FROM t""")
def gaussian_and_scale(spark, sf_dir):
    v = F.col("c_acctbal").cast("double")
    out = st.read(spark, sf_dir, "customer").select("c_custkey", scalar.gaussian(v / 1000, 1.0).alias("g"), scalar.mid_point_scale(v, -1000.0, 1000.0, 10000.0).alias("shade"))
    return rounded(rounded(out, "g"), "shade", digits=8)
