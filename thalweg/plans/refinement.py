"""Queries of splines as tables, of spans moved to their inflections, and of what hangs below a node."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg.operators import inflections, lines, metrics, scale_tree, splines
from thalweg.plans import geometry
from thalweg.plans import standins as st
from thalweg.plans.geometry import curved, r, rounded, transects
from thalweg.plans.signals import RIVER_TREE, _long_rivers
from thalweg.sources.scratch import written

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _middles(points):
    """Stations in the middle of every step, a quarter of a step before the first point and one after the last."""
    p = points.groupBy("river_id").agg(F.sort_array(F.collect_list("s")).alias("s")).where(F.size("s") > 1)
    inner = F.transform(F.slice("s", 2, F.size("s") - 1), lambda x, i: (x + F.get("s", i)) / 2)
    ends = F.array(F.col("s")[0] - 0.25, F.get("s", F.size("s") - 1) + 0.25)
    return p.select("river_id", F.posexplode(F.concat(inner, ends)).alias("k", "s"))


# Second derivatives at the knots by elimination along the line, without outer knots; the outer polynomials go on beyond the ends.
_KNOTS = f"""WITH RECURSIVE {st.SQL_EVENTS}, {st.sql_distance()},
u AS (SELECT river_id, 'x' AS dim, s, x AS v FROM p UNION ALL SELECT river_id, 'y', s, y FROM p),
e AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY river_id, dim) AS n, lead(s) OVER w - s AS h, (lead(v) OVER w - v) / (lead(s) OVER w - s) AS d FROM u WINDOW w AS (PARTITION BY river_id, dim ORDER BY s)),
g AS (SELECT *, lag(h) OVER w AS hb, lead(h) OVER w AS ha, lag(h, 2) OVER w AS hbb, d - lag(d) OVER w AS rise FROM e WINDOW w AS (PARTITION BY river_id, dim ORDER BY i)),
q AS (SELECT river_id, dim, i, n, 6 * rise AS rhs,
        2 * (hb + h) + CASE WHEN i = 1 THEN hb * (1 + hb / h) ELSE 0 END + CASE WHEN i = n - 2 THEN h * (1 + h / hb) ELSE 0 END AS diag,
        CASE WHEN i = 1 THEN 0 ELSE hb END - CASE WHEN i = n - 2 THEN h * h / hb ELSE 0 END AS low,
        CASE WHEN i = n - 2 THEN 0 ELSE h END - CASE WHEN i = 1 THEN hb * hb / h ELSE 0 END AS up FROM g WHERE n >= 4 AND i BETWEEN 1 AND n - 2),
f AS (SELECT river_id, dim, i, n, up / diag AS c, rhs / diag AS r FROM q WHERE i = 1
      UNION ALL SELECT q.river_id, q.dim, q.i, q.n, q.up / (q.diag - q.low * f.c), (q.rhs - q.low * f.r) / (q.diag - q.low * f.c) FROM f JOIN q ON q.river_id = f.river_id AND q.dim = f.dim AND q.i = f.i + 1),
b AS (SELECT river_id, dim, i, r AS m FROM f WHERE i = n - 2 UNION ALL SELECT f.river_id, f.dim, f.i, f.r - f.c * b.m FROM b JOIN f ON f.river_id = b.river_id AND f.dim = b.dim AND f.i = b.i - 1),
m0 AS (SELECT g.*, b.m, lead(b.m) OVER w AS ma, lead(b.m, 2) OVER w AS maa, lag(b.m) OVER w AS mb, lag(b.m, 2) OVER w AS mbb FROM g LEFT JOIN b USING (river_id, dim, i) WINDOW w AS (PARTITION BY g.river_id, g.dim ORDER BY g.i)),
m1 AS (SELECT river_id, dim, i, n, s, v, h, CASE WHEN n = 2 THEN 0 WHEN n = 3 THEN max(2 * rise / (h + hb)) OVER (PARTITION BY river_id, dim) WHEN i = 0 THEN ma * (1 + h / ha) - maa * h / ha WHEN i = n - 1 THEN mb * (1 + hb / hbb) - mbb * hb / hbb ELSE m END AS m FROM m0),
z AS (SELECT *, lead(m) OVER w AS m2, lead(v) OVER w AS v2 FROM m1 WINDOW w AS (PARTITION BY river_id, dim ORDER BY i))"""
_CUBIC = f"""{_KNOTS},
a AS (SELECT *, (i)::BIGINT AS k, h / 2 AS t FROM z WHERE i < n - 1 UNION ALL SELECT *, n - 1, -0.25 FROM z WHERE i = 0 AND n > 1 UNION ALL SELECT *, n, h + 0.25 FROM z WHERE i = n - 2),
o AS (SELECT river_id, k, dim, s + t AS s, (m * pow(h - t, 3) + m2 * pow(t, 3)) / (6 * h) + (v / h - m * h / 6) * (h - t) + (v2 / h - m2 * h / 6) * t AS value,
             (m2 * t * t - m * (h - t) * (h - t)) / (2 * h) + (v2 - v) / h - (m2 - m) * h / 6 AS slope FROM a)
SELECT river_id, k, round(max(s), 4) + 0.0 AS s, {', '.join(f"round(max({c}) FILTER (WHERE dim = '{d}'), 4) + 0.0 AS {n}" for c, d, n in (('value', 'x', 'x'), ('value', 'y', 'y'), ('slope', 'x', 'dxds'), ('slope', 'y', 'dyds')))} FROM o GROUP BY river_id, k"""


@query(_CUBIC)
def spline_table(spark, sf_dir):
    p = transects(spark, sf_dir)
    out = splines.at_stations(splines.fitted(p), _middles(p), derivatives=(0, 1)).withColumn("k", F.col("k").cast("long"))
    return rounded(out, "s", "x", "y", "dxds", "dyds", digits=4)


_STEPS = f"""{_KNOTS},
gm AS (SELECT river_id, min(s) AS s0, max(s) AS s1, pow(10, avg(log10(nullif(d, 0)))) AS ds FROM p GROUP BY 1 HAVING count(*) > 1),
ak AS (SELECT river_id, k, s0 + k * ds AS sk, dim FROM (SELECT river_id, unnest(range(0, ceil((s1 - s0 + ds / 2) / ds)::BIGINT)) AS k, s0, ds FROM gm), (VALUES ('x'), ('y')) v(dim)),
iv AS (SELECT * FROM z WHERE i < n - 1),
o AS (SELECT a.river_id, k, a.dim, sk, sk - s AS t, h, v, v2, m, m2 FROM ak a ASOF JOIN iv ON a.river_id = iv.river_id AND a.dim = iv.dim AND a.sk >= iv.s),
e2 AS (SELECT river_id, k, dim, sk, (m * pow(h - t, 3) + m2 * pow(t, 3)) / (6 * h) + (v / h - m * h / 6) * (h - t) + (v2 / h - m2 * h / 6) * t AS value,
       (m2 * t * t - m * (h - t) * (h - t)) / (2 * h) + (v2 - v) / h - (m2 - m) * h / 6 AS slope, (m * (h - t) + m2 * t) / h AS bend FROM o)
SELECT river_id, k, round(max(sk), 4) + 0.0 AS s, {', '.join(f"round(max({c}) FILTER (WHERE dim = '{d}'), 4) + 0.0 AS {n}" for c, d, n in (('value', 'x', 'x'), ('value', 'y', 'y'), ('slope', 'x', 'dxds'), ('slope', 'y', 'dyds'), ('bend', 'x', 'd2xds2'), ('bend', 'y', 'd2yds2')))} FROM e2 GROUP BY river_id, k"""


@query(_STEPS)
def resample_spline(spark, sf_dir):
    return rounded(lines.resampled(transects(spark, sf_dir)), "s", "x", "y", "dxds", "dyds", "d2xds2", "d2yds2", digits=4)


_ENDS = f"""WITH {st.SQL_EVENTS}, {st.sql_distance()}, e AS (SELECT river_id, idx, s, y, lead(s) OVER w AS s2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY river_id) AS n FROM p WINDOW w AS (PARTITION BY river_id ORDER BY idx)),
a AS (SELECT *, idx AS k, (s + s2) / 2 AS place, (y + y2) / 2 AS inside FROM e WHERE idx < n - 1 UNION ALL SELECT *, n - 1, s - 0.25, NULL FROM e WHERE idx = 0 AND n > 1 UNION ALL SELECT *, n, s2 + 0.25, NULL FROM e WHERE idx = n - 2)
SELECT river_id, k, round(place, 6) + 0.0 AS s, round(coalesce(inside, y + (y2 - y) / (s2 - s) * (place - s)), 6) + 0.0 AS extrapolated, round(coalesce(inside, 0), 6) + 0.0 AS zeros,
       round(coalesce(inside, CASE WHEN place < s THEN y ELSE y2 END), 6) + 0.0 AS boundary, round((y2 - y) / (s2 - s), 6) + 0.0 AS slope FROM a"""


@query(_ENDS)
def spline_extension(spark, sf_dir):
    p = transects(spark, sf_dir)
    table, at = splines.fitted(p, order=1, columns=("y",)), _middles(p)
    one = lambda name, **how: splines.evaluated(table, at, **how).select("river_id", "k", "s", F.col("value").alias(name))
    out = one("extrapolated")
    for other in (one("zeros", ext=1), one("boundary", ext=3), one("slope", derivative=1)):
        out = out.join(other.drop("s"), ["river_id", "k"])
    return rounded(out.withColumn("k", F.col("k").cast("long")), "s", "extrapolated", "zeros", "boundary", "slope")


_GRID = f"""WITH {st.SQL_EVENTS}, {st.sql_distance()}, g AS (SELECT river_id, min(s) AS s0, max(s) AS s1, pow(10, avg(log10(nullif(d, 0)))) AS ds FROM p GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT river_id, unnest(range(0, ceil((s1 - s0 + ds / 2) / ds)::BIGINT)) AS k, s0, ds FROM g), a AS (SELECT river_id, k, s0 + k * ds AS s FROM k),
n AS (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lag(s) OVER w AS s9, lag(x) OVER w AS x9, lag(y) OVER w AS y9 FROM p WINDOW w AS (PARTITION BY river_id ORDER BY s)),
j AS (SELECT a.river_id, a.k, a.s, {', '.join(f"CASE WHEN s2 IS NULL THEN n.{c}9 + (n.{c} - n.{c}9) / (n.s - s9) * (a.s - s9) ELSE n.{c} + (n.{c}2 - n.{c}) / (s2 - n.s) * (a.s - n.s) END AS {c}" for c in 'xy')} FROM a ASOF JOIN n ON a.river_id = n.river_id AND a.s >= n.s),
w1 AS (SELECT *, {', '.join(f"{st.sql_gradient(c)} AS d{c}ds" for c in 'xy')} FROM j WINDOW w AS (PARTITION BY river_id ORDER BY k)),
w2 AS (SELECT *, {', '.join(f"{st.sql_gradient(f'd{c}ds')} AS d2{c}ds2" for c in 'xy')} FROM w1 WINDOW w AS (PARTITION BY river_id ORDER BY k))
SELECT river_id, k, {r('s', 'x', 'y', 'dxds', 'dyds', digits=4)} FROM w2"""


@query(_GRID)
def resample_linear(spark, sf_dir):
    out = lines.resampled(transects(spark, sf_dir), order=1).select("river_id", "k", "s", "x", "y", "dxds", "dyds")
    return rounded(out, "s", "x", "y", "dxds", "dyds", digits=4)


@query()
def smoothing_spline(spark, sf_dir):
    """Knots chosen so that x and y of the transects are met within a mean square of a hundred."""
    return splines.fitted(transects(spark, sf_dir), smooth=100.0, per_point=True)


# Runs of equal curvature; a run above both neighbours is a peak of windows that hold a point of either. Windows grow in up to eleven steps.
_BOUNDS = f"""{st.sql_bends()}, {st.sql_curvature()}, cz AS (SELECT river_id, idx, s, coalesce(c, 0.0) AS c FROM cv),
bx AS (SELECT b.river_id, b.bend_id, idx_start AS a, idx_end AS b, CASE WHEN max(c) > abs(min(c)) THEN -1 ELSE 1 END AS m FROM bends b JOIN cz ON cz.river_id = b.river_id AND cz.idx BETWEEN idx_start AND idx_end GROUP BY 1, 2, 3, 4),
sz AS (SELECT river_id, max(idx) AS last, arg_min(s, idx) AS s_first, arg_max(s, idx) AS s_last FROM cz GROUP BY 1),
rn AS (SELECT *, coalesce((c <> lag(c) OVER w)::BIGINT, 0) AS nw FROM cz WINDOW w AS (PARTITION BY river_id ORDER BY idx)),
rr AS (SELECT river_id, c, min(idx) AS lo, max(idx) AS hi FROM (SELECT *, sum(nw) OVER (PARTITION BY river_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM rn) GROUP BY river_id, run, c),
pk AS (SELECT river_id, lo, hi, c, m FROM (SELECT *, lag(c) OVER w AS c0, lead(c) OVER w AS c2 FROM rr WINDOW w AS (PARTITION BY river_id ORDER BY lo)), (VALUES (1), (-1)) v(m) WHERE m * c > m * c0 AND m * c > m * c2),
tw AS (SELECT bx.*, last, side, t, CASE side WHEN -1 THEN greatest(0, a - (b - a) - t * ((b - a) // 2)) ELSE b END AS low, CASE side WHEN -1 THEN a ELSE least(last, b + (b - a) + t * ((b - a) // 2)) END AS high
       FROM bx JOIN sz USING (river_id), (VALUES (-1), (1)) v(side), range(0, 11) u(t)),
ft AS (SELECT tr.river_id, tr.bend_id, side, tr.m, t, low, high, max(tr.m * pk.c) AS top FROM tw tr JOIN pk ON pk.river_id = tr.river_id AND pk.m = tr.m AND pk.lo - 1 >= low AND pk.hi + 1 <= high GROUP BY 1, 2, 3, 4, 5, 6, 7 QUALIFY row_number() OVER (PARTITION BY tr.river_id, tr.bend_id, side ORDER BY t) = 1),
ex AS (SELECT ft.river_id, bend_id, side, min(cz.idx) AS at FROM ft JOIN cz ON cz.river_id = ft.river_id AND cz.idx BETWEEN low AND high AND ft.m * cz.c = top GROUP BY 1, 2, 3),
eb AS (SELECT bx.river_id, bx.bend_id, a, b, coalesce(l.at, a) AS ext_start, coalesce(h.at, b) AS ext_end FROM bx LEFT JOIN ex l ON l.river_id = bx.river_id AND l.bend_id = bx.bend_id AND l.side = -1 LEFT JOIN ex h ON h.river_id = bx.river_id AND h.bend_id = bx.bend_id AND h.side = 1)"""


def _spans(spark, sf_dir):
    """The transects with their curvature and their bends, each written once for all that reads them, and the bends' extended bounds."""
    c = st.dealt(written(curved(spark, sf_dir), "curved"))
    spans = written(metrics.bends(metrics.side_runs(c)).select("river_id", "bend_id", "idx_start", "idx_end"), "spans")
    return c, lines.extended_bounds(c, spans), spans


@query(f"WITH {_BOUNDS.replace('tr AS (SELECT bx', 'tw AS (SELECT bx').replace('FROM tw tr JOIN pk', 'FROM tw tr JOIN pk')} SELECT river_id, bend_id, ext_start::BIGINT AS ext_start, ext_end::BIGINT AS ext_end FROM eb")
def extended_bounds(spark, sf_dir):
    return _spans(spark, sf_dir)[1]


# Windows that grow by one point until they hold a crossing, as written down: the left one from the start back, the right one from the end on.
_REFINED = f"""{_BOUNDS.replace('tr AS (SELECT bx', 'tw AS (SELECT bx').replace('FROM tw tr JOIN pk', 'FROM tw tr JOIN pk')},
cr AS (SELECT river_id, idx AS il, s - (s2 - s) / (c2 - c) * c AS si FROM (SELECT *, lead(s) OVER w AS s2, lead(c) OVER w AS c2 FROM cz WINDOW w AS (PARTITION BY river_id ORDER BY idx)) WHERE (c > 0) <> (c2 > 0)),
gl AS (SELECT eb.*, sz.* EXCLUDE (river_id), a + (b - a) // 2 AS mid FROM eb JOIN sz USING (river_id)),
lw AS (SELECT gl.river_id, gl.bend_id, k, min(si) AS si FROM gl, range(0, (SELECT max(last) + 1 FROM sz)) t(k), cr WHERE k <= a AND cr.river_id = gl.river_id AND il >= a - k AND il + 1 <= mid GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY gl.river_id, gl.bend_id ORDER BY k) = 1),
rw AS (SELECT gl.river_id, gl.bend_id, k, max(si) AS si FROM gl, range(0, (SELECT max(last) + 1 FROM sz)) t(k), cr WHERE b + k <= last AND cr.river_id = gl.river_id AND il >= mid AND il + 1 <= b + k GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY gl.river_id, gl.bend_id ORDER BY k) = 1),
fi AS (SELECT gl.*, coalesce(a - lw.k, 0) AS st, coalesce(lw.si, s_first) AS sl, coalesce(rw.k + 1, last + 2 - b) AS tried, coalesce(rw.si, s_last) AS sr FROM gl LEFT JOIN lw USING (river_id, bend_id) LEFT JOIN rw USING (river_id, bend_id)),
mv AS (SELECT fi.river_id, bend_id, ext_start, ext_end, CASE WHEN st + 1 >= ext_start THEN sl ELSE x.s END AS s_inf_left, CASE WHEN b + tried <= ext_end THEN sr ELSE y.s END AS s_inf_right,
       CASE WHEN st + 1 >= ext_start THEN st + 1 ELSE a END AS inf_start, CASE WHEN b + tried <= ext_end THEN least(b + tried, last) ELSE b END AS inf_end
       FROM fi JOIN cz x ON x.river_id = fi.river_id AND x.idx = a JOIN cz y ON y.river_id = fi.river_id AND y.idx = b),
kn AS (SELECT river_id, s, x, y, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY river_id ORDER BY s)),
kk AS (SELECT river_id, bend_id, side, sv FROM mv, LATERAL (VALUES ('left', s_inf_left), ('right', s_inf_right)) v(side, sv)),
xy AS (SELECT kk.river_id, bend_id, side, x + coalesce((x2 - x) / (s2 - s) * (sv - s), 0) AS x, y + coalesce((y2 - y) / (s2 - s) * (sv - s), 0) AS y FROM kk ASOF JOIN kn ON kk.river_id = kn.river_id AND kk.sv >= kn.s)
SELECT mv.river_id, mv.bend_id, mv.ext_start::BIGINT AS ext_start, mv.ext_end::BIGINT AS ext_end, {r('s_inf_left', 's_inf_right', digits=4)}, inf_start::BIGINT AS inf_start, inf_end::BIGINT AS inf_end,
       round(l.x, 4) + 0.0 AS x_inf_left, round(l.y, 4) + 0.0 AS y_inf_left, round(h.x, 4) + 0.0 AS x_inf_right, round(h.y, 4) + 0.0 AS y_inf_right
FROM mv LEFT JOIN xy l ON l.river_id = mv.river_id AND l.bend_id = mv.bend_id AND l.side = 'left' LEFT JOIN xy h ON h.river_id = mv.river_id AND h.bend_id = mv.bend_id AND h.side = 'right'"""


@query(f"WITH {_REFINED}")
def refined_inflections(spark, sf_dir):
    """Bends of the transects moved to their inflections; x and y there lie on straight lines."""
    c, bounds, spans = _spans(spark, sf_dir)
    extended = written(spans.join(bounds, ["river_id", "bend_id"]), "extended-spans")
    moved = written(inflections.refined(c, extended).drop("idx_start", "idx_end"), "moved-spans")
    out = inflections.at_inflections(moved, splines.fitted(c, order=1))
    return rounded(out, "s_inf_left", "s_inf_right", "x_inf_left", "y_inf_left", "x_inf_right", "y_inf_right", digits=4)


_LEAVES = f"""WITH RECURSIVE {st.SQL_FLOW}, t AS (SELECT comid AS node, tonode AS parent, comid * 7 % 1000 AS idx_start, comid * 7 % 1000 + comid % 13 AS idx_end, comid * 7 % 1000 + 1 AS inf_start, comid * 7 % 1000 + comid % 13 + 2 AS inf_end FROM fl),
leaf AS (SELECT * FROM t WHERE node NOT IN (SELECT parent FROM t)),
up AS (SELECT node, idx_start, idx_end FROM leaf UNION ALL SELECT t.parent, up.idx_start, up.idx_end FROM up JOIN t ON t.node = up.node WHERE t.parent > 0 AND t.parent IN (SELECT node FROM t)),
s AS (SELECT node, min(idx_start) AS a, max(idx_end) AS b FROM up GROUP BY 1)
SELECT s.node, coalesce(leaf.inf_start, a)::BIGINT AS leaf_start, coalesce(leaf.inf_end, b)::BIGINT AS leaf_end FROM s LEFT JOIN leaf USING (node)"""


@query(_LEAVES)
def leaf_spans(spark, sf_dir):
    """Leaves below each order of the heap, with spans made from the order's number."""
    start = F.col("node") * 7 % 1000
    n = st.nodes(spark, sf_dir).select("node", "parent", start.alias("idx_start"), (start + F.col("node") % 13).alias("idx_end"), (start + 1).alias("inf_start"), (start + F.col("node") % 13 + 2).alias("inf_end"))
    known = n.select(F.col("node").alias("parent"))
    return inflections.leaf_spans(n.join(known, "parent", "left_semi").unionByName(n.join(known, "parent", "left_anti").withColumn("parent", F.lit(None).cast("long"))))


@query()
def refined_nodes(spark, sf_dir):
    """Nodes of the long transects' trees with their extended spans, inflections and leaves."""
    rivers = written(scale_tree.gathered(_long_rivers(spark, sf_dir)), "rivers")
    return scale_tree.refined(scale_tree.nodes(rivers.select("river_id", F.col("c").alias("signal")), *RIVER_TREE), rivers)


_PARTS = {n: geometry.QUERIES[n][1] for n in ("bend_table", "bend_amplitude", "bend_asymmetry", "bend_radius")}
_TOP = f"""WITH {st.sql_bends()}, {st.sql_curvature()}, k AS (SELECT bp.river_id, bend_id, idx, s, x, y, c FROM bp JOIN (SELECT river_id, idx, c FROM cv) v USING (river_id, idx)),
t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY river_id, bend_id ORDER BY abs(c) DESC NULLS LAST, idx) = 1)
SELECT river_id, bend_id, {r('s', 'x', 'y', 'c')} FROM t"""


@query(f"""SELECT b.*, amplitude, a_fm, R_hm, t.s AS s_c_max, t.x AS x_c_max, t.y AS y_c_max, t.c AS c_max, sign(t.c)::BIGINT AS curvature_side FROM ({_PARTS['bend_table']}) b JOIN ({_PARTS['bend_amplitude']}) USING (river_id, bend_id)
JOIN (SELECT river_id, bend_id, a_fm FROM ({_PARTS['bend_asymmetry']})) USING (river_id, bend_id) JOIN (SELECT river_id, bend_id, R_hm FROM ({_PARTS['bend_radius']})) USING (river_id, bend_id) JOIN ({_TOP}) t USING (river_id, bend_id) WHERE n_points > 3""")
def span_database(spark, sf_dir):
    """All metrics of the transects' bends of four points and more (three always lie on a circle), from their spans alone.

    Bends so straight that doubles do not fix their circle are left out.
    """
    c, _, spans = _spans(spark, sf_dir)
    round_ = metrics.radius_of_curvature(metrics.side_runs(c)).where("radius < 1e4").select(*metrics.BEND)
    out = rounded(scale_tree.bend_database(spans, c).where("n_points > 3").join(round_, metrics.BEND, "left_semi"), "R_hm", digits=4)
    own = ["idx_start", "idx_end", "n_points", *geometry._BEND_COLS, "sigma_fm", "amplitude", "a_fm", "R_hm", "s_c_max", "x_c_max", "y_c_max", "c_max"]
    return rounded(out.select("river_id", "bend_id", *own, "curvature_side"), *own[3:])
