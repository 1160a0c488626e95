"""Queries of lines in polygons with holes and of lines given in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg.operators import network, shapes
from thalweg.plans import standins as st
from thalweg.plans.geometry import rounded
from thalweg.plans.networks import _PTS, _coords

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


#: A trough with two arms, and a hole in the left one, for every nation.
RING = ((0, 0), (300, 0), (300, 100), (200, 100), (200, 40), (100, 40), (100, 100), (0, 100))
HOLE = ((20, 20), (60, 20), (60, 60), (20, 60))


def troughs(spark, sf_dir):
    shape = lambda ring: F.array(*(F.struct((F.col("n_nationkey") * 400 + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ring))
    return st.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly_id"), shape(RING).alias("ring"), F.array(shape(HOLE)).alias("holes"))


def strokes(spark, sf_dir):
    """A line of four points for every order, on a grid of tens, so that it often runs along an edge or through a corner."""
    c = F.col("comid")
    point = lambda k: F.struct(
        (c * 30 % 10000 + k * (c % 7 * 10 - 30)).cast("double").alias("x"), (c * 10 % 110 + k * (c % 3 * 10 - 10)).cast("double").alias("y")
    )
    return st.flowlines(spark, sf_dir).select("comid", F.array(*(point(k) for k in range(4))).alias("pts"))


def _values(ring):
    return ", ".join(f"({x}, {y}, {x2}, {y2})" for (x, y), (x2, y2) in zip(ring, (*ring[1:], ring[0]), strict=True))


_EDGES = f"ed AS (SELECT n_nationkey AS poly_id, (n_nationkey * 400 + ax)::DOUBLE AS ax, ay::DOUBLE AS ay, (n_nationkey * 400 + bx)::DOUBLE AS bx, by_::DOUBLE AS by_ FROM nation, (VALUES {_values(RING)}, {_values(HOLE)}) v(ax, ay, bx, by_))"
_ON = "abs((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) <= 1e-6 AND x BETWEEN least(ax, bx) - 1e-6 AND greatest(ax, bx) + 1e-6 AND y BETWEEN least(ay, by_) - 1e-6 AND greatest(ay, by_) + 1e-6"
_CROSS = "(ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax"


@query(f"""WITH {st.SQL_FLOW}, {_EDGES}, pp AS (SELECT comid, k, (comid * 30 % 10000 + k * (comid % 7 * 10 - 30))::DOUBLE AS x1, (comid * 10 % 110 + k * (comid % 3 * 10 - 10))::DOUBLE AS y1 FROM fl, range(0, 4) t(k)),
sg AS (SELECT comid, k, x1, y1, lead(x1) OVER w AS x2, lead(y1) OVER w AS y2 FROM pp WINDOW w AS (PARTITION BY comid ORDER BY k)),
se AS (SELECT s.*, poly_id, ax, ay, bx, by_, (x2 - x1) * (by_ - ay) - (y2 - y1) * (bx - ax) AS d FROM sg s JOIN ed ON s.x2 IS NOT NULL AND s.x1 BETWEEN poly_id * 400 - 100 AND poly_id * 400 + 400),
tt AS (SELECT comid, poly_id, k, x1, y1, x2, y2, unnest([0.0, 1.0]) AS t FROM se
  UNION SELECT comid, poly_id, k, x1, y1, x2, y2, ((ax - x1) * (by_ - ay) - (ay - y1) * (bx - ax)) / d FROM se WHERE d <> 0 AND ((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1)) / d BETWEEN 0 AND 1
  UNION SELECT comid, poly_id, k, x1, y1, x2, y2, ((ax - x1) * (x2 - x1) + (ay - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0) FROM se WHERE d = 0 AND (ax - x1) * (y2 - y1) = (ay - y1) * (x2 - x1)),
tm AS (SELECT *, (t + lead(t) OVER (PARTITION BY comid, poly_id, k ORDER BY t)) / 2 AS m FROM tt WHERE t BETWEEN 0 AND 1),
md AS (SELECT comid, poly_id, k, m, x1 + m * (x2 - x1) AS x, y1 + m * (y2 - y1) AS y FROM tm WHERE m IS NOT NULL),
jd AS (SELECT comid, poly_id, k, m, bool_or({_ON}) AS edge, count(*) FILTER (WHERE {_CROSS}) % 2 = 1 AS inside FROM md JOIN ed USING (poly_id) GROUP BY 1, 2, 3, 4)
SELECT comid, poly_id FROM jd GROUP BY 1, 2 HAVING bool_and(edge OR inside) AND bool_or(inside AND NOT edge)""")
def lines_within_polygons(spark, sf_dir):
    return shapes.lines_within(strokes(spark, sf_dir), troughs(spark, sf_dir), 50.0)


@query(f"""WITH {st.SQL_FLOW}, {_PTS}, g AS (SELECT comid, arg_min(x, k) AS x0, arg_min(y, k) AS y0, arg_max(x, k) AS x2, arg_max(y, k) AS y2, max(CASE WHEN k = 1 THEN x END) AS x1, max(CASE WHEN k = 1 THEN y END) AS y1 FROM pc GROUP BY 1),
s AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS a, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS b FROM g)
SELECT comid, x0 AS xup_m, y0 AS yup_m, x1 AS xm_m, y1 AS ym_m, CASE WHEN comid % 5 = 0 THEN x1 ELSE x2 END AS xdown_m, CASE WHEN comid % 5 = 0 THEN y1 ELSE y2 END AS ydown_m, round(CASE WHEN comid % 5 = 0 THEN a ELSE a + b END, 6) AS length_m FROM s""")
def multipart_geometry(spark, sf_dir):
    """The flow lines in two parts, in either order; every fifth has a gap between them, so its first part stands for it."""
    lines = st.flowlines(spark, sf_dir)
    one, two = F.slice("pts", 1, 2), F.slice("pts", 2, 2)
    away = F.transform(two, lambda p: F.struct((p["x"] + 1000).alias("x"), p["y"].alias("y")))
    parts = _coords(lines).select("comid", F.when(F.col("comid") % 5 == 0, F.array(one, away)).when(F.col("comid") % 2 == 0, F.array(two, one)).otherwise(F.array(one, two)).alias("parts"))
    g = network.located(lines, parts)
    return rounded(g.select("comid", "xup_m", "yup_m", "xm_m", "ym_m", "xdown_m", "ydown_m", "length_m"), "length_m")
