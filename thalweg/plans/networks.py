"""Queries of flow-line networks and forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg.functions import scalar
from thalweg.operators import compare, graph, network, tree
from thalweg.plans import standins as st
from thalweg.plans.geometry import rounded

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


FL = st.SQL_FLOW
TREE = f"""{FL}, tn AS (SELECT 0::BIGINT AS tree_id, comid AS node_id, tonode AS from_node_id, totdasqkm AS peak_pwr, comid % 1000 * 1.0::DOUBLE AS x_c, comid % 77 * 1.0::DOUBLE AS y_c, comid % 991 * 1.0::DOUBLE AS x_2,
 comid % 79 * 1.0::DOUBLE AS y_2, 1 + (comid % 10)::DOUBLE / 4 AS sn, comid % 100 * 1.0::DOUBLE AS wavelength_c, 1 + streamorde * 1.0::DOUBLE AS w_m, comid % 50 * 1.0::DOUBLE AS radius FROM fl WHERE comid > 1),
kd AS (SELECT t.*, (NOT EXISTS (SELECT 1 FROM tn p WHERE p.node_id = t.from_node_id))::BIGINT AS root_node, (NOT EXISTS (SELECT 1 FROM tn c WHERE c.from_node_id = t.node_id))::BIGINT AS leaf_node FROM tn t)"""


@query(f"WITH {FL} SELECT comid, tonode FROM fl WHERE divergence <= 1 AND fcode <> 56600 AND streamorde = streamcalc AND NOT (startflag = 1 AND terminalfl = 1)")
def clean_flowlines(spark, sf_dir):
    return network.cleaned(st.flowlines(spark, sf_dir)).select("comid", "tonode")


@query(f"WITH {FL} SELECT comid, totdasqkm FROM fl WHERE startflag = 1")
def headwaters(spark, sf_dir):
    return st.flowlines(spark, sf_dir).where("startflag = 1").select("comid", "totdasqkm")


@query(f"WITH {FL} SELECT comid, substr(reachcode, 1, 2) AS huc02, substr(reachcode, 1, 4) AS huc04, substr(reachcode, 1, 6) AS huc06, substr(reachcode, 1, 8) AS huc08, substr(reachcode, 1, 10) AS huc10 FROM fl")
def huc_prefix(spark, sf_dir):
    return network.with_units(st.flowlines(spark, sf_dir)).select("comid", "huc02", "huc04", "huc06", "huc08", "huc10")


@query(f"WITH {FL} SELECT comid, round(greatest(1.0, CASE WHEN ln(totdasqkm) < 1.6 THEN 2.18 * pow(totdasqkm, 0.191) WHEN ln(totdasqkm) < 5.820 THEN 1.41 * pow(totdasqkm, 0.462) ELSE 7.18 * pow(totdasqkm, 0.183) END), 6) AS width FROM fl")
def channel_width(spark, sf_dir):
    f = st.flowlines(spark, sf_dir)
    return rounded(f.select("comid", scalar.channel_width(F.col("totdasqkm")).alias("width")), "width")


@query(f"WITH {FL} SELECT comid, round(CASE WHEN startflag = 1 THEN CASE WHEN areasqkm > 0 AND areasqkm <> totdasqkm THEN areasqkm WHEN totdasqkm > 0 THEN 0.1 * totdasqkm ELSE 1e-5 END WHEN areasqkm > 0 AND areasqkm <> totdasqkm THEN totdasqkm - areasqkm ELSE totdasqkm END, 6) AS da FROM fl")
def initial_da(spark, sf_dir):
    f = st.flowlines(spark, sf_dir)
    da = scalar.initial_drainage_area(F.col("startflag") == 1, F.lit(0.0), F.col("areasqkm"), F.col("totdasqkm"))
    return rounded(f.select("comid", da.alias("da")), "da")


@query(f"WITH {FL} SELECT f.comid, count(t.comid) AS n_tributaries FROM fl f LEFT JOIN fl t ON t.tonode = f.fromnode GROUP BY 1")
def tributary_count(spark, sf_dir):
    return network.tributaries(st.flowlines(spark, sf_dir))


_STEMS = f"""WITH RECURSIVE {FL}, dn AS (SELECT a.*, b.comid AS down FROM fl a LEFT JOIN fl b ON b.fromnode = a.tonode),
rk AS (SELECT *, row_number() OVER (PARTITION BY down ORDER BY streamorde DESC, totdasqkm DESC, comid) AS r FROM dn),
pt AS (SELECT comid AS node, comid AS root, 0::BIGINT AS depth, down AS link FROM rk WHERE r > 1 OR down IS NULL
 UNION ALL SELECT k.comid, p.root, p.depth + 1, p.link FROM pt p JOIN rk k ON k.down = p.node AND k.r = 1)"""


@query(f"{_STEMS} SELECT node AS comid, root AS path_id, depth AS steps_to_end, coalesce(link, 0) AS linking_comid FROM pt")
def main_stem_paths(spark, sf_dir):
    paths = network.main_stems(st.flowlines(spark, sf_dir))
    return paths.withColumn("linking_comid", F.coalesce("linking_comid", F.lit(0)))


@query(f"{_STEMS}, n AS (SELECT root AS path_id, count(*) AS n_lines, arg_max(node, depth) AS comid_start FROM pt GROUP BY 1 HAVING count(*) > 3) SELECT *, rank() OVER (ORDER BY n_lines DESC, path_id) AS rank FROM n")
def path_ranking(spark, sf_dir):
    return network.ranked_paths(network.main_stems(st.flowlines(spark, sf_dir)), cut=3)


@query(f"{_STEMS} SELECT p.node AS comid, coalesce(p.link, 0) AS linking_comid, (SELECT count(*) FROM fl t WHERE t.tonode = p.node) AS n_tributaries FROM pt p WHERE p.depth = 0")
def linking_table(spark, sf_dir):
    lines = st.flowlines(spark, sf_dir)
    ends = network.main_stems(lines).where("steps_to_end = 0").select("comid", F.coalesce("linking_comid", F.lit(0)).alias("linking_comid"))
    return ends.join(network.tributaries(lines), "comid")


@query(f"WITH RECURSIVE {FL}, t AS (SELECT comid AS node, comid AS root, 0::BIGINT AS depth FROM fl WHERE comid = 1 UNION ALL SELECT f.comid, t.root, t.depth + 1 FROM t JOIN fl f ON f.tonode = t.node) SELECT node AS comid, root AS outlet, depth AS n_steps FROM t")
def downstream_trace(spark, sf_dir):
    d = network.downstream(st.flowlines(spark, sf_dir)).select(F.col("comid").alias("node"), F.col("down").alias("parent"))
    return graph.roots(d).select(F.col("node").alias("comid"), F.col("root").alias("outlet"), F.col("depth").alias("n_steps"))


@query(f"""{_STEMS}, pk AS (SELECT p.root, sum(lengthkm) AS km, max(link) AS link FROM pt p JOIN fl ON fl.comid = p.node GROUP BY 1),
ex AS (SELECT root AS path_id, km AS total_km, link AS nxt, 0::BIGINT AS n_added FROM pk UNION ALL SELECT e.path_id, e.total_km + f.lengthkm, d.down, e.n_added + 1 FROM ex e JOIN fl f ON f.comid = e.nxt JOIN dn d ON d.comid = e.nxt WHERE e.total_km < 6.0 AND e.n_added < 10)
SELECT path_id, max(total_km) AS total_km, max(n_added) AS n_added, max(total_km) >= 6.0 AS reached FROM ex GROUP BY 1""")
def reach_extension(spark, sf_dir):
    lines = st.flowlines(spark, sf_dir)
    return network.extended(network.main_stems(lines), lines, 6.0)


_DOWN = f"WITH RECURSIVE {FL}, nd AS (SELECT comid AS node, CASE WHEN tonode > 0 THEN tonode END AS parent, totdasqkm AS value FROM fl)"


@query(f"{_DOWN}, t AS (SELECT node, node AS root, 0::BIGINT AS depth FROM nd WHERE parent IS NULL UNION ALL SELECT n.node, t.root, t.depth + 1 FROM t JOIN nd n ON n.parent = t.node) SELECT * FROM t")
def node_depth(spark, sf_dir):
    return graph.roots(st.nodes(spark, sf_dir).select("node", "parent"))


@query(f"{_DOWN}, a AS (SELECT node, parent AS up, value FROM nd UNION ALL SELECT a.node, n.parent, a.value FROM a JOIN nd n ON n.node = a.up), b AS (SELECT up AS node, value FROM a WHERE up IS NOT NULL UNION ALL SELECT node, value FROM nd) SELECT node, min(value) AS low, max(value) AS high FROM b GROUP BY 1")
def leaf_bounds(spark, sf_dir):
    return graph.descendants_extreme(st.nodes(spark, sf_dir), F.col("value"))


@query(f"{_DOWN} SELECT n.node, count(c.node) AS n_child FROM nd n LEFT JOIN nd c ON c.parent = n.node GROUP BY 1")
def child_count(spark, sf_dir):
    return graph.child_counts(st.nodes(spark, sf_dir))


@query(f"{_DOWN}, j AS (SELECT node, parent AS up FROM nd WHERE node % 3 <> 0 UNION ALL SELECT j.node, n.parent FROM j JOIN nd n ON n.node = j.up WHERE n.node % 3 = 0) SELECT node, coalesce(max(CASE WHEN up % 3 <> 0 THEN up END), 0) AS parent FROM j GROUP BY 1")
def remove_nodes(spark, sf_dir):
    left = graph.without(st.nodes(spark, sf_dir).select("node", "parent"), F.col("node") % 3 == 0)
    return left.select("node", F.coalesce("parent", F.lit(0)).alias("parent"))


_DIRECTION = "dr AS (SELECT k.*, (CASE WHEN p.node_id IS NULL THEN 0 WHEN sqrt(pow(k.x_2 - p.x_c, 2) + pow(k.y_2 - p.y_c, 2)) < sqrt(pow(k.x_c - p.x_c, 2) + pow(k.y_c - p.y_c, 2)) THEN -1 ELSE 1 END)::BIGINT AS direction FROM kd k LEFT JOIN tn p ON p.node_id = k.from_node_id)"


def _forest(spark, sf_dir):
    return tree.parent_direction(tree.node_kinds(st.forest(spark, sf_dir)))


@query(f"WITH {TREE}, {_DIRECTION} SELECT node_id, direction FROM dr")
def parent_direction(spark, sf_dir):
    return _forest(spark, sf_dir).select("node_id", "direction")


@query(f"WITH {TREE} SELECT node_id, root_node, leaf_node, (root_node = 0 AND leaf_node = 0)::BIGINT AS parent_node FROM kd")
def node_kinds(spark, sf_dir):
    return tree.node_kinds(st.forest(spark, sf_dir)).select("node_id", "root_node", "leaf_node", "parent_node")


@query(f"WITH {TREE} SELECT node_id, CASE WHEN sn < 1.6 THEN 0 ELSE leaf_node END AS is_meander FROM kd")
def prune_sinuosity(spark, sf_dir):
    return tree.pruned_by_sinuosity(tree.node_kinds(st.forest(spark, sf_dir)), "sn", 1.6).select("node_id", "is_meander")


@query(f"WITH {TREE}, sh AS (SELECT *, leaf_node = 1 AND wavelength_c < 10 * w_m AS short FROM kd), gv AS (SELECT DISTINCT s.from_node_id AS node_id FROM sh s JOIN sh p ON p.node_id = s.from_node_id WHERE s.short AND p.radius < 40) SELECT sh.node_id, CASE WHEN gv.node_id IS NOT NULL THEN 1 WHEN short THEN 0 ELSE leaf_node END AS is_meander FROM sh LEFT JOIN gv USING (node_id)")
def prune_width(spark, sf_dir):
    f = tree.node_kinds(st.forest(spark, sf_dir))
    return tree.pruned_by_width(f, 10.0, 40.0).select("node_id", "is_meander")


@query(f"""WITH {TREE}, {_DIRECTION}, ch AS (SELECT from_node_id AS node_id, avg(CASE WHEN direction = 1 THEN peak_pwr END) AS mn, min(leaf_node) AS al FROM dr GROUP BY 1),
wn AS (SELECT d.node_id, d.peak_pwr AS pw FROM dr d JOIN ch USING (node_id) WHERE al = 1 AND leaf_node = 0 AND root_node = 0 AND d.peak_pwr > mn AND radius < 45)
SELECT d.node_id, CASE WHEN w.node_id IS NOT NULL THEN 1 WHEN p.pw IS NOT NULL AND (d.direction = 1 OR d.peak_pwr < p.pw) THEN 0 ELSE d.leaf_node END AS is_meander FROM dr d LEFT JOIN wn w ON w.node_id = d.node_id LEFT JOIN wn p ON p.node_id = d.from_node_id""")
def prune_peak_power(spark, sf_dir):
    return tree.pruned_by_power(_forest(spark, sf_dir), F.lit(45.0)).select("node_id", "is_meander")


_PTS = "co AS (SELECT comid, unnest([0, 1, 2]) AS k FROM fl), pc AS (SELECT comid, k, (comid * 3 + k)::DOUBLE AS x, ((comid * 7 + k * k) % 13)::DOUBLE AS y FROM co)"


def _coords(lines):
    point = lambda k: F.struct((F.col("comid") * 3 + k).cast("double").alias("x"), ((F.col("comid") * 7 + k * k) % 13).cast("double").alias("y"))
    return lines.select("comid", F.array(*(point(k) for k in range(3))).alias("pts"))


@query(f"""WITH {FL}, {_PTS}, g AS (SELECT comid, arg_min(x, k) AS x0, arg_min(y, k) AS y0, arg_max(x, k) AS x2, arg_max(y, k) AS y2, max(CASE WHEN k = 1 THEN x END) AS xm_m, max(CASE WHEN k = 1 THEN y END) AS ym_m FROM pc GROUP BY 1),
l AS (SELECT *, sqrt(pow(xm_m - x0, 2) + pow(ym_m - y0, 2)) + sqrt(pow(x2 - xm_m, 2) + pow(y2 - ym_m, 2)) AS length_m FROM g)
SELECT comid, x0 AS xup_m, y0 AS yup_m, xm_m, ym_m, x2 AS xdown_m, y2 AS ydown_m, round(length_m, 6) AS length_m, round(length_m / nullif(sqrt(pow(x2 - x0, 2) + pow(y2 - y0, 2)), 0), 6) AS sinuosity FROM l""")
def flowline_geometry(spark, sf_dir):
    lines = st.flowlines(spark, sf_dir)
    g = network.located(lines, _coords(lines))
    cols = ("xup_m", "yup_m", "xm_m", "ym_m", "xdown_m", "ydown_m", "length_m", "sinuosity")
    return rounded(g.select("comid", *cols), "length_m", "sinuosity")


@query(f"""{_STEMS}, {_PTS}, pp AS (SELECT p.root AS river_id, row_number() OVER (PARTITION BY p.root ORDER BY p.depth DESC, k) - 1 AS idx, comid, x, y FROM pt p JOIN pc ON pc.comid = p.node),
{st.sql_distance('pp', 'ps')} SELECT river_id, idx, comid, x, y, round(s, 6) AS s FROM ps""")
def path_points(spark, sf_dir):
    lines = st.flowlines(spark, sf_dir).withColumn("hwnodesqkm", F.lit(0.0))
    out = network.assembled(network.main_stems(lines), lines, _coords(lines))
    return rounded(out.select("river_id", "idx", "comid", "x", "y", "s"), "s")


@query("""WITH pl AS (SELECT n_nationkey AS poly_id, n_nationkey * 100.0 - 900 AS x0, (n_nationkey % 5) * 3.0 AS y0 FROM nation), pt AS (SELECT c_custkey AS id, c_acctbal::DOUBLE AS x, c_nationkey::DOUBLE + 0.25 AS y FROM customer)
SELECT id, poly_id FROM pt JOIN pl ON x >= x0 AND x < x0 + 350 AND y >= y0 AND y < y0 + 12""")
def points_within(spark, sf_dir):
    n, c = F.col("n_nationkey") * 100.0 - 900, F.col("n_nationkey") % 5 * 3.0
    corner = lambda dx, dy: F.struct((n + dx).cast("double").alias("x"), (c + dy).cast("double").alias("y"))
    ring = F.array(corner(0, 0), corner(350, 0), corner(350, 12), corner(0, 12))
    polygons = st.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly_id"), ring.alias("ring"))
    cust = st.read(spark, sf_dir, "customer")
    points = cust.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("x"), (F.col("c_nationkey").cast("double") + 0.25).alias("y"))
    return network.within(points, polygons, 400.0).select("id", "poly_id")


@query(f"WITH {TREE} SELECT node_id, CASE WHEN node_id % 4 = 0 THEN -1.0 ELSE peak_pwr END AS peak_pwr FROM tn")
def without_peaks(spark, sf_dir):
    f = st.forest(spark, sf_dir)
    left = tree.without_peaks(f, f.where("node_id % 4 = 0"))
    return left.select("node_id", F.coalesce("peak_pwr", F.lit(-1.0)).alias("peak_pwr"))


@query(f"WITH {TREE} SELECT node_id, row_number() OVER (ORDER BY node_id::DOUBLE, node_id) - 1 AS meander_id FROM kd WHERE leaf_node = 1")
def renumbered_bends(spark, sf_dir):
    out = tree.renumbered(tree.node_kinds(st.forest(spark, sf_dir)))
    return out.where("is_meander = 1").select("node_id", "meander_id")


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice::DOUBLE AS v, 'old' AS kind FROM orders), n AS (SELECT o_orderkey * 2 AS k, 0.5::DOUBLE AS v, 'new' AS kind FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n""")
def upserted_rows(spark, sf_dir):
    o = st.read(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("v"), F.lit("old").alias("kind"))
    new = o.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("k"), F.lit(0.5).alias("v"), F.lit("new").alias("kind"))
    return compare.upserted(old, new, ["k"])


@query("""SELECT 'c' || c_custkey AS uid, c_nationkey::BIGINT AS size, '-' AS region FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey::BIGINT, 'r' || (s_nationkey % 5) FROM supplier""")
def compiled_tables(spark, sf_dir):
    c = st.read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uid"), F.col("c_nationkey").cast("long").alias("size"))
    s = st.read(spark, sf_dir, "supplier")
    s = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("uid"), F.col("s_nationkey").cast("long").alias("size"), F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string")).alias("region"))
    return compare.compiled([c, s]).fillna("-", ["region"])


@query("""WITH b AS (SELECT o_orderkey AS bend, o_custkey % 40 AS start_comid, o_custkey % 60 AS uid FROM orders), r AS (SELECT n_nationkey AS river_id, n_nationkey AS start_comid, n_nationkey + 30 AS uid FROM nation)
SELECT b.bend, coalesce(x.river_id, y.river_id, -1)::BIGINT AS river_id FROM b LEFT JOIN r x ON x.start_comid = b.start_comid LEFT JOIN r y ON y.uid = b.uid""")
def matched_rivers(spark, sf_dir):
    o = st.read(spark, sf_dir, "orders")
    b = o.select(F.col("o_orderkey").alias("bend"), (F.col("o_custkey") % 40).alias("start_comid"), (F.col("o_custkey") % 60).alias("uid"))
    n = F.col("n_nationkey")
    r = st.read(spark, sf_dir, "nation").select(n.alias("river_id"), n.alias("start_comid"), (n + 30).alias("uid"))
    return compare.matched_rivers(b, r).select("bend", F.coalesce(F.col("river_id").cast("long"), F.lit(-1)).alias("river_id"))


@query("""WITH l AS (SELECT c_custkey, c_acctbal::DOUBLE AS ax, c_nationkey::DOUBLE AS ay, (c_custkey % 97)::DOUBLE AS bx, (c_custkey % 31 + 30)::DOUBLE AS by_ FROM customer),
d AS (SELECT *, (ax - bx) * (0.0 - 40) - (ay - by_) * (0.0 - 100) AS det, ax * by_ - ay * bx AS one FROM l)
SELECT c_custkey, round(one * -100.0 / nullif(det, 0), 4) + 0.0 AS x, round(one * -40.0 / nullif(det, 0), 4) + 0.0 AS y FROM d""")
def line_crossings(spark, sf_dir):
    k = F.col("c_custkey")
    c = st.read(spark, sf_dir, "customer")
    x, y = scalar.line_intersection(
        F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"), (k % 97).cast("double"), (k % 31 + 30).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(40.0)
    )
    return rounded(c.select("c_custkey", x.alias("x"), y.alias("y")), "x", "y", digits=4)


@query(f"""{_STEMS}, {_PTS}, ow AS (SELECT p.root AS river_id, p.node, row_number() OVER o AS k, sum(lengthkm) OVER o * 1000 AS s, totdasqkm AS da, startflag, areasqkm FROM pt p JOIN fl ON fl.comid = p.node WINDOW o AS (PARTITION BY p.root ORDER BY p.depth DESC)),
kn0 AS (SELECT river_id, s, da FROM ow UNION ALL SELECT river_id, 0.0, CASE WHEN startflag = 1 THEN CASE WHEN areasqkm > 0 AND areasqkm <> da THEN areasqkm WHEN da > 0 THEN 0.1 * da ELSE 1e-5 END WHEN areasqkm > 0 AND areasqkm <> da THEN da - areasqkm ELSE da END FROM ow WHERE k = 1),
kn AS (SELECT *, lead(s) OVER w AS s2, lead(da) OVER w AS da2, lag(s) OVER w AS s0, lag(da) OVER w AS da0 FROM kn0 WINDOW w AS (PARTITION BY river_id ORDER BY s)),
pp AS (SELECT p.root AS river_id, row_number() OVER (PARTITION BY p.root ORDER BY p.depth DESC, k) - 1 AS idx, x, y FROM pt p JOIN pc ON pc.comid = p.node), {st.sql_distance('pp', 'ps')},
aj AS (SELECT ps.river_id, idx, ps.s AS sq, kn.* EXCLUDE (river_id) FROM ps ASOF JOIN kn ON ps.river_id = kn.river_id AND ps.s >= kn.s),
v AS (SELECT river_id, idx, CASE WHEN s2 IS NULL THEN da0 + (da - da0) / (s - s0) * (sq - s0) ELSE da + (da2 - da) / (s2 - s) * (sq - s) END AS a FROM aj)
SELECT river_id, idx, round(a, 3) AS da_sqkm FROM v""")
def path_drainage(spark, sf_dir):
    lines = st.flowlines(spark, sf_dir).withColumn("hwnodesqkm", F.lit(0.0))
    out = network.assembled(network.main_stems(lines), lines, _coords(lines))
    return rounded(out.select("river_id", "idx", "da_sqkm"), "da_sqkm", digits=3)


def _numbered(spark, sf_dir):
    return st.flowlines(spark, sf_dir).withColumn("dnhydroseq", F.col("comid") * 7919 % 10007)


_HEADS = f"{FL}, hd AS (SELECT comid, row_number() OVER (ORDER BY comid * 7919 % 10007 DESC, comid) AS rank FROM fl WHERE startflag = 1)"


@query(f"WITH {_HEADS} SELECT comid, rank FROM hd WHERE rank <= 25")
def first_headwaters(spark, sf_dir):
    return network.headwaters(_numbered(spark, sf_dir), most=25).select("comid", "rank")


@query(f"""WITH RECURSIVE {_HEADS}, tr AS (SELECT rank, comid AS node FROM hd UNION ALL SELECT t.rank, f.tonode FROM tr t JOIN fl f ON f.comid = t.node WHERE f.tonode > 0),
ow AS (SELECT node AS comid, min(rank) AS rank FROM tr GROUP BY 1), pw AS (SELECT ow.comid, hd.comid AS path_id FROM ow JOIN hd USING (rank))
SELECT comid, path_id, row_number() OVER (PARTITION BY path_id ORDER BY comid) - 1 AS steps_to_end, min(comid) OVER (PARTITION BY path_id) // 2 AS linking_comid FROM pw""")
def downstream_paths(spark, sf_dir):
    paths = network.mapped(_numbered(spark, sf_dir), "downstream")
    return paths.withColumn("linking_comid", F.coalesce("linking_comid", F.lit(0)))


@query(f"WITH {FL} SELECT streamorde, streamcalc, arg_max(comid, totdasqkm * 1e6 - comid * 1e-3) AS comid, max(totdasqkm) AS totdasqkm FROM fl GROUP BY 1, 2")
def unit_outlets(spark, sf_dir):
    return network.outlets(st.flowlines(spark, sf_dir), ["streamorde", "streamcalc"])


@query(f"""WITH RECURSIVE {FL}, dn AS (SELECT a.*, b.comid AS down FROM fl a LEFT JOIN fl b ON b.fromnode = a.tonode AND b.streamcalc = a.streamcalc),
rk AS (SELECT *, row_number() OVER (PARTITION BY down ORDER BY streamorde DESC, totdasqkm DESC, comid) AS r FROM dn),
pt AS (SELECT comid AS node, comid AS root, 0::BIGINT AS depth FROM rk WHERE r > 1 OR down IS NULL UNION ALL SELECT k.comid, p.root, p.depth + 1 FROM pt p JOIN rk k ON k.down = p.node AND k.r = 1)
SELECT node AS comid, root AS path_id, depth AS steps_to_end FROM pt""")
def stems_inside(spark, sf_dir):
    return network.main_stems(st.flowlines(spark, sf_dir), inside=["streamcalc"]).drop("linking_comid")


@query(f"""{_DOWN}, t AS (SELECT node, parent, node AS root, 0::BIGINT AS depth, [node] AS path FROM nd WHERE parent IS NULL OR parent NOT IN (SELECT node FROM nd) UNION ALL SELECT n.node, n.parent, t.root, t.depth + 1, list_append(t.path, n.node) FROM t JOIN nd n ON n.parent = t.node)
SELECT node, coalesce(parent, 0) AS from_node, root, depth, row_number() OVER (ORDER BY root, path) AS place FROM t""")
def pre_order_table(spark, sf_dir):
    return graph.pre_order(st.nodes(spark, sf_dir)).withColumn("from_node", F.coalesce("from_node", F.lit(0)))


@query(f"WITH {st.SQL_EVENTS}, q AS (SELECT river_id, idx AS qid, x + 0.3 AS qx, y - 1 AS qy FROM tr WHERE idx % 17 = 3), d AS (SELECT river_id, qid, idx, sqrt(pow(x - qx, 2) + pow(y - qy, 2)) AS d FROM tr JOIN q USING (river_id)) SELECT river_id, qid, arg_min(idx, (round(d, 9), idx)) AS idx, round(min(d), 6) AS distance FROM d GROUP BY 1, 2")
def nearest_points(spark, sf_dir):
    p = st.events(spark, sf_dir)
    q = p.where("idx % 17 = 3").select("river_id", F.col("idx").alias("qid"), (F.col("x") + 0.3).alias("x"), (F.col("y") - 1).alias("y"))
    return rounded(compare.nearest_point(p, q), "distance")


@query(f"""WITH RECURSIVE {FL}, {_PTS}, t AS (SELECT 1201::BIGINT AS node, 0 AS k UNION ALL SELECT f.tonode, t.k + 1 FROM t JOIN fl f ON f.comid = t.node WHERE f.tonode > 0),
pp AS (SELECT 1201::BIGINT AS river_id, row_number() OVER (ORDER BY t.k, pc.k) - 1 AS idx, comid, x, y FROM t JOIN pc ON pc.comid = t.node), {st.sql_distance('pp', 'ps')} SELECT river_id, idx, comid, x, y, round(s, 6) AS s FROM ps""")
def reach_points(spark, sf_dir):
    lines = st.flowlines(spark, sf_dir).withColumn("hwnodesqkm", F.lit(0.0))
    out = network.reach(lines, _coords(lines), start_comid=1201)
    return rounded(out.select("river_id", "idx", "comid", "x", "y", "s"), "s")


@query(f"""WITH {FL}, {_PTS}, bx AS (SELECT n_nationkey AS poly_id, n_nationkey * 1900.0 AS x0 FROM nation),
wi AS (SELECT comid FROM (SELECT comid, poly_id, count(*) AS n FROM pc JOIN bx ON x >= x0 AND x < x0 + 950 AND y >= -1 AND y < 9.5 GROUP BY 1, 2) WHERE n = 3)
SELECT fl.comid, reachcode[1:4] AS huc04, streamorde * 10 AS extra, (wi.comid IS NOT NULL)::BIGINT AS within_waterbody FROM fl LEFT JOIN wi ON wi.comid = fl.comid
WHERE divergence <= 1 AND fcode <> 56600 AND streamorde = streamcalc AND NOT (startflag = 1 AND terminalfl = 1)""")
def prepared_lines(spark, sf_dir):
    lines = st.flowlines(spark, sf_dir)
    x0 = F.col("n_nationkey") * 1900.0
    corner = lambda dx, y: F.struct((x0 + dx).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    ring = F.array(corner(0, -1.0), corner(950, -1.0), corner(950, 9.5), corner(0, 9.5))
    waters = st.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly_id"), ring.alias("ring"))
    more = lines.select("comid", (F.col("streamorde") * 10).alias("extra"), F.lit(0.0).alias("lengthkm"))
    return network.prepared(lines, _coords(lines), [more], waters, 1000.0).select("comid", "huc04", "extra", "within_waterbody")


@query(f"WITH {TREE} SELECT node_id, row_number() OVER (ORDER BY CASE WHEN node_id % 9 = 0 THEN 1 ELSE 0 END DESC, CASE WHEN node_id % 9 <> 0 THEN peak_pwr END DESC, node_id) AS power_rank FROM tn")
def nodes_by_power(spark, sf_dir):
    f = st.forest(spark, sf_dir).withColumn("peak_pwr", F.when(F.col("node_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("peak_pwr")))
    return tree.by_power(f).select("node_id", "power_rank")


#: The heap of orders below its nodes 2 and 3: a branch for each order without orders below it, up to the top.
_BRANCHES = f"""{st.SQL_FLOW}, lf AS (SELECT comid FROM fl WHERE comid > 3 AND comid * 2 NOT IN (SELECT comid FROM fl) AND comid * 2 + 1 NOT IN (SELECT comid FROM fl)),
br AS (SELECT 1 AS river_id, comid AS branch_id, level, comid >> (n - level)::INT AS node, comid % 5 AS meander_level FROM (SELECT comid, length(bin(comid)) - 2 AS n FROM lf), range(0, 64) t(level) WHERE level <= n)"""


def _branches(spark, sf_dir):
    f = st.flowlines(spark, sf_dir).select("comid")
    below = f.select(F.expr("comid div 2").alias("comid")).distinct()
    leaves = f.where("comid > 3").hint("merge").join(below, "comid", "left_anti").withColumn("n", (F.length(F.bin("comid")) - 2).cast("long"))
    b = leaves.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    return b.select(F.lit(1).alias("river_id"), F.col("comid").alias("branch_id"), "level", F.expr("shiftright(comid, cast(n - level as int))").alias("node"), (F.col("comid") % 5).alias("meander_level"))


@query(f"""WITH {_BRANCHES}, rt AS (SELECT branch_id, arg_min(node, level) AS root, max(level) AS last FROM br GROUP BY 1),
tr AS (SELECT root, dense_rank() OVER (ORDER BY min(branch_id)) - 1 AS tree_id FROM rt GROUP BY 1),
nd AS (SELECT br.*, root, last, lag(node) OVER (PARTITION BY branch_id ORDER BY level) AS from_node FROM br JOIN rt USING (branch_id)),
f1 AS (SELECT * FROM nd QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY branch_id, level) = 1),
f2 AS (SELECT f1.*, tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY branch_id, level) - 1 AS node_id FROM f1 JOIN tr USING (root)),
f3 AS (SELECT a.*, b.node_id AS from_node_id FROM f2 a LEFT JOIN f2 b ON b.tree_id = a.tree_id AND b.node = a.from_node)
SELECT tree_id::BIGINT AS tree_id, node_id::BIGINT AS node_id, coalesce(from_node_id, -1)::BIGINT AS from_node_id, node::BIGINT AS node, (node_id = 0)::BIGINT AS root_node, (node_id > 0 AND level = last)::BIGINT AS leaf_node,
       (node_id > 0 AND level < last)::BIGINT AS parent_node, (level = meander_level)::BIGINT AS is_meander,
       (CASE WHEN level = meander_level THEN row_number() OVER (PARTITION BY tree_id, level = meander_level ORDER BY node_id) - 1 ELSE -1 END)::BIGINT AS meander_id FROM f3""")
def forest_from_branches(spark, sf_dir):
    return tree.from_branches(_branches(spark, sf_dir)).drop("river_id", "level").fillna(-1, ["from_node_id"])


@query(f"""WITH RECURSIVE {st.SQL_FLOW}, t AS (SELECT CASE substr(bin(comid), 2, 1) WHEN '0' THEN 0 ELSE 1 END AS tree, comid, CASE WHEN comid > 3 THEN comid // 2 WHEN comid = 3 THEN 5 END AS up FROM fl WHERE comid > 1),
d AS (SELECT comid, 0 AS depth FROM t WHERE comid = 2 UNION ALL SELECT t.comid, d.depth + 1 FROM d JOIN t ON t.up = d.comid),
o AS (SELECT max(comid) + 1 AS o FROM t WHERE tree = 0), k AS (SELECT DISTINCT up FROM t WHERE up IS NOT NULL)
SELECT 0::BIGINT AS tree_id, (t.comid + tree * o)::BIGINT AS node_id, (CASE WHEN comid = 2 THEN -1 WHEN comid = 3 THEN 5 ELSE t.up + tree * o END)::BIGINT AS from_node_id, depth::BIGINT AS depth, tree::BIGINT AS old_tree_id, t.comid::BIGINT AS old_node_id,
       (comid = 2)::BIGINT AS root_node, (k.up IS NULL)::BIGINT AS leaf_node, (comid <> 2 AND k.up IS NOT NULL)::BIGINT AS parent_node, (k.up IS NULL)::BIGINT AS is_meander
FROM t JOIN d USING (comid) CROSS JOIN o LEFT JOIN k ON k.up = t.comid""")
def linked_trees(spark, sf_dir):
    """The heap's two trees, the second hung on node 5 of the first."""
    f = st.forest(spark, sf_dir).withColumn("tree_id", (F.substring(F.bin("node_id"), 2, 1) == "1").cast("long")).select("tree_id", "node_id", "from_node_id")
    links = f.where("node_id = 3").select("tree_id", F.lit(0).cast("long").alias("to_tree_id"), F.lit(5).cast("long").alias("to_node_id"))
    return tree.linked(f, links).fillna(-1, ["from_node_id"])
