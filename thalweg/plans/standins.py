"""The test tables read as rivers, flow lines, trees and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.operators import metrics, ordered


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Points that a task sorts at a time: a row of few bytes in a shuffle takes up to 2 KB in the sorts and windows of one stage.
POINTS_A_TASK = 150_000


def dealt(points: DataFrame) -> DataFrame:
    """Points by river over as many tasks as keep each one small, and never over fewer than there are cores.

    Left to itself Spark joins partitions until their compressed bytes fill a task, whatever they take in memory.
    """
    parts = max(points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // POINTS_A_TASK))  # by the files' footers
    return points.repartition(parts, "river_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transect per user: x is the place in order of time, y the value."""
    e = dealt(read(spark, sf_dir, "events").select(F.col("user_id").alias("river_id"), "ts", "event_id", F.col("value").alias("y")))
    i = (F.row_number().over(Window.partitionBy("river_id").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select("river_id", i.alias("idx"), i.cast("double").alias("x"), "y")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long transect per supplier: y is a tenth of the quantity, width one plus the tax."""
    w = Window.partitionBy("river_id").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    i = (F.row_number().over(w) - 1).cast("long")
    # named first: what follows by river_id then needs no second shuffle
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    li = dealt(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("river_id"), *columns))
    return li.select(
        "river_id", i.alias("idx"), i.cast("double").alias("x"),
        (F.col("l_quantity").cast("double") / 10).alias("y"), (1 + F.col("l_tax").cast("double")).alias("w_m"),
    )


def flowlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary heap of flow lines: each order flows into the one of half its number."""
    o = read(spark, sf_dir, "orders")
    c = F.col("o_orderkey") + 1
    return o.select(
        c.cast("long").alias("comid"), c.cast("long").alias("fromnode"), F.expr("cast((o_orderkey + 1) div 2 as long)").alias("tonode"),
        F.col("o_totalprice").cast("double").alias("totdasqkm"), (F.col("o_totalprice").cast("double") / 10).alias("areasqkm"),
        (F.col("o_custkey") % 4 + 1).cast("long").alias("streamorde"), (F.col("o_custkey") % 3 + 1).cast("long").alias("streamcalc"),
        (c % 3).cast("long").alias("divergence"), (F.when(F.col("o_orderpriority") == "1-URGENT", 56600).otherwise(46006)).cast("long").alias("fcode"),
        (c % 5 == 0).cast("long").alias("startflag"), (c % 7 == 0).cast("long").alias("terminalfl"),
        (0.25 + F.col("o_custkey") % 8 / 4).cast("double").alias("lengthkm"), F.lpad(F.col("o_custkey").cast("string"), 14, "0").alias("reachcode"),
    )


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heap as trees below its nodes 2 and 3: parent pointers, power, widths, places."""
    f = flowlines(spark, sf_dir).where("comid > 1")
    return f.select(
        F.lit(0).cast("long").alias("tree_id"), F.col("comid").alias("node_id"), F.col("tonode").alias("from_node_id"),
        F.col("totdasqkm").alias("peak_pwr"), (F.col("comid") % 1000 * 1.0).alias("x_c"), (F.col("comid") % 77 * 1.0).alias("y_c"),
        (F.col("comid") % 991 * 1.0).alias("x_2"), (F.col("comid") % 79 * 1.0).alias("y_2"), (1 + F.col("comid") % 10 / 4).alias("sn"),
        (F.col("comid") % 100 * 1.0).alias("wavelength_c"), (1 + F.col("streamorde") * 1.0).alias("w_m"), (F.col("comid") % 50 * 1.0).alias("radius"),
        (F.col("comid") * 1.0).alias("s_c"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heap as node and parent (null at the top), with a value."""
    f = flowlines(spark, sf_dir)
    return f.select(F.col("comid").alias("node"), F.when(F.col("tonode") > 0, F.col("tonode")).alias("parent"), F.col("totdasqkm").alias("value"))


def bend_points(spark: SparkSession, sf_dir: str, level: float = 0.0) -> DataFrame:
    """Points of the event transects with their bend: runs on one side of the mean."""
    return metrics.side_runs(ordered.distances(events(spark, sf_dir)), level)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal of unit spacing per embedding."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("river_id"), F.col("embedding").cast("array<double>").alias("signal"))


# The same in SQL, for the checks.
SQL_EVENTS = "tr AS (SELECT user_id AS river_id, row_number() OVER w - 1 AS idx, (row_number() OVER w - 1)::DOUBLE AS x, value AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
SQL_LINES = "tl AS (SELECT l_suppkey AS river_id, row_number() OVER w - 1 AS idx, (row_number() OVER w - 1)::DOUBLE AS x, l_quantity::DOUBLE / 10 AS y, 1 + l_tax::DOUBLE AS w_m FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey))"
SQL_FLOW = """fl AS (SELECT (o_orderkey + 1)::BIGINT AS comid, (o_orderkey + 1)::BIGINT AS fromnode, ((o_orderkey + 1) // 2)::BIGINT AS tonode,
  o_totalprice::DOUBLE AS totdasqkm, o_totalprice::DOUBLE / 10 AS areasqkm, (o_custkey % 4 + 1)::BIGINT AS streamorde, (o_custkey % 3 + 1)::BIGINT AS streamcalc,
  ((o_orderkey + 1) % 3)::BIGINT AS divergence, (CASE WHEN o_orderpriority = '1-URGENT' THEN 56600 ELSE 46006 END)::BIGINT AS fcode,
  ((o_orderkey + 1) % 5 = 0)::BIGINT AS startflag, ((o_orderkey + 1) % 7 = 0)::BIGINT AS terminalfl,
  (0.25 + (o_custkey % 8) / 4)::DOUBLE AS lengthkm, lpad(o_custkey::VARCHAR, 14, '0') AS reachcode FROM orders)"""


def sql_distance(source: str = "tr", name: str = "p") -> str:
    return (
        f"{name}0 AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0.0) AS d FROM {source} WINDOW w AS (PARTITION BY river_id ORDER BY idx)), "
        f"{name} AS (SELECT *, sum(d) OVER (PARTITION BY river_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM {name}0)"
    )


def sql_gradient(f: str) -> str:
    h1, h2 = "(s - lag(s) OVER w)", "(lead(s) OVER w - s)"
    f0, f2 = f"lag({f}) OVER w", f"lead({f}) OVER w"
    return (
        f"coalesce(({h1} * {h1} * {f2} + ({h2} * {h2} - {h1} * {h1}) * {f} - {h2} * {h2} * {f0}) / nullif({h1} * {h2} * ({h1} + {h2}), 0), "
        f"({f} - {f0}) / nullif({h1}, 0), ({f2} - {f}) / nullif({h2}, 0))"
    )


def sql_curvature(source: str = "p") -> str:
    w = "WINDOW w AS (PARTITION BY river_id ORDER BY idx)"
    return (
        f"g1 AS (SELECT *, {sql_gradient('x')} AS x1, {sql_gradient('y')} AS y1 FROM {source} {w}), "
        f"g2 AS (SELECT *, {sql_gradient('x1')} AS x2, {sql_gradient('y1')} AS y2 FROM g1 {w}), "
        "cv AS (SELECT *, (x1 * y2 - y1 * x2) / nullif(pow(x1 * x1 + y1 * y1, 1.5), 0) AS c FROM g2)"
    )


SQL_BENDS = (
    "sr AS (SELECT *, y - avg(y) OVER (PARTITION BY river_id) > {level} AS side FROM p), "
    "sn AS (SELECT *, coalesce((side <> lag(side) OVER (PARTITION BY river_id ORDER BY idx))::BIGINT, 0) AS nw FROM sr), "
    "bp AS (SELECT *, (sum(nw) OVER (PARTITION BY river_id ORDER BY idx ROWS UNBOUNDED PRECEDING))::BIGINT AS bend_id FROM sn), "
    "bs AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0.0) AS bd FROM bp WINDOW w AS (PARTITION BY river_id, bend_id ORDER BY idx)), "
    "bt AS (SELECT river_id, bend_id, min(idx) AS idx_start, max(idx) AS idx_end, count(*) AS n_points, sum(bd) AS lambda_fm, arg_min(x, idx) AS x_start, arg_max(x, idx) AS x_end, "
    "arg_min(y, idx) AS y_start, arg_max(y, idx) AS y_end, arg_min(s, idx) AS s_start, arg_max(s, idx) AS s_end FROM bs GROUP BY ALL), "
    "bends AS (SELECT *, sqrt((x_end - x_start) * (x_end - x_start) + (y_end - y_start) * (y_end - y_start)) AS L_fm, s_start + (s_end - s_start) / 2 AS s_middle FROM bt)"
)


def sql_bends(level: float = 0.0) -> str:
    return f"{SQL_EVENTS}, {sql_distance()}, " + SQL_BENDS.format(level=level)
