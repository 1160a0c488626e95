"""Where a bend really starts and ends: crossings of zero curvature around its spans.

The first crossing from a span's start on, or else the last one before it, is its left
inflection; the last one up to its end, or else the first after it, its right one. That is
what windows find that grow outwards until they hold a crossing; here spans' ends and
crossings are sorted together, so each end meets the two crossings beside it and no other.

Implements: X11 (inflections and leaf spans), A19.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.operators import graph, ordered, splines


def beside(marks: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (river_id, at, any more) with ``before`` and ``after``: the last of the ``marks`` (river_id, at, any more)
    before the place, and the first at or after it, as structs.
    """
    mark = F.struct(*(F.col(c) for c in marks.columns if c != "river_id"))
    place = F.struct(*(F.col(c) for c in places.columns if c not in ("river_id", "at")))
    one = marks.select("river_id", "at", F.lit(1).alias("kind"), mark.alias("mark"), F.lit(None).alias("place"))
    two = places.select("river_id", "at", F.lit(0).alias("kind"), F.lit(None).alias("mark"), place.alias("place"))
    by, grown = Window.partitionBy("river_id"), (Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumns({
        "before": F.last("mark", ignorenulls=True).over(by.orderBy("at", "kind").rowsBetween(*grown)),
        "after": F.last("mark", ignorenulls=True).over(by.orderBy(F.desc("at"), F.desc("kind")).rowsBetween(*grown)),
    })
    return both.where("kind = 0").select("river_id", "at", "place.*", "before", "after")


def refined(points: DataFrame, spans: DataFrame) -> DataFrame:
    """X11: the spans (river_id, bend_id, idx_start, idx_end, ext_start, ext_end) moved to the inflections beside them.

    ``points`` has river_id, idx (from 0 on), s and c; a null c counts as 0. Adds s_inf_left,
    s_inf_right, inf_start and inf_end. The start moves to the point after the left window's
    first one where that stays in the extended span, else it stays and s_inf_left is its
    own s; the end moves past the right window's likewise, to the last point at most.
    Without a crossing on a side the line's end stands for it.
    """
    curved = points.select("river_id", "idx", "s", F.coalesce("c", F.lit(0.0)).alias("c"))
    marks = ordered.inflections(curved).select("river_id", F.col("ind_l").alias("at"), "s_inf")
    ends = points.groupBy("river_id").agg(F.max("idx").alias("last"), F.min_by("s", "idx").alias("s_first"), F.max_by("s", "idx").alias("s_last"))
    keys = ["river_id", "bend_id"]
    sides = spans.select(*keys, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("idx_start").alias("at")), F.struct(F.lit("b").alias("side"), F.col("idx_end").alias("at")))).alias("e"))
    near = beside(marks, sides.select(*keys, "e.side", "e.at")).join(points.select("river_id", F.col("idx").alias("at"), F.col("s").alias("s_at")), ["river_id", "at"])
    pick = lambda side, c: F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True).alias(f"{c}_{side}")
    near = near.groupBy(*keys).agg(*(pick(side, c) for side in "ab" for c in ("before", "after", "s_at")))
    j = spans.join(near, keys).join(ends, "river_id")
    middle = F.col("idx_start") + F.expr("(idx_end - idx_start) div 2")
    inside = F.col("after_a.at") < middle  # the crossing and the point after it lie up to the middle
    left = F.when(inside, F.struct(F.col("idx_start").alias("at"), F.col("after_a.s_inf").alias("s"))).when(
        F.col("before_a").isNotNull(), F.struct(F.col("before_a.at").alias("at"), F.col("before_a.s_inf").alias("s"))
    ).otherwise(F.struct(F.lit(0).cast("long").alias("at"), F.col("s_first").alias("s")))
    back = F.col("before_b.at") >= middle
    # ``tried`` counts the windows that were looked at
    right = F.when(back, F.struct(F.lit(1).cast("long").alias("tried"), F.col("before_b.s_inf").alias("s"))).when(
        F.col("after_b").isNotNull(), F.struct((F.col("after_b.at") + 2 - F.col("idx_end")).alias("tried"), F.col("after_b.s_inf").alias("s"))
    ).otherwise(F.struct((F.col("last") + 2 - F.col("idx_end")).alias("tried"), F.col("s_last").alias("s")))
    j = j.withColumns({"_l": left, "_r": right})
    moves_l = F.col("_l.at") + 1 >= F.col("ext_start")
    moves_r = F.col("idx_end") + F.col("_r.tried") <= F.col("ext_end")
    return j.select(
        *spans.columns, F.when(moves_l, F.col("_l.s")).otherwise(F.col("s_at_a")).alias("s_inf_left"), F.when(moves_r, F.col("_r.s")).otherwise(F.col("s_at_b")).alias("s_inf_right"),
        F.when(moves_l, F.col("_l.at") + 1).otherwise(F.col("idx_start")).alias("inf_start"),
        F.when(moves_r, F.least(F.col("idx_end") + F.col("_r.tried"), F.col("last"))).otherwise(F.col("idx_end")).alias("inf_end"),
    )


def at_inflections(spans: DataFrame, table: DataFrame) -> DataFrame:
    """``refined`` spans with x and y on the splines of ``table`` at both inflections: x_inf_left and so on."""
    keys = ["river_id", "bend_id"]
    sides = [F.struct(F.lit(side).alias("side"), F.col(f"s_inf_{side}").alias("s")) for side in ("left", "right")]
    places = spans.select(*keys, F.explode(F.array(*sides)).alias("e")).select(*keys, "e.side", "e.s")
    # stations are the distinct places of a river, so equal inflections of nested bends are looked up once
    stations = places.select("river_id", "s").distinct().withColumn("k", F.monotonically_increasing_id())
    values = splines.at_stations(table, stations).select("river_id", "s", "x", "y")
    pick = lambda side, c: F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True).alias(f"{c}_inf_{side}")
    found = places.join(values, ["river_id", "s"]).groupBy(*keys).agg(*(pick(side, c) for side in ("left", "right") for c in "xy"))
    return spans.join(found, keys, "left")


def leaf_spans(nodes: DataFrame) -> DataFrame:
    """Node, leaf_start, leaf_end: from the least start to the largest end of the leaves below each node.

    ``nodes`` has node, parent, idx_start and idx_end, and, where leaves were moved, inf_start
    and inf_end: a leaf goes by its moved span, every node above by the spans its leaves had.
    """
    inner = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    n = nodes.join(inner, "node", "left")
    leaf = F.col("inner").isNull()
    ends = graph.descendants_extreme(n, F.when(leaf, F.col("idx_start")), F.when(leaf, F.col("idx_end")))
    both = n.join(ends.select("node", F.col("low").alias("leaf_start"), F.col("high").alias("leaf_end")), "node")
    own = {"leaf_start": "inf_start", "leaf_end": "inf_end"} if "inf_start" in nodes.columns else {"leaf_start": "leaf_start", "leaf_end": "leaf_end"}
    return both.select("node", *(F.when(leaf, F.col(moved)).otherwise(F.col(c)).alias(c) for c, moved in own.items()))
