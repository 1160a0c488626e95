"""Lines against polygons with holes, and lines of several parts.

Rings and lines are taken apart into edges and segments, which are dealt to square cells,
so a segment meets only the edges near it and a point the edges of its own band; no ring
and no line travels whole.

Implements: N3 (lines), N4 (parts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.operators import graph
from thalweg.sources.scratch import written

#: A point counts as on an edge within this share of one plus its coordinates.
TOLERANCE = 1e-9


def _steps(pts: Column, closed: bool) -> Column:
    """Neighbouring points of an array, as structs a and b; with the last and the first if ``closed``."""
    after = F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0)))
    ends = F.concat(after, F.slice(pts, 1, 1)) if closed else after
    starts = pts if closed else F.slice(pts, F.lit(1), F.greatest(F.size(pts) - 1, F.lit(0)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def edges_of(polygons: DataFrame) -> DataFrame:
    """poly_id, ax, ay, bx, by: the edges of all rings; ``holes`` (array of rings) is optional."""
    rings = F.array(F.col("ring"))
    if "holes" in polygons.columns:
        rings = F.concat(rings, F.coalesce("holes", F.slice(rings, 1, 0)))
    e = polygons.select("poly_id", F.explode(rings).alias("r")).select("poly_id", F.explode(_steps(F.col("r"), True)).alias("e"))
    return e.select("poly_id", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")).where("ax <> bx or ay <> by")


def _span(a: Column, b: Column, cell: float) -> Column:
    return F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))


def sides(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """``points`` (poly_id, x, y and more) with ``where_``: 1 inside their polygon, 0 on its border, -1 outside.

    The even-odd rule over the edges of a point's band; points of a polygon without edges in
    their band are outside.
    """
    names = points.columns
    dealt = edges.withColumn("_j", F.explode(_span(F.col("ay"), F.col("by"), cell)))
    at = points.withColumns({"_p": F.monotonically_increasing_id(), "_j": F.floor(F.col("y") / cell)})
    at = written(at, "shape-points")
    near = at.select("_p", "poly_id", "_j", "x", "y").join(dealt, ["poly_id", "_j"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    crossing = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < dx * F.try_divide(F.col("y") - F.col("ay"), dy) + F.col("ax"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    off = F.greatest(F.abs(F.col("ax") + t * dx - F.col("x")), F.abs(F.col("ay") + t * dy - F.col("y")))
    on = off <= TOLERANCE * (1 + F.abs("x") + F.abs("y"))
    met = near.groupBy("_p").agg(F.count_if(crossing).alias("n"), F.bool_or(on).alias("on"))
    side = F.when(F.col("on"), 0).when(F.col("n") % 2 == 1, 1).otherwise(-1)
    return at.join(met, "_p", "left").select(*names, F.coalesce(side, F.lit(-1)).cast("long").alias("where_"))


def lines_within(coords: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Comid and poly_id of the lines that lie in a polygon: nothing of them outside it, something off its border.

    ``coords`` has comid and pts, an array of (x, y); polygons poly_id, ring and, if there are
    any, holes. Segments are cut where they meet an edge, and the middle of each part
    is looked up, so a line may touch the border but not leave between two of its points.
    ``cell`` is best about the length of a segment or edge.
    """
    edges = written(edges_of(polygons), "edges")
    one = F.struct(F.col("pts")[0].alias("a"), F.col("pts")[0].alias("b"))
    segments = coords.where(F.size("pts") > 0).select("comid", F.posexplode(F.when(F.size("pts") > 1, _steps(F.col("pts"), False)).otherwise(F.array(one))).alias("k", "s"))
    segments = segments.select("comid", "k", *(F.col(f"s.{e}.{c}").alias(f"{c}{n}") for n, e in ((1, "a"), (2, "b")) for c in "xy"))
    segments = written(segments, "segments")
    # polygons whose box, by cells, holds the line's first point
    box = edges.groupBy("poly_id").agg(*(f(g("a" + c, "b" + c)).alias(n + c) for c in "xy" for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))))
    boxes = box.withColumn("_i", F.explode(F.sequence(F.floor(F.col("lox") / cell), F.floor(F.col("hix") / cell)))).withColumn("_j", F.explode(F.sequence(F.floor(F.col("loy") / cell), F.floor(F.col("hiy") / cell))))
    first = segments.where("k = 0").withColumns({"_i": F.floor(F.col("x1") / cell), "_j": F.floor(F.col("y1") / cell)}).join(boxes, ["_i", "_j"])
    inside_box = (F.col("x1") >= F.col("lox")) & (F.col("x1") <= F.col("hix")) & (F.col("y1") >= F.col("loy")) & (F.col("y1") <= F.col("hiy"))
    starts = first.where(inside_box).select("comid", "poly_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    pairs = sides(starts, edges, cell).where("where_ >= 0").select("comid", "poly_id")
    own = written(segments.join(pairs, "comid"), "segments-by-polygon")
    cuts = F.array(F.lit(0.0), F.lit(1.0))
    places = own.select("*", F.explode(cuts).alias("t")).unionByName(_cuts(own, edges, cell)).distinct()
    parts = places.groupBy("comid", "poly_id", "k", "x1", "y1", "x2", "y2").agg(F.sort_array(F.collect_set("t")).alias("t"))
    middle = parts.select("comid", "poly_id", "x1", "y1", "x2", "y2", F.explode(_steps(F.col("t"), False)).alias("m")).withColumn("m", (F.col("m.a") + F.col("m.b")) / 2)
    middle = middle.select("comid", "poly_id", *((F.col(f"{c}1") + F.col("m") * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(c) for c in "xy"))
    judged = sides(middle, edges, cell).groupBy("comid", "poly_id").agg(F.min("where_").alias("least"), F.max("where_").alias("most"))
    return judged.where("least >= 0 and most = 1").select("comid", "poly_id")


def _cuts(segments: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """``segments`` with ``t`` for each place between 0 and 1 where they meet an edge of their polygon, both ends of common stretches."""
    names = segments.columns
    deal = lambda f, a, b: f.withColumn("_i", F.explode(_span(F.col(a[0]), F.col(b[0]), cell))).withColumn("_j", F.explode(_span(F.col(a[1]), F.col(b[1]), cell)))
    j = deal(segments, ("x1", "y1"), ("x2", "y2")).join(deal(edges, ("ax", "ay"), ("bx", "by")), ["poly_id", "_i", "_j"])
    rx, ry, sx, sy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    qx, qy = F.col("ax") - F.col("x1"), F.col("ay") - F.col("y1")
    across, length = rx * sy - ry * sx, rx * rx + ry * ry
    t, u = F.try_divide(qx * sy - qy * sx, across), F.try_divide(qx * ry - qy * rx, across)
    hit = F.when((u >= 0) & (u <= 1), F.array(t))
    along = F.array(F.try_divide(qx * rx + qy * ry, length), F.try_divide((qx + sx) * rx + (qy + sy) * ry, length))
    found = F.when(across != 0, hit).when(qx * ry - qy * rx == 0, along)
    return j.select(*names, F.explode(found).alias("t")).where("t > 0 and t < 1")


#: Parts of a line that are put in order where they lie, each one looked for among all; more go by pointers.
FEW_PARTS = 32


def _in_row(parts: Column) -> Column:
    """The points of the parts (no empty ones) along their chain, or null where they make none."""
    n = F.size(parts)
    every = F.sequence(F.lit(0), n - 1)
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  worked out once
    ends = F.transform(parts, lambda p: F.struct(p[0].alias("start"), F.element_at(p, -1).alias("end")))
    meets = lambda e, i, j: (i != j) & F.coalesce(F.get(e, i)["end"] == F.get(e, j)["start"], F.lit(False))
    after = let(ends, lambda e: F.transform(every, lambda i: F.filter(every, lambda j: meets(e, i, j))))

    def way(after: Column, flat: Column) -> Column:
        links = F.size(flat)
        plain = ~F.exists(after, lambda x: F.size(x) > 1) & (F.size(F.array_distinct(flat)) == links)
        # an open chain starts at the part that follows none, a closed one at the first
        head = F.when(plain & (links == n), F.lit(0)).when(plain & (links == n - 1), F.get(F.array_except(every, flat), F.lit(0)))
        step = lambda at, _: F.concat(at, F.coalesce(F.get(after, F.element_at(at, -1)), F.array().cast("array<int>")))
        return F.when(head.isNotNull(), F.array_distinct(F.aggregate(F.slice(every, F.lit(2), n - 1), F.array(head), step)))

    def joined(way: Column) -> Column:
        whole = F.transform(way, lambda i, k: F.when(k == 0, F.get(parts, i)).otherwise(F.slice(F.get(parts, i), F.lit(2), F.size(F.get(parts, i)))))
        return F.when(F.size(way) == n, F.flatten(whole))

    return let(let(after, lambda a: way(a, F.flatten(a))), joined)


def one_line(parts: DataFrame) -> DataFrame:
    """Comid and pts of lines given in ``parts`` (comid, parts: arrays of points), in any order.

    Parts follow each other where one ends at the point at which the other starts. If all
    parts of a line make up one chain, they are joined along it (a closed one from its first
    part on); otherwise the first part stands for the line. Null and empty parts are none; a line without points has null.
    Lines of at most ``FEW_PARTS`` parts are joined in their rows, without a shuffle.
    """
    own = parts.select("comid", F.filter("parts", lambda p: F.size(p) > 0).alias("p"))
    many = F.size("p") > FEW_PARTS
    few = own.where(~F.coalesce(many, F.lit(False)))
    done = few.select("comid", F.when(F.size("p") == 1, F.get("p", F.lit(0))).when(F.size("p") > 1, F.coalesce(_in_row(F.col("p")), F.get("p", F.lit(0)))).alias("pts"))
    long = written(own.where(many).select("comid", F.col("p").alias("parts")), "lines-of-many-parts")
    return done.unionAll(_by_pointers(long)) if long.limit(1).count() else done


def _by_pointers(parts: DataFrame) -> DataFrame:
    """``one_line`` of lines of any number of parts, which are followed by pointer doubling."""
    rows = parts.select("comid", F.posexplode_outer("parts").alias("part", "pts")).where("pts is null or size(pts) > 0")
    rows = written(rows, "parts")
    first = rows.groupBy("comid").agg(F.min_by("pts", "part").alias("first"), F.min("part").alias("lead"), F.count("pts").alias("n"))
    many = rows.join(first.where("n > 1").select("comid", "n"), "comid")
    ends = many.select("comid", "part", F.col("pts")[0].alias("start"), F.element_at("pts", -1).alias("end"))
    after = ends.select("comid", F.col("part").alias("next"), F.col("start").alias("at"))
    links = ends.select("comid", "part", F.col("end").alias("at")).join(after, ["comid", "at"]).where("part <> next")
    # a chain has one link into a part and one out of it at most
    doubled = links.groupBy("comid", "next").count().where("count > 1").select("comid").unionByName(links.groupBy("comid", "part").count().where("count > 1").select("comid")).distinct()
    links = links.join(doubled, "comid", "left_anti")
    closed = links.groupBy("comid").agg(F.count(F.lit(1)).alias("links")).join(first.select("comid", "n", "lead"), "comid").where("links = n").select("comid", "lead")
    links = links.join(closed, "comid", "left").where("lead is null or next <> lead")
    key = lambda c: F.struct("comid", F.col(c).alias("part"))
    nodes = many.join(doubled, "comid", "left_anti").select("comid", "part").join(links.select("comid", F.col("next").alias("part"), F.col("part").alias("before")), ["comid", "part"], "left")
    order = graph.roots(nodes.select(key("part").alias("node"), F.when(F.col("before").isNotNull(), key("before")).alias("parent")))
    order = order.select("node.comid", "node.part", F.col("root.part").alias("root"), "depth")
    chain = many.join(order, ["comid", "part"]).groupBy("comid").agg(F.sort_array(F.collect_list(F.struct("depth", "pts"))).alias("p"), F.count_distinct("root").alias("roots"), F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
    chain = chain.where("roots = 1 and met = n").select("comid", F.flatten(F.transform("p", lambda x, i: F.when(i == 0, x["pts"]).otherwise(F.slice(x["pts"], F.lit(2), F.size(x["pts"]))))).alias("joined"))
    return first.join(chain, "comid", "left").select("comid", F.coalesce("joined", "first").alias("pts"))
