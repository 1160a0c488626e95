"""Flow-line networks: cleaning, main stems, reaches.

Flow lines have comid, fromnode, tonode and attributes; a line flows into the one whose
fromnode is its tonode.

Implements: F1, F2, F12, F13, N1-N9, R1, R3-R9, T1, T2, T5, T7, A17, A22, M1, IO9, IO11, IO19.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.functions.scalar import channel_width, huc, initial_drainage_area, step_length
from thalweg.operators import shapes
from thalweg.operators.graph import descendants_extreme, paths_from, roots
from thalweg.operators.ordered import distances, distinct_x, interpolated
from thalweg.operators.ranking import ranked
from thalweg.sources.scratch import written

#: Feature codes that are no river.
NOT_RIVERS = (56600, 42800, 42801, 42802, 42803, 42804, 42805, 42806, 42807, 42808, 42809, 42810, 42811, 42812, 42813, 42814, 42815, 42816)


def with_units(lines: DataFrame) -> DataFrame:
    """IO11: lower-case headers, and the HUC columns that the reach code gives."""
    low = lines.toDF(*(c.lower() for c in lines.columns))
    new = {f"huc{k:02d}": huc(F.col("reachcode"), k) for k in (2, 4, 6, 8, 10) if f"huc{k:02d}" not in low.columns}
    return low.withColumns(new) if new and "reachcode" in low.columns else low


def cleaned(lines: DataFrame) -> DataFrame:
    """main paths only, rivers only, no isolated lines; one conjunction that scans push down."""
    keep = F.col("divergence") <= 1
    if "fcode" in lines.columns:
        keep &= ~F.col("fcode").isin(*NOT_RIVERS)
    if {"streamorde", "streamcalc"} <= set(lines.columns):
        keep &= F.col("streamorde") == F.col("streamcalc")
    if {"startflag", "terminalfl"} <= set(lines.columns):
        keep &= ~((F.col("startflag") == 1) & (F.col("terminalfl") == 1))
    return lines.where(keep)


def downstream(lines: DataFrame, inside: Sequence[str] = ()) -> DataFrame:
    """Comid and down, the least comid that starts where the line ends.

    A line ends its path where the next one differs in a column of ``inside``, such as a
    unit's code or terminalpa.
    """
    at = lines.groupBy(F.col("fromnode").alias("tonode"), *inside).agg(F.min("comid").alias("down"))
    return lines.join(at, ["tonode", *inside], "left").select("comid", F.when(F.col("down") != F.col("comid"), F.col("down")).alias("down"))


def headwaters(lines: DataFrame, most: int | None = None) -> DataFrame:
    """The lines where rivers start, with their rank by dnhydroseq, largest first; the first ``most`` of them."""
    found = ranked(lines.where("startflag = 1"), [F.col("dnhydroseq").desc(), F.col("comid").asc()])
    return found if most is None else found.where(F.col("rank") <= most)


def outlets(lines: DataFrame, inside: Sequence[str]) -> DataFrame:
    """Of each group of ``inside`` the line of largest drainage area, the least comid on a tie."""
    best = F.max_by("comid", F.struct("totdasqkm", -F.col("comid")))
    return lines.groupBy(*inside).agg(best.alias("comid"), F.max("totdasqkm").alias("totdasqkm"))


def tributaries(lines: DataFrame) -> DataFrame:
    """Comid and the number of lines that flow into it."""
    n = lines.groupBy(F.col("tonode").alias("fromnode")).agg(F.count(F.lit(1)).alias("n_tributaries"))
    return lines.join(n, "fromnode", "left").select("comid", F.coalesce("n_tributaries", F.lit(0)).alias("n_tributaries"))


def main_stems(lines: DataFrame, inside: Sequence[str] = ()) -> DataFrame:
    """Every line with the path it belongs to, paths ending at borders of ``inside``.

    At a confluence the tributary of highest order, then largest area, then least comid
    goes on; the others end there. A path is named by its last line (path_id);
    steps_to_end orders it, linking_comid is the line below its end.
    """
    down = written(downstream(lines, inside), "downstream")
    first = F.max_by("comid", F.struct("streamorde", "totdasqkm", -F.col("comid"))).alias("main")
    mains = lines.join(down.where("down is not null"), "comid").groupBy("down").agg(first)
    nodes = down.join(mains, "down", "left").select(F.col("comid").alias("node"), F.when(F.col("main") == F.col("comid"), F.col("down")).alias("parent"))
    found = roots(written(nodes, "main-stems"))
    links = down.select(F.col("comid").alias("root"), F.col("down").alias("linking_comid"))
    return found.join(links, "root").select(F.col("node").alias("comid"), F.col("root").alias("path_id"), F.col("depth").alias("steps_to_end"), "linking_comid")


def downstream_paths(lines: DataFrame, most: int | None = None, inside: Sequence[str] = ()) -> DataFrame:
    """Every line with the path of the first headwater that passes it, in the order of ``headwaters``.

    Each headwater follows the flow until it meets a path that an earlier one took. So a
    line's owner is the least rank among the headwaters above it; lines below none are
    left out. Columns as of ``main_stems``; path_id is the headwater's comid.
    """
    down = written(downstream(lines, inside), "downstream")
    heads = written(headwaters(lines, most).select("comid", "rank"), "headwaters")
    nodes = down.join(heads, "comid", "left").select(F.col("comid").alias("node"), F.col("down").alias("parent"), "rank")
    owner = descendants_extreme(nodes, F.col("rank"), least_only=True).where("low is not null").select(F.col("node").alias("comid"), F.col("low").alias("rank"))
    owner = written(owner.join(heads.withColumnRenamed("comid", "path_id"), "rank").select("comid", "path_id"), "owners")
    below = owner.select(F.col("comid").alias("down"), F.col("path_id").alias("next_path"))
    linked = written(owner.join(down, "comid").join(below, "down", "left"), "owned")
    depth = roots(linked.select(F.col("comid").alias("node"), F.when(F.col("next_path") == F.col("path_id"), F.col("down")).alias("parent")))
    ends = linked.where("next_path is null or next_path <> path_id").select("path_id", F.col("down").alias("linking_comid"))
    out = owner.join(depth.select(F.col("node").alias("comid"), F.col("depth").alias("steps_to_end")), "comid").join(ends, "path_id")
    return out.select("comid", "path_id", "steps_to_end", "linking_comid")


def mapped(lines: DataFrame, method: str = "upstream", **options) -> DataFrame:
    """The paths of a network by ``method``: upstream (main_stems) or downstream (downstream_paths)."""
    methods = {"upstream": main_stems, "downstream": downstream_paths}
    if method not in methods:
        raise ValueError(f"unknown method {method}; known are {', '.join(methods)}")
    return methods[method](lines, **options)


def reach(lines: DataFrame, coords: DataFrame, start_comid: int | None = None, comids: DataFrame | None = None, inside: Sequence[str] = ()) -> DataFrame:
    """The points of one reach: all lines below ``start_comid``, or the lines ``comids`` (comid, steps_to_end).

    Other paths may pass the same lines. The river is named by its first line.
    """
    if comids is None:
        if start_comid is None:
            raise ValueError("a reach needs start_comid or comids")
        down = downstream(lines, inside).select(F.col("comid").alias("node"), F.col("down").alias("parent"))
        start = lines.sparkSession.createDataFrame([(start_comid,)], "start long")
        comids = paths_from(down, start).select(F.col("node").alias("comid"), (-F.col("steps")).alias("steps_to_end"))
    first = comids.agg(F.max_by("comid", "steps_to_end").alias("path_id"))
    return assembled(comids.select("comid", "steps_to_end").crossJoin(F.broadcast(first)), lines, coords)  # first is one row


def ranked_paths(paths: DataFrame, cut: int = 0) -> DataFrame:
    """Paths of more than ``cut`` lines with their length and rank, longest first."""
    n = paths.groupBy("path_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max_by("comid", "steps_to_end").alias("comid_start"))
    return ranked(n.where(F.col("n_lines") > cut), [F.col("n_lines").desc(), F.col("path_id").asc()])


def extended(paths: DataFrame, lines: DataFrame, min_km: float, most: int = 10, inside: Sequence[str] = ()) -> DataFrame:
    """Reach of every path, lengthened by the lines below until it has ``min_km``.

    path_id, total_km, n_added, reached. Lines are added one by one, at most ``most``; a
    reach that is still too short then, that has no line below, or whose next line it has
    already, is not reached. The loop is a fixed number of joins with the table of lines.
    """
    own = paths.join(lines.select("comid", "lengthkm"), "comid")
    state = own.groupBy("path_id").agg(F.sum("lengthkm").alias("total_km"), F.max("linking_comid").alias("next"))
    none = F.array().cast(T.ArrayType(lines.schema["comid"].dataType))
    state = state.select("path_id", "total_km", "next", none.alias("added"))
    step = lines.select("comid", "lengthkm").join(downstream(lines, inside), "comid").join(paths.select("comid", F.col("path_id").alias("of")), "comid", "left")
    step = written(step.select(F.col("comid").alias("next"), "lengthkm", F.col("down").alias("after"), "of"), "path-steps")
    for _ in range(most):
        new = F.col("lengthkm").isNotNull() & ~F.array_contains("added", F.col("next")) & ~F.col("of").eqNullSafe(F.col("path_id"))
        go = (F.col("total_km") < min_km) & F.coalesce(new, F.lit(False))
        state = state.join(step, "next", "left").select(
            "path_id", F.when(go, F.col("total_km") + F.col("lengthkm")).otherwise(F.col("total_km")).alias("total_km"),
            F.when(go, F.col("after")).otherwise(F.col("next")).alias("next"), F.when(go, F.array_append("added", F.col("next"))).otherwise(F.col("added")).alias("added"),
        )
    return state.select("path_id", "total_km", F.size("added").cast("long").alias("n_added"), (F.col("total_km") >= min_km).alias("reached"))


def prepared(lines: DataFrame, coords: DataFrame, tables: Sequence[DataFrame] = (), waterbodies: DataFrame | None = None, cell: float = 1e4) -> DataFrame:
    """IO9: flow lines with units, geometry, the columns of further ``tables``, waterbody flag; cleaned.

    ``waterbodies`` has poly_id, ring and, if there are any, holes; ``coords`` may come in parts.
    """
    out = located(with_units(lines), coords)
    for table in tables:
        out = with_new_columns(out, table)
    flag = F.lit(0).cast("long")
    if waterbodies is not None:
        inside = shapes.lines_within(shapes.one_line(coords) if "parts" in coords.columns else coords, waterbodies, cell).select("comid").distinct().withColumn("_w", F.lit(1))
        out, flag = out.join(inside, "comid", "left"), F.coalesce("_w", F.lit(0)).cast("long")
    return cleaned(out.withColumn("within_waterbody", flag).drop("_w", "pts"))


def river_coordinates(points: DataFrame) -> DataFrame:
    """IO19: the table of points of rivers as it is exported, in order."""
    return points.select("river_id", "idx", "x", "y", "s").orderBy("river_id", "idx")


def located(lines: DataFrame, coords: DataFrame) -> DataFrame:
    """Start, middle and end of each line, its length and sinuosity.

    ``coords`` has comid and pts, an array of (x, y), or parts, an array of such arrays
    (see ``shapes.one_line``). Lines without coordinates keep null.
    """
    # joined lines may seem as small as their keys: they are sorted, never broadcast
    j = lines.join(shapes.one_line(coords).hint("merge") if "parts" in coords.columns else coords, "comid", "left")
    at = lambda i: F.element_at("pts", i)
    mid = at((F.size("pts") / 2).cast("int") + 1)
    pairs = F.zip_with(F.slice("pts", F.lit(1), F.size("pts") - 1), F.slice("pts", F.lit(2), F.size("pts")), lambda a, b: step_length(b["x"] - a["x"], b["y"] - a["y"]))
    j = j.withColumn("length_m", F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v))
    j = j.withColumns({"xup_m": at(1)["x"], "yup_m": at(1)["y"], "xm_m": mid["x"], "ym_m": mid["y"], "xdown_m": at(-1)["x"], "ydown_m": at(-1)["y"]})
    return j.withColumn("sinuosity", F.try_divide("length_m", step_length(F.col("xdown_m") - F.col("xup_m"), F.col("ydown_m") - F.col("yup_m"))))


def with_new_columns(lines: DataFrame, other: DataFrame) -> DataFrame:
    """Left join on comid that adds only the columns ``lines`` does not have."""
    return lines.join(other.select("comid", *(c for c in other.columns if c not in lines.columns)), "comid", "left")


def assembled(paths: DataFrame, lines: DataFrame, coords: DataFrame) -> DataFrame:
    """M1: the ordered points of every path with distance, drainage area and width."""
    order = Window.partitionBy("river_id").orderBy(F.col("steps_to_end").desc(), "k")
    pts = paths.select(F.col("path_id").alias("river_id"), "comid", "steps_to_end").join(coords, "comid")
    pts = pts.select("river_id", "comid", "steps_to_end", F.posexplode("pts").alias("k", "p"))
    pts = pts.select("river_id", "comid", (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    pts = distances(distinct_x(pts))
    down = Window.partitionBy("river_id").orderBy(F.col("steps_to_end").desc())
    own = paths.select(F.col("path_id").alias("river_id"), "comid", "steps_to_end").join(lines, "comid")
    first = F.row_number().over(down) == 1
    start = initial_drainage_area(F.col("startflag") == 1, F.col("hwnodesqkm"), F.col("areasqkm"), F.col("totdasqkm"))
    ends = own.select("river_id", (F.row_number().over(down)).cast("long").alias("idx"), (F.sum("lengthkm").over(down) * 1000).alias("s"), F.col("totdasqkm").alias("da"))
    heads = own.withColumn("_f", first).where("_f").select("river_id", F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("s"), start.alias("da"))
    knots = heads.unionByName(ends)
    area = interpolated(knots, pts.select("river_id", "s", F.col("idx").alias("k")), "da")
    out = pts.join(area.select("river_id", F.col("k").alias("idx"), F.col("da").alias("da_sqkm")), ["river_id", "idx"])
    return out.withColumn("w_m", channel_width(F.col("da_sqkm"))).withColumn("z", F.lit(None).cast("double"))


def exploded_coords(coords: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row a point; the lines in ``labels`` (comid) are left out."""
    kept = coords if labels is None else coords.join(labels.select("comid").distinct(), "comid", "left_anti")
    return kept.select("comid", F.posexplode("pts").alias("idx", "p")).select("comid", "idx", "p.x", "p.y")


def within(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points (with x, y) and the id of each polygon (poly_id, ring) they lie in.

    Both sides are dealt to square cells of side ``cell``, so the join has an equi key;
    the even-odd rule decides. Points on an edge belong to the polygon on one side of it.
    A cell about as large as a polygon serves best: each polygon takes its box's cells.
    """
    lo = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    hi = lambda c: F.array_max(F.transform("ring", lambda p: p[c]))
    cells = lambda c: F.sequence(F.floor(lo(c) / cell), F.floor(hi(c) / cell))
    poly = polygons.select("poly_id", "ring", F.explode(cells("x")).alias("_i"), cells("y").alias("_j")).select("poly_id", "ring", "_i", F.explode("_j").alias("_j"))
    at = points.withColumns({"_i": F.floor(F.col("x") / cell), "_j": F.floor(F.col("y") / cell)})
    edges = F.zip_with("ring", F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e):
        a, b = e["a"], e["b"]
        side = F.try_divide((b["x"] - a["x"]) * (F.col("y") - a["y"]), b["y"] - a["y"]) + a["x"]
        return ((a["y"] > F.col("y")) != (b["y"] > F.col("y"))) & (F.col("x") < side)

    j = at.join(poly, ["_i", "_j"])
    return j.where(F.size(F.filter(edges, crosses)) % 2 == 1).select(*points.columns, "poly_id")
