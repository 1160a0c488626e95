"""Matching two tables of bends.

Implements: N10, N11, N13, N14, T4, U1-U4, U6, W12.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions.scalar import step_length
from thalweg.sources.scratch import dropped, written


def overlaps(manual: Column, automatic: Column) -> tuple[Column, Column]:
    """Shares of the automatic and of the manual points that both have."""
    both = F.size(F.array_intersect(manual, automatic))
    return F.try_divide(both, F.size(automatic)), F.try_divide(both, F.size(manual))


def zone(f_oa: Column, f_om: Column, least: float = 0.8) -> Column:
    """1 both reach ``least``, 2 the automatic only, 3 the manual only, 4 none."""
    return F.when((f_oa >= least) & (f_om >= least), 1).when(f_oa >= least, 2).when(f_om >= least, 3).otherwise(4).cast("long")


def _numbered(found: Column) -> Column:
    """Struct (rank, d, id_2) of each entry of an ordered array of (d, id)."""
    return F.transform(found, lambda x, i: F.struct((i + 1).alias("rank"), x["d"].alias("d"), x["id"].alias("id_2")))


#: Rows of ``one`` that a batch of distances takes at most.
_CHUNK = 2000


def _nearest_in_arrays(q: DataFrame, t: DataFrame, link: str, k: int) -> DataFrame:
    """``nearest`` for groups whose rows of ``two`` fit an array: distances of chunks by groups, in numpy."""
    chunks = q.withColumn("_c", F.pmod(F.xxhash64("id_1"), F.greatest(F.lit(1), F.ceil(F.col("n_1") / _CHUNK)))).groupBy(link, "_c").agg(F.collect_list(F.struct("id_1", "x_1", "y_1")).alias("q"))
    groups = t.groupBy(link).agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("t"))
    # few bytes and much work: dealt to as many tasks as the session has, in another order of keys than above,
    # for that partitioning would be taken over and its small partitions put together
    spread = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = chunks.join(groups, link).repartition(spread, "_c", link).select(link, *(F.col(f"q.{c}").alias(c) for c in ("id_1", "x_1", "y_1")), *(F.col(f"t.{c}").alias(c) for c in ("id", "x", "y")))
    kind = lambda frame, c: frame.schema[c].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                id_1, x_1, y_1, id_2, x, y = (batch.column(c)[i].values for c in range(1, 7))
                dx = x_1.to_numpy(zero_copy_only=False)[:, None] - x.to_numpy(zero_copy_only=False)[None, :]
                dy = y_1.to_numpy(zero_copy_only=False)[:, None] - y.to_numpy(zero_copy_only=False)[None, :]
                d, every = np.sqrt(dx * dx + dy * dy), np.arange(len(id_1))
                for rank in range(1, min(k, len(id_2)) + 1):
                    at = d.argmin(axis=1)  # the first of equal ones, so the least id
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(id_1), batch.schema.field(0).type), id_1, pa.array(np.full(len(id_1), rank, np.int32)), pa.array(d[every, at]), id_2.take(pa.array(at))],
                        names=[link, "id_1", "rank", "d", "id_2"],
                    )
                    d[every, at] = np.inf

    return both.mapInArrow(each, f"{link} {kind(q, link)}, id_1 {kind(q, 'id_1')}, rank int, d double, id_2 {kind(t, 'id')}")


def nearest(one: DataFrame, two: DataFrame, link: str, k: int = 1, most: int = 2000, any_large: bool | None = None) -> DataFrame:
    """Link, id_1, rank, d, id_2: for every row of ``one`` the ``k`` (1 or 2) nearest rows of its group in ``two``.

    Both have link, id (unique in its group), x and y; of equal distances the lesser id comes
    first. A group of at most ``most`` rows of ``two`` is one array, which chunks of ``one``
    meet. Larger groups are dealt to square cells so small that even the fullest holds some 64
    rows of ``two``, however unevenly they lie. A row of ``one`` meets the cells around its own,
    is settled when its k-th nearest is less than a cell away (or it has met all), and else
    tries again with cells of twice the side.
    """
    finite = (F.abs("x") < math.inf) & (F.abs("y") < math.inf)  # no row for other places, and none to them
    q = one.where(finite).select(link, F.col("id").alias("id_1"), F.col("x").alias("x_1"), F.col("y").alias("y_1"))
    t = two.where(finite).select(link, "id", "x", "y")
    sizes = t.groupBy(link).agg(F.count(F.lit(1)).alias("n"))
    if any_large is None:
        any_large = sizes.where(F.col("n") > most).limit(1).count() > 0
    short = t if not any_large else t.join(sizes.where(F.col("n") <= most).select(link), link)
    counted = q.join(q.groupBy(link).agg(F.count(F.lit(1)).alias("n_1")), link)
    out = _nearest_in_arrays(counted, short, link, k)
    return out.unionByName(_nearest_in_cells(q, t.join(sizes.where(F.col("n") > most), link), link, k)) if any_large else out


#: Halvings of the first cell that are tried for groups that lie unevenly, and rows that the fullest cell may hold.
_FINEST, _FULL = 24, 64


def _nearest_in_cells(q: DataFrame, t: DataFrame, link: str, k: int) -> DataFrame:
    """``nearest`` for large groups; ``t`` also has n, the size of its group."""
    t = written(t, "targets")
    box = t.groupBy(link).agg(F.first("n").alias("n"), F.min("x").alias("x_0"), F.min("y").alias("y_0"), F.max("x").alias("x_9"), F.max("y").alias("y_9"))
    side = F.greatest(F.col("x_9") - F.col("x_0"), F.col("y_9") - F.col("y_0")) / F.sqrt("n")
    box = written(box.select(link, "n", "x_0", "y_0", F.when(side > 0, side).otherwise(1.0).alias("side")), "boxes")
    place = lambda c, cell: F.floor((F.col(c) - F.col(f"{c[0]}_0")) / cell)
    # how full the fullest cell is at each halving; many equal places share a cell at any
    halved = F.col("side") / F.pow(F.lit(2.0), F.col("h"))
    levels = t.drop("n").join(box, link).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(_FINEST))))
    full = levels.groupBy(link, "h", place("x", halved).alias("i"), place("y", halved).alias("j")).agg(F.count(F.lit(1)).alias("m"))
    full = full.groupBy(link, "h").agg(F.max("m").alias("m")).groupBy(link).agg(F.min(F.when(F.col("m") <= _FULL, F.col("h"))).alias("fits"), F.min_by("h", F.struct("m", "h")).alias("best"))
    box = written(box.join(full, link).withColumn("side", F.col("side") / F.pow(F.lit(2.0), F.coalesce("fits", "best"))).drop("fits", "best"), "boxes")
    t = written(t.drop("n").join(box, link), "targets")
    open_, out, level = written(q.join(box, link), "open"), None, 0
    while True:
        cell = F.col("side") * float(1 << level)
        around = lambda c, cell=cell: F.explode(F.sequence(place(c, cell) - 1, place(c, cell) + 1))
        asked = open_.select("*", F.lit(1).alias("_")).withColumn("i", around("x_1")).withColumn("j", around("y_1"))
        near = t.select(link, "id", "x", "y", place("x", cell).alias("i"), place("y", cell).alias("j"))
        d = step_length(F.col("x_1") - F.col("x"), F.col("y_1") - F.col("y"))
        met = asked.join(near, [link, "i", "j"]).select(link, "id_1", F.struct(d.alias("d"), "id").alias("p"), "n", cell.alias("cell"))
        best = met.groupBy(link, "id_1").agg(F.min("p").alias("p1"), F.count(F.lit(1)).alias("seen"), F.first("n").alias("n"), F.first("cell").alias("cell"))
        if k == 2:
            first = best.select(link, "id_1", F.col("p1").alias("least"))
            second = met.join(first, [link, "id_1"]).where("p <> least").groupBy(link, "id_1").agg(F.min("p").alias("p2"))
            best = best.join(second, [link, "id_1"], "left")
        last = F.col(f"p{k}.d")
        best = written(best.withColumn("settled", (F.col("seen") == F.col("n")) | F.coalesce(last < F.col("cell"), F.lit(False))), "nearest")
        ranked = F.filter(F.array(*(F.col(f"p{m + 1}") for m in range(k))), lambda x: x.isNotNull())
        done = best.where("settled").select(link, "id_1", F.explode(_numbered(ranked)).alias("f")).select(link, "id_1", "f.*")
        out = done if out is None else out.unionByName(done)
        last_open, open_ = open_, written(open_.join(best.where("settled").select(link, "id_1"), [link, "id_1"], "left_anti"), "open")
        dropped(last_open)
        level += 1
        if not open_.limit(1).count():
            dropped(open_)
            return out


def nearest_point(points: DataFrame, queries: DataFrame, most: int = 2000) -> DataFrame:
    """river_id, qid, idx, distance: for every row of ``queries`` (river_id, qid, x, y) the nearest point of its river, the first on a tie."""
    q, t = queries.select("river_id", F.col("qid").alias("id"), "x", "y"), points.select("river_id", F.col("idx").alias("id"), "x", "y")
    return nearest(q, t, "river_id", 1, most).select("river_id", F.col("id_1").alias("qid"), F.col("id_2").alias("idx"), F.col("d").alias("distance"))


def two_nearest(one: DataFrame, two: DataFrame, link: str, most: int = 2000) -> DataFrame:
    """T4: link, id_1, id_2, rank (1, 2): for every row of ``one`` the two nearest rows of its group in ``two``."""
    return nearest(one, two, link, 2, most).select(link, "id_1", "id_2", "rank")


def closest(manual: DataFrame, automatic: DataFrame, link: str, least: float = 0.8, most: int = 2000) -> DataFrame:
    """For every manual bend the automatic one that shares most points, with its zone.

    Candidates lie in the same ``link`` group: the two nearest by start and the two
    nearest by end. Both tables have bend_id, x_start, y_start, x_end, y_end and the
    point arrays x and y; columns come back with _1 and _2. A candidate counts if it
    shares as many distinct x as y; without one, the nearest start is taken. Point
    arrays are met by candidates alone.
    """
    manual, automatic = written(manual, "bends"), written(automatic, "bends")  # each is read several times
    place = lambda frame, e: frame.select(link, F.col("bend_id").alias("id"), F.col(f"x_{e}").alias("x"), F.col(f"y_{e}").alias("y"))
    large = automatic.groupBy(link).count().where(F.col("count") > most).limit(1).count() > 0
    by = {e: nearest(place(manual, e), place(automatic, e), link, 2, most, large).select(link, "id_1", "id_2", "rank") for e in ("start", "end")}
    both = by["start"].select("*", F.lit("s").alias("e")).unionAll(by["end"].select("*", F.lit("e").alias("e")))
    near = both.groupBy(link, "id_1", "id_2").agg(F.min(F.when(F.col("e") == "s", F.col("rank"))).alias("_s"), F.min(F.when(F.col("e") == "e", F.col("rank"))).alias("_e"))
    near = near.withColumnsRenamed({"id_1": "bend_id_1", "id_2": "bend_id_2"})
    one = manual.select(F.col(link), *(F.col(c).alias(f"{c}_1") for c in manual.columns if c != link))
    two = automatic.select(F.col(link), *(F.col(c).alias(f"{c}_2") for c in automatic.columns if c != link))
    near = near.join(one, [link, "bend_id_1"]).join(two, [link, "bend_id_2"])
    x_both, y_both = F.size(F.array_intersect("x_1", "x_2")), F.size(F.array_intersect("y_1", "y_2"))
    near = near.withColumn("_n", F.when(x_both == y_both, x_both).otherwise(0))
    best = Window.partitionBy(link, "bend_id_1").orderBy(F.col("_n").desc(), F.coalesce(F.col("_s"), F.col("_e") + 2))
    top = near.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    f_oa, f_om = overlaps(F.col("x_1"), F.col("x_2"))
    top = top.withColumns({"f_oa": f_oa, "f_om": f_om}).withColumn("Zone", zone(F.col("f_oa"), F.col("f_om"), least))
    return top.drop("_s", "_e", "_n", "_b")


def compiled(tables: list[DataFrame]) -> DataFrame:
    """Bend tables below each other; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` replaces the rows of ``old`` with its keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def removed(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``table`` without the keys of ``gone``."""
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def matched_rivers(bends: DataFrame, rivers: DataFrame) -> DataFrame:
    """Bends with the river of their start_comid, else of their uid; of several rivers the least."""
    by_comid = rivers.groupBy("start_comid").agg(F.min("river_id").alias("_r1"))
    by_uid = rivers.groupBy("uid").agg(F.min("river_id").alias("_r2"))
    j = bends.join(by_comid, "start_comid", "left").join(by_uid, "uid", "left")
    return j.withColumn("river_id", F.coalesce("_r1", "_r2")).drop("_r1", "_r2")
