"""Operators on small hand-made frames: closed forms, invariances, edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from thalweg.api import Rivers
from thalweg.functions import scalar
from thalweg.operators import compare, graph, metrics, ordered, spectral, synth
from thalweg.sources.files import FormatError, Store, layer, load, save
from thalweg.streaming import events


def frame(spark, x, y, river=1):
    return spark.createDataFrame([Row(river_id=river, idx=i, x=float(a), y=float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))])


def test_circle_has_its_curvature_and_radius(spark):
    t = np.linspace(0, math.pi, 400)
    p = ordered.curvature(ordered.distances(frame(spark, 5 * np.cos(t), 5 * np.sin(t))))
    c = [r.c for r in p.where("idx between 20 and 380").select("c").collect()]
    assert np.allclose(c, 0.2, atol=1e-3)
    fit = metrics.fitted_circle(p.withColumn("bend_id", F.lit(0))).first()
    assert abs(fit.radius - 5) < 1e-6 and abs(fit.cx) < 1e-6 and abs(fit.cy) < 1e-6


def test_straight_line(spark):
    p = ordered.curvature(ordered.distances(frame(spark, range(10), [2 * v for v in range(10)])))
    assert all(abs(r.c) < 1e-12 for r in p.collect())
    b = metrics.bends(p.withColumn("bend_id", F.lit(0))).first()
    assert abs(b.sigma_fm - 1) < 1e-12
    assert metrics.fitted_circle(p.withColumn("bend_id", F.lit(0))).first().radius is None


def test_mean_is_the_same_in_any_order_of_rows(spark):
    """In order 0.1, 0.2 and 0.3 have a mean above 0.2, the other way round one below."""
    p = frame(spark, range(3), [0.1, 0.2, 0.3])
    for rows in (p.coalesce(1).collect(), p.coalesce(1).collect()[::-1]):
        sides = metrics.side_runs(spark.createDataFrame(rows, p.schema).coalesce(1)).orderBy("idx").collect()
        assert [r.side for r in sides] == [False, False, True]


def test_kinoshita_matches_its_closed_form(spark):
    k = synth.zolezzi(spark, math.radians(115), 200.0, 0.0, 0.0, 5, 1500)
    p = ordered.curvature(k.withColumnRenamed("c", "c_true")).where("idx between 5 and 1490").collect()
    assert max(abs(r.c - r.c_true) for r in p) < 1e-2


def test_rigid_motion_changes_no_curvature(spark):
    rng = np.random.default_rng(1)
    x, y = np.arange(40.0), rng.standard_normal(40)
    a = 0.7
    one = ordered.curvature(ordered.distances(frame(spark, x, y))).orderBy("idx").collect()
    two = ordered.curvature(ordered.distances(frame(spark, x * math.cos(a) - y * math.sin(a) + 3, x * math.sin(a) + y * math.cos(a) - 9))).orderBy("idx").collect()
    assert np.allclose([r.c for r in one], [r.c for r in two], atol=1e-8)


def test_single_and_repeated_points(spark):
    p = ordered.curvature(ordered.distances(frame(spark, [1, 1, 1], [2, 2, 2]))).collect()
    assert all(r.c is None and r.s == 0 for r in p)
    assert ordered.distances(frame(spark, [1], [2])).first().s == 0


def test_partition_count_changes_nothing(spark):
    rng = np.random.default_rng(2)
    p = ordered.distances(frame(spark, np.arange(50), rng.standard_normal(50)))
    before = sorted(map(tuple, ordered.curvature(p).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    after = sorted(map(tuple, ordered.curvature(p).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert before == after


def test_roots_leave_cycles_out(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (8, 9), (9, 8), (7, 99)], "node long, parent long")
    got = {r.node: (r.root, r.depth) for r in graph.roots(n).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 7: (7, 0)}


def test_removed_nodes_hand_their_children_up(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4)], "node long, parent long")
    got = {r.node: r.parent for r in graph.without(n, F.col("node").isin(2, 3)).collect()}
    assert got == {1: None, 4: 1, 5: 4}


def test_extremes_below(spark):
    n = spark.createDataFrame([(1, None, 5.0), (2, 1, 9.0), (3, 2, 1.0), (4, 1, 7.0)], "node long, parent long, v double")
    got = {r.node: (r.low, r.high) for r in graph.descendants_extreme(n, F.col("v")).collect()}
    assert got == {1: (1.0, 9.0), 2: (1.0, 9.0), 3: (1.0, 1.0), 4: (7.0, 7.0)}


def test_bad_pointers_are_refused(spark):
    n = spark.createDataFrame([(1, 1)], "node long, parent long")
    with pytest.raises(Exception, match="bad parent pointer"):
        graph.checked(n).collect()


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scalar.channel_width(F.lit(None).cast("double")).alias("none"), scalar.channel_width(F.lit(-3)).alias("neg"),
        scalar.parse_vector(F.lit("[1. 2.\n 3.]")).alias("v"), scalar.middle_sign(F.array(F.lit(1.0), F.lit(-2.0), F.lit(3.0))).alias("m"),
        *(c.alias(n) for c, n in zip(scalar.line_intersection(*map(F.lit, (0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 2.0, 0.0))), "xy", strict=True)),
        scalar.hover_text(a=F.lit(1.234)).alias("h"),
    ).first()
    assert (row.none, row.neg, row.v, row.m, row.x, row.y, row.h) == (1.0, 1.0, [1.0, 2.0, 3.0], -1.0, 1.0, 1.0, "a: 1.23")


def test_zones(spark):
    z = [spark.range(1).select(compare.zone(F.lit(a), F.lit(b)).alias("z")).first().z for a, b in ((0.9, 0.9), (0.9, 0.1), (0.1, 0.9), (0.1, 0.1))]
    assert z == [1, 2, 3, 4]


def test_upsert_and_removal(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, compare.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert compare.removed(old, new, ["k"]).count() == 1


def test_inverse_gives_the_signal_back(spark):
    t = np.arange(512)
    y = np.sin(2 * math.pi * t / 64)
    s = spark.createDataFrame([(1, y.tolist())], "river_id int, signal array<double>")
    back = spectral.inverse(spectral.cwt(s, 1.0, 0.125), 1.0, 0.125).orderBy("n").collect()
    assert np.abs(np.array([r.y for r in back]) - y)[128:-128].max() < 0.1


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1.5), (2, 0, 2.5)], "river_id int, idx int, x double")
    for kind in ("parquet", "csv", "json", "orc"):
        path = f"{tmp_path}/t.{kind}"
        save(df, path)
        assert sorted(map(tuple, load(spark, path, df.columns).collect())) == [(1, 0, 1.5), (2, 0, 2.5)]
    with pytest.raises(FormatError):
        load(spark, "a.xyz")
    with pytest.raises(TypeError):
        load(spark, 3)
    with pytest.raises(KeyError):
        layer(spark, str(tmp_path), "none")


def test_store_reads_and_replaces_single_rivers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.createDataFrame([(1, 0, 1.5), (2, 0, 2.5)], "river_id int, s int, x double")
    store.write("points", df)
    assert store.read("points", [2]).first().x == 2.5
    store.upsert("points", spark.createDataFrame([(2, 0, 9.0)], "river_id int, s int, x double"))
    assert sorted(r.x for r in store.read("points").collect()) == [1.5, 9.0]


def test_facade(spark):
    t = np.arange(120.0)
    rivers = Rivers(frame(spark, t, 10 * np.sin(t / 6))).with_distances()
    assert rivers.curvature().meanders(1.0, 0.25).count() > 0
    assert rivers.resampled(2.0).source == "resample"
    with pytest.raises(ValueError):
        rivers.scale_tree(1.0)


def test_stream_keeps_running_lengths(spark, tmp_path):
    rows = "select 1L river_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) ts, cast(id as double) x, cast(id % 2 - 0.5 as double) y from range(6)"
    spark.sql(rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("river_id long, ts timestamp, x double, y double").parquet(f"{tmp_path}/in")
    q = events.running_lengths(stream).writeStream.format("memory").queryName("lengths").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    row = spark.sql("select * from lengths").collect()[-1]
    assert row.n_points == 6 and row.n_crossings == 5 and abs(row.length - 5 * math.sqrt(2)) < 1e-9


def test_points_within_polygons(spark):
    from thalweg.operators import network

    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]
    poly = spark.createDataFrame([(7, ring)], "poly_id int, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 6.0), (3, 1.0, 5.0), (4, 50.0, 1.0), (5, -1.0, 1.0)], "id int, x double, y double")
    for cell in (1.0, 4.0, 100.0):
        assert sorted((r.id, r.poly_id) for r in network.within(pts, poly, cell).collect()) == [(1, 7), (3, 7)]


def test_new_columns_and_labels(spark):
    from thalweg.operators import network

    a = spark.createDataFrame([(1, "x"), (2, "y")], "comid int, name string")
    b = spark.createDataFrame([(1, "other", 5)], "comid int, name string, slope int")
    assert sorted(map(tuple, network.with_new_columns(a, b).collect()), key=str) == [(1, "x", 5), (2, "y", None)]
    c = spark.createDataFrame([(1, [(0.0, 1.0)]), (2, [(2.0, 3.0), (4.0, 5.0)])], "comid int, pts array<struct<x:double,y:double>>")
    assert sorted(map(tuple, network.exploded_coords(c, a.where("comid = 1")).collect())) == [(2, 0, 2.0, 3.0), (2, 1, 4.0, 5.0)]


def test_nodes_are_placed_on_their_river(spark):
    from thalweg.operators import scale_tree

    t = np.arange(200.0)
    p = ordered.curvature(ordered.distances(frame(spark, t, 12 * np.sin(t / 8)))).withColumn("c", F.coalesce("c", F.lit(0.0)))
    tree = scale_tree.nodes(spectral.signals(p, "c"), 1.0, 0.25)
    placed = scale_tree.placed(tree, p).collect()
    assert placed and all(r.sn is None or r.sn >= 1 - 1e-9 for r in placed)
    assert {r.direction for r in placed} <= {-1, 0, 1} and any(r.direction for r in placed)
    spans = scale_tree.detected(tree).select("river_id", F.col("node").alias("bend_id"), F.col("bound_low").alias("idx_start"), F.col("bound_high").alias("idx_end"))
    bends = scale_tree.bend_database(spans, p).collect()
    assert bends and all(r.idx_end - r.idx_start + 1 == r.n_points for r in bends)
