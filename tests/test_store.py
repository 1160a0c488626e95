"""Data sets of many rivers: few files, reads that open few of them, writes seen whole or not at all."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thalweg.api import Network, Rivers
from thalweg.operators import tree
from thalweg.sources.files import Store, load


def test_many_rivers_in_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=64)
    many = spark.range(100_000).select((F.col("id") % 50_000).alias("river_id"), (F.col("id") / 50_000).cast("long").alias("idx"), (F.col("id") * 1.0).alias("s"))
    store.write("points", many)
    files = store.manifest("points")["files"]
    assert 1 <= len(files) <= 64 * 4 and sum(x["rows"] for x in files) == 100_000
    some = [5, 17, 49_999, 123, 4567, 999_999]
    read = store.read("points", some)
    assert len(read.inputFiles()) <= len(some) and sorted(r.river_id for r in read.collect()) == sorted(2 * some[:-1])
    assert store.read("points").count() == 100_000 and store.rivers().count() == 50_000
    assert store.read("points", []).count() == 0


def test_upserts_touch_their_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    rows = [(r, i, float(r * 10 + i)) for r in range(40) for i in range(3)] + [(None, 0, 1.0)]
    store.write("points", spark.createDataFrame(rows, "river_id long, idx long, s double"))
    before = {x["file"] for x in store.manifest("points")["files"]}
    held = store.read("points")  # a reader from before
    store.upsert("points", spark.createDataFrame([(7, 0, -1.0, "new"), (None, 0, -2.0, "null")], "river_id long, idx long, s double, note string"))
    after = {x["file"] for x in store.manifest("points")["files"]}
    assert held.count() == 121 and len(before - after) <= 2 and before & after
    got = store.read("points", [7, 8, None], ["s", "note", "missing"]).collect()
    assert sorted(((r.river_id, r.s, r.note, r.missing) for r in got), key=repr) == sorted([(7, -1.0, "new", None), *((8, 80.0 + i, None, None) for i in range(3)), (None, -2.0, "null", None)], key=repr)
    assert store.read("points").count() == 119
    gone = store.swept("points")
    assert gone == len(before - after) and store.read("points").count() == 119
    with pytest.raises(KeyError):
        store.read("trees")
    store.write("points", spark.createDataFrame([], "river_id long, s double"))
    assert store.read("points").count() == 0 and store.read("points", [1]).columns == ["river_id", "s"]
    words = Store(spark, str(tmp_path / "words"))
    words.write("points", spark.createDataFrame([("a b", 1.0), ("ü/x", 2.0), ("", 3.0)], "river_id string, s double"))
    assert {r.s for r in words.read("points", ["ü/x", ""]).collect()} == {2.0, 3.0}
    assert [r.river_id for r in words.longest_first().collect()] == ["", "ü/x", "a b"]


def test_networks_are_saved_and_loaded(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    rows = [(r, k, float(k), math.sin(k / (4 + r)), f"c{r}", f"u{r}") for r in (1, 2, 3) for k in range(60 + 20 * r)]
    points = spark.createDataFrame(rows, "river_id long, idx long, x double, y double, start_comid string, uid string")
    own = Rivers(points).with_distances().curvature()
    bends = spark.createDataFrame([(9, 0, "c1", None, 5, 20), (9, 1, None, "u2", 3, 30), (9, 2, "c9", "u9", 3, 30)], "river_id long, bend_id long, start_comid string, uid string, idx_start long, idx_end long")
    trees = own.scale_tree(1.0, 0.5)
    spectra = own.spectrum(1.0, 0.5)
    Network(own, own.points.limit(0), bends, trees, spectra).save(store)
    whole = Network.loaded(store, recalculate=False)
    assert [r.river_id for r in whole.order.orderBy("place").collect()] == [3, 2, 1]
    assert {(r.river_id, r.bend_id) for r in whole.bends.collect()} == {(1, 0), (2, 1)}
    assert whole.trees.count() == trees.count() and whole.spectra.count() == spectra.count()
    one = Network.loaded(store, [2], recalculate=True, resample=True)
    assert {r.river_id for r in one.rivers.points.select("river_id").distinct().collect()} == {2} and one.rivers.source == "resample"
    assert one.trees.select("river_id").distinct().count() == 1 and one.rivers.inflections().count() > 3
    fields = store.read("spectra", [1], ["j", "scale", "angle"])
    assert fields.columns == ["river_id", "j", "scale", "angle"] and fields.count() > 0


def test_feather_headers_come_alone(spark, tmp_path):
    table = pa.table({"river_id": [1, 2], "x": [0.5, None]})
    pa.feather.write_feather(table, f"{tmp_path}/a.feather") if hasattr(pa, "feather") else __import__("pyarrow.feather").feather.write_feather(table, f"{tmp_path}/a.feather")
    assert sorted(map(tuple, load(spark, f"{tmp_path}/a.feather").collect())) == [(1, 0.5), (2, None)]


def test_forests_from_branches(spark):
    b = [(1, 0, (10, 11, 12), 2), (1, 1, (10, 11, 13), 0), (1, 2, (20, 21), 1), (1, 5, (10,), 0), (2, 0, (10, 30), 1)]
    rows = [(r, n, level, node, m) for r, n, path, m in b for level, node in enumerate(path)]
    got = tree.from_branches(spark.createDataFrame(rows, "river_id long, branch_id long, level long, node long, meander_level long"))
    have = {(r.river_id, r.tree_id, r.node_id): (r.node, r.from_node_id, r.root_node, r.parent_node, r.leaf_node, r.is_meander, r.meander_id) for r in got.collect()}
    assert have == {
        (1, 0, 0): (10, None, 1, 0, 0, 0, -1), (1, 0, 1): (11, 0, 0, 1, 0, 0, -1), (1, 0, 2): (12, 1, 0, 0, 1, 1, 0), (1, 0, 3): (13, 1, 0, 0, 1, 0, -1),
        (1, 1, 0): (20, None, 1, 0, 0, 0, -1), (1, 1, 1): (21, 0, 0, 0, 1, 1, 0), (2, 0, 0): (10, None, 1, 0, 0, 0, -1), (2, 0, 1): (30, 0, 0, 0, 1, 1, 0),
    }
    forest = spark.createDataFrame([(0, 0, None), (0, 1, 0), (1, 0, None), (1, 1, 0), (2, 0, None), (3, 0, None), (4, 0, None)], "tree_id long, node_id long, from_node_id long")
    links = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 4, 0), (4, 3, 0)], "tree_id long, to_tree_id long, to_node_id long")
    out = {(r.old_tree_id, r.old_node_id): (r.tree_id, r.node_id, r.from_node_id, r.depth, r.leaf_node) for r in tree.linked(forest, links).collect()}
    assert out == {(0, 0): (0, 0, None, 0, 0), (0, 1): (0, 1, 0, 1, 0), (1, 0): (0, 2, 1, 2, 0), (1, 1): (0, 3, 2, 3, 0), (2, 0): (0, 4, 3, 4, 1)}
