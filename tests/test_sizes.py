"""What has to hold for tables of any size: nothing is broadcast that grows with the rows, and results depend on no order of addition."""

import pytest

from thalweg.plans import catalogue


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cwt_angle", "significance_mask"])
def test_no_transform_is_broadcast(spark, sf_dir, name):
    """Spark takes a transform for as small as its signals, so a join with it would send it all to the driver."""
    assert "BroadcastExchange" not in plan(catalogue.queries()[name](spark, sf_dir))


def test_masked_joins_given_tests_without_broadcast(spark):
    from thalweg.operators import spectral

    signal = spark.createDataFrame([(k, [float((k * i) % 7) for i in range(32)]) for k in range(1, 4)], "river_id long, signal array<double>")
    wave = spectral.cwt(signal, 1.0, 0.5)
    joined = spectral.masked(wave, spectral.significance(signal), spectral.variances(signal).select("river_id", "n_points"))
    assert "BroadcastExchange" not in plan(joined)
    own = spectral.masked(spectral.tested(signal, 1.0, 0.5))
    assert own.exceptAll(joined.select(own.columns)).count() == 0 and own.count() == joined.count()


def test_branches_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Long branches from few rows, and a forest whose files are smaller than its rows, are sorted, whatever their size seems."""
    from pyspark.sql import functions as F

    from thalweg.operators import tree

    plans, write = [], tree.written
    monkeypatch.setattr(tree, "written", lambda frame, name: (plans.append(plan(frame)), write(frame, name))[1])
    leaves = spark.range(8, 16).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3))))
    branches = leaves.select(F.lit(1).alias("river_id"), F.col("id").alias("branch_id"), F.col("level").cast("long").alias("level"), F.expr("shiftright(id, 3 - level)").alias("node"), F.lit(2).cast("long").alias("meander_level"))
    out = tree.from_branches(branches)
    assert out.count() == 15 and out.where("is_meander = 1").count() == 4
    kept = [p for p in plans if "branch_id" in p]
    sides = [line for p in [*kept, plan(out)] for line in p.splitlines() if "BroadcastHashJoin" in line and ("branch_id" in line or "from_node" in line)]
    assert kept and not sides


def test_rounding_is_that_of_sql(spark):
    """Doubles at halves of the last decimal: the SQL multiplies first."""
    import duckdb
    import numpy as np

    from thalweg.plans.geometry import rounded

    k = np.arange(1, 4_000_000, 397)
    values = [2648.2250325, -2648.2250325, 0.0000005, -1e-9, 123456789.1234565, *((k + 0.5) / 1e6 + 2648).tolist(), *(-(k * 7 + 0.5) / 1e6).tolist()]
    frame = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "i long, v double, w double")
    ours = rounded(rounded(frame, "v"), "w", digits=4).orderBy("i").toPandas()
    table = frame.toPandas()  # noqa: F841
    theirs = duckdb.sql("SELECT round(v, 6) + 0.0 AS v, round(w, 4) + 0.0 AS w FROM table ORDER BY i".replace("table", "\"table\"")).fetchdf()
    assert ours.v.tolist() == theirs.v.tolist() and ours.w.tolist() == theirs.w.tolist()


def test_batches_are_cut_by_their_values():
    """A batch of ten thousand rivers reaches Python in slices of bounded size, rows whole and in order; a long river alone."""
    import pyarrow as pa

    from thalweg.functions.batches import slices

    lists = [[float(k)] * n for k, n in enumerate([600] * 1000 + [120_000, 0, 3] + [1] * 10)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.float64()))], names=["river_id", "signal"])
    parts = list(slices([batch]))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert len(parts) > 12 and all(p.num_rows == 1 or sum(len(v or [0]) for v in p.column(1).to_pylist()) <= 50_000 for p in parts)
    assert not list(slices([batch.slice(0, 0)]))


def test_extremes_write_few_rows(spark, monkeypatch):
    """Leaves are set aside as soon as they are known, so all rounds together write few times the nodes; a chain goes by doubling."""
    import random

    from pyspark.sql import functions as F

    from thalweg.operators import graph

    rows, write = [0], graph.written

    def counted(frame, name):
        out = write(frame, name)
        rows[0] += out.count()
        return out

    monkeypatch.setattr(graph, "written", counted)
    monkeypatch.setattr(graph, "_FEW", 0, raising=False)
    rnd = random.Random(4)
    heap = [(k, k // 2 or None, rnd.randrange(1000)) for k in range(1, 512)]
    mixed = [(0, None, 5), *((k, rnd.choice([k - 1, rnd.randrange(k)]), rnd.choice([None, rnd.randrange(1000)])) for k in range(1, 150)), (200, 999, 3), (201, 200, 1)]
    chain = [(k, k - 1 if k else None, (k * 37) % 101) for k in range(40)]
    for made, most in ((heap, 3), (mixed, None), (chain, None)):
        low, high = {k: {v} - {None} for k, _, v in made}, {}
        up = {k: p for k, p, _ in made}
        for k, _, v in made:
            at = up[k]
            while at in low:
                if v is not None:
                    low[at].add(v)
                at = up[at]
        high = {k: (min(v), max(v) + 1) if v else (None, None) for k, v in low.items()}
        rows[0] = 0
        n = spark.createDataFrame(made, "node long, parent long, v long")
        got = graph.descendants_extreme(n, F.col("v"), F.col("v") + 1) if hasattr(graph, "_FEW") else graph.descendants_extreme(n, F.col("v"))
        assert {r.node: (r.low, r.high) for r in got.collect()} == high
        assert most is None or rows[0] <= most * len(made)


def test_placed_nodes_do_not_list_their_places(spark):
    """Nodes meet their river's points as arrays, in one join, and the tree is asked for once."""
    from thalweg.operators import scale_tree

    points = spark.createDataFrame([(1, i, float(i), float(i), float(i % 5), float(i % 7 - 3)) for i in range(64)], "river_id long, idx long, s double, x double, y double, c double")
    signal = spark.createDataFrame([(1, [float(i % 7 - 3) for i in range(64)])], "river_id long, signal array<double>")
    p = plan(scale_tree.placed(scale_tree.nodes(signal, 1.0, 0.25), points))
    assert "Generate" not in p and p.split("== Initial Plan ==")[0].count("MapInArrow") == 2


def test_refined_nodes_meet_their_points_once(spark, sf_dir):
    """Spans, inflections and leaves of a tree come from one meeting of points and nodes: no window, no list of places, no further join."""
    import numpy as np
    from pyspark.sql import functions as F

    from thalweg.operators import scale_tree, splines

    points = spark.createDataFrame([(r, i, float(i), float(i), float(i % 5), float(i * r % 7 - 3)) for r in (1, 2) for i in range(64)], "river_id long, idx long, s double, x double, y double, c double")
    rivers = scale_tree.gathered(points)
    tree = scale_tree.nodes(rivers.select("river_id", F.col("c").alias("signal")), 1.0, 0.25)
    frame = scale_tree.refined(tree, points)
    p = plan(frame).split("== Initial Plan ==")[0]
    assert p.count("SortMergeJoin") == 1 and "Window" not in p and "Generate" not in p
    want = sorted(map(tuple, frame.collect()))
    assert want and sorted(map(tuple, scale_tree.refined(tree, rivers).collect())) == want
    given = scale_tree.refined(tree, points, splines.fitted(points))
    assert given.columns == frame.columns and np.allclose(np.array(sorted(map(tuple, given.collect())), float), np.array(want, float), atol=1e-9, equal_nan=True)


def _shuffles(frame) -> int:
    return plan(frame).split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_transforms_shuffle_once(spark, sf_dir):
    """The long table of a transform meets its neighbours, and its spans, where one shuffle by river put it."""
    assert _shuffles(catalogue.queries()["saddle_extrema"](spark, sf_dir)) == 1
    frame = catalogue.queries()["leaf_spectrum"](spark, sf_dir)
    wave = [line for line in plan(frame).splitlines() if "Exchange hashpartitioning(river_id" in line]
    assert wave and "node_id#" not in "".join(line for line in wave if "(river_id" in line and ", j#" in line)


def test_long_transects_shuffle_once(spark, sf_dir):
    from thalweg.operators import ordered
    from thalweg.plans import standins as st

    assert _shuffles(ordered.curvature(ordered.distances(st.lineitems(spark, sf_dir)))) == 1


def test_splines_at_stations_sort_once(spark):
    """All derivatives come from one meeting of stations and pieces, and the table is read once."""
    from thalweg.operators import splines

    table = spark.createDataFrame([(1, d, float(i), i + 1.0, [1.0, 2.0, 3.0, 0.5]) for d in "xy" for i in range(3)], "river_id long, dim string, low double, high double, c array<double>")
    stations = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.5)], "river_id long, k long, s double")
    out = splines.at_stations(table, stations, derivatives=(0, 1, 2))
    p = plan(out).split("== Initial Plan ==")[0]
    assert p.count("Scan ExistingRDD[river_id") + p.count("LocalTableScan") <= 2
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0.5, 2.8125, 2.8125, 5.375, 5.375, 7.5, 7.5)]


@pytest.mark.parametrize("name", ["local_peaks", "interp_linear", "interp_previous", "nearest_station"])
def test_points_are_dealt_by_their_number(spark, sf_dir, monkeypatch, name):
    """Tasks become more as points do: Spark neither joins their partitions nor deals the points out anew."""
    import re

    from thalweg.plans import standins as st

    want = catalogue.queries()[name](spark, sf_dir)
    monkeypatch.setattr(st, "POINTS_A_TASK", 50)
    out = catalogue.queries()[name](spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/{'lineitem' if name == 'local_peaks' else 'events'}.parquet").count()
    dealt = re.findall(r"hashpartitioning\(river_id#\d+L?, (\d+)\)", plan(out).split("Initial Plan")[-1])
    assert dealt and set(dealt) == {str(-(-rows // 50))} and "Exchange rangepartitioning" not in plan(out)
    assert out.exceptAll(want).count() == 0 and out.count() == want.count()


def test_refined_inflections_read_their_transects_once(spark, sf_dir):
    """Curvature, bends and straight lines are needed several times: they are written, and nothing is computed anew from the events."""
    frame = catalogue.queries()["refined_inflections"](spark, sf_dir)
    assert not any("events.parquet" in file for file in frame.inputFiles()) and "MapInArrow" not in plan(frame)


def test_lines_of_parts_are_not_broadcast(spark, sf_dir):
    assert "BroadcastExchange" not in plan(catalogue.queries()["multipart_geometry"](spark, sf_dir))


def test_least_values_carry_no_largest_ones(spark):
    """Owners of paths ask for the least rank alone, so nothing else is shuffled and written for it."""
    from pyspark.sql import functions as F

    from thalweg.operators import graph

    nodes = spark.range(1, 3000).select(F.col("id").alias("node"), F.expr("case when id > 1 then id div 2 end").alias("parent"), (F.col("id") * 7919 % 3001).alias("v"))
    both, least = graph.descendants_extreme(nodes, F.col("v")), graph.descendants_extreme(nodes, F.col("v"), least_only=True)
    assert least.columns == ["node", "low"] and both.columns == ["node", "low", "high"]
    assert sorted(map(tuple, least.collect())) == sorted(map(tuple, both.select("node", "low").collect()))
