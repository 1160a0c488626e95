"""Reaches, paths, nearest points and scratch tables on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import compare, graph, network, tree
from thalweg.sources import scratch


def chain(spark, edges, km=1.0):
    """Flow lines 1..n, each with the line below it (0: none)."""
    rows = [(c, c, d, km, 1, float(c), int(c not in {x for _, x in edges}), c * 31 % 17) for c, d in edges]
    return spark.createDataFrame(rows, "comid long, fromnode long, tonode long, lengthkm double, streamorde long, totdasqkm double, startflag int, dnhydroseq long")


def test_reaches_grow_line_by_line(spark):
    # 1 > 2 > 3 > ... > 20; 21 joins at 2
    lines = chain(spark, [(k, k + 1) for k in range(1, 20)] + [(20, 0), (21, 2)])
    paths = spark.createDataFrame([(21, 21, 0, 2), (1, 1, 0, 2), (20, 20, 0, None)], "comid long, path_id long, steps_to_end long, linking_comid long")
    got = {r.path_id: (r.total_km, r.n_added, r.reached) for r in network.extended(paths, lines, 3.0).collect()}
    assert got == {21: (3.0, 2, True), 1: (3.0, 2, True), 20: (1.0, 0, False)}
    far = {r.path_id: (r.total_km, r.n_added, r.reached) for r in network.extended(paths, lines, 12.0).collect()}
    assert far[21] == (11.0, 10, False)  # ten lines at most


def test_reaches_on_cycles_are_refused(spark):
    lines = chain(spark, [(1, 2), (2, 3), (3, 4), (4, 2)])
    paths = spark.createDataFrame([(1, 1, 0, 2), (4, 9, 0, 2), (3, 9, 1, 2)], "comid long, path_id long, steps_to_end long, linking_comid long")
    got = {r.path_id: (r.total_km, r.n_added, r.reached) for r in network.extended(paths, lines, 9.0).collect()}
    assert got == {1: (4.0, 3, False), 9: (3.0, 1, False)}


def test_downstream_paths_take_what_is_free(spark):
    #  1 > 3 > 5, 2 > 3, 4 > 5: the first by dnhydroseq takes the trunk
    lines = chain(spark, [(1, 3), (2, 3), (3, 5), (4, 5), (5, 0)])
    order = [r.comid for r in network.headwaters(lines).orderBy("rank").collect()]
    assert order == sorted((1, 2, 4), key=lambda c: (-(c * 31 % 17), c)) and network.headwaters(lines, most=1).count() == 1
    paths = {r.comid: (r.path_id, r.steps_to_end, r.linking_comid) for r in network.mapped(lines, "downstream").collect()}
    down, free = {1: 3, 2: 3, 3: 5, 4: 5, 5: None}, {}
    for head in order:
        own, at = [], head
        while at and at not in free:
            own.append(at)
            free[at] = None
            at = down[at]
        for k, c in enumerate(own):
            free[c] = (head, len(own) - 1 - k, at)
    assert paths == free
    with pytest.raises(ValueError):
        network.mapped(lines, "sideways")


def test_borders_end_paths(spark):
    lines = chain(spark, [(1, 2), (2, 3), (3, 4), (4, 0)]).withColumn("huc", F.col("comid") > 2)
    assert {r.comid: r.path_id for r in network.main_stems(lines, ["huc"]).collect()} == {1: 2, 2: 2, 3: 4, 4: 4}


def test_paths_from_some_nodes_equal_walking(spark):
    rng = random.Random(1)
    up = {k: rng.randrange(k) if k else None for k in range(300)}
    nodes = spark.createDataFrame(list(up.items()), "node long, parent long")
    got = {}
    for r in graph.paths_from(nodes, spark.createDataFrame([(7,), (299,), (150,)], "start long")).collect():
        got.setdefault(r.start, {})[r.steps] = r.node
    for start, path in got.items():
        want, at = [], start
        while at is not None:
            want.append(at)
            at = up[at]
        assert [path[k] for k in range(len(path))] == want


def test_pre_order_equals_recursion(spark):
    rng = random.Random(2)
    up = {k: rng.randrange(k) if k > 2 else None for k in range(200)}
    out = []

    def visit(k, depth, root):
        out.append((k, up[k], root, depth, len(out) + 1))
        for c in sorted(c for c in up if up[c] == k):
            visit(c, depth + 1, root)

    for k in (0, 1, 2):
        visit(k, 0, k)
    got = graph.pre_order(spark.createDataFrame(list(up.items()), "node long, parent long")).collect()
    assert sorted(map(tuple, got)) == sorted(out)


def test_deep_chain_has_its_depth(spark):
    nodes = spark.range(3000).selectExpr("id node", "nullif(id, 0) - 1 parent")
    assert graph.roots(nodes).where("depth <> node or root <> 0").count() == 0


def test_paths_end_on_cycles(spark):
    """Three nodes in a circle with a tail into it, a node on itself, and a plain chain."""
    up = {1: 2, 2: 3, 3: 1, 10: 11, 11: 1, 20: 20, 30: 31, 31: 32, 32: None}
    nodes = spark.createDataFrame(list(up.items()), "node long, parent long")
    got = {(r.start, r.node): r.steps for r in graph.paths_from(nodes, spark.createDataFrame([(k,) for k in (1, 10, 20, 30, 99)], "start long")).collect()}
    want = {}
    for start in (1, 10, 20, 30, 99):
        at, steps = start, 0
        while at is not None and (start, at) not in want:
            want[start, at] = steps
            at, steps = up.get(at), steps + 1
    assert got == want


def test_pre_order_equals_recursion(spark):
    """Random trees, a star, a long chain, and nodes on a cycle, which have no place."""
    rng = random.Random(9)
    names = rng.sample(range(10_000), 260)
    parent = {n: (rng.choice(names[:k]) if k and rng.random() < 0.95 else None) for k, n in enumerate(names)}
    parent |= {20_000 + k: (20_000 if k else None) for k in range(300)} | {30_000 + k: (30_000 + k - 1 if k else None) for k in range(400)} | {50_000: 50_001, 50_001: 50_000}
    below = {}
    for n, p in parent.items():
        below.setdefault(p, []).append(n)
    want, stack = {}, sorted(below[None], reverse=True)
    depth = {n: 0 for n in stack}
    while stack:
        n = stack.pop()
        want[n] = (len(want) + 1, depth[n])
        for c in sorted(below.get(n, []), reverse=True):
            depth[c] = depth[n] + 1
            stack.append(c)
    got = graph.pre_order(spark.createDataFrame(list(parent.items()), "node long, parent long")).collect()
    assert {r.node: (r.place, r.depth) for r in got} == want and all(r.from_node == parent[r.node] for r in got)


@pytest.mark.parametrize("most", [0, 2000])
def test_two_nearest_equal_all_pairs(spark, most):
    rng = random.Random(3)
    far = lambda k: (5.0 * k, 5.0) if k % 2 else (rng.random() ** 4 * 100, rng.random() * 9)
    one = [(g, k, *far(k)) for g in (1, 2) for k in range(60)] + [(2, 99, 1e4, -1e4), (3, 1, 0.0, 0.0)]
    two = [(g, k, *far(k + 1)) for g in (1, 2) for k in range(80)] + [(1, 200 + k, 1.0, 1.0) for k in range(5)] + [(3, 5, 1.0, 1.0)]
    schema = "link long, id long, x double, y double"
    got = {}
    for r in compare.two_nearest(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), "link", most).collect():
        got.setdefault((r.link, r.id_1), {})[r["rank"]] = r.id_2
    for g, k, x, y in one:
        want = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, i) for h, i, a, b in two if h == g)[:2]
        assert [got[g, k][r] for r in sorted(got[g, k])] == [i for _, i in want]


@pytest.mark.parametrize("most", [0, 2000])
def test_nearest_points_of_uneven_places(spark, most):
    """Clusters inside clusters, a far outlier, many equal places, and places that are none."""
    rng = random.Random(5)
    points = [(1, k, rng.random() ** 6 * 1e5, rng.random() ** 6 * 1e3) for k in range(1500)] + [(1, 1500, 1e9, -1e9)] + [(1, 1600 + k, 7.0, 7.0) for k in range(150)] + [(1, 1900, None, 1.0), (2, 0, 1.0, 1.0)]
    queries = [(1, k, rng.random() ** 3 * 1e5, rng.random() * 1e3) for k in range(60)] + [(1, 60, 7.0, 7.0), (1, 61, 9e8, -9e8), (1, 62, float("nan"), 0.0), (2, 0, 5.0, 5.0), (3, 0, 0.0, 0.0)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"river_id long, {name} long, x double, y double")
    got = {(r.river_id, r.qid): r.idx for r in compare.nearest_point(frame(points, "idx"), frame(queries, "qid"), most).collect()}
    want = {}
    for g, q, x, y in queries:
        if x == x and g < 3:
            want[g, q] = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, i) for h, i, a, b in points if h == g and a is not None)[1]
    assert got == want


def test_choices_by_name(spark):
    forest = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 1.5, 1)], "tree_id long, node_id long, sn double, is_meander int")
    assert [r.is_meander for r in tree.pruned(forest, "sinuosity", column="sn", least=1.1).orderBy("node_id").collect()] == [0, 1]
    assert tree.selected({"meander": forest}, "meander") is forest
    for bad in (lambda: tree.pruned(forest, "none"), lambda: tree.selected({}, "meander")):
        with pytest.raises(ValueError):
            bad()


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        scratch.scratch_path(Session(), "x")


def test_pre_order_takes_rounds_by_depth(spark, monkeypatch):
    """A root with 300 children is done in a few written tables: rounds follow the depth, not the number of nodes."""
    tables, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda frame, name: (tables.append(name), write(frame, name))[1])
    star = spark.range(1, 302).selectExpr("id AS node", "CASE WHEN id > 1 THEN 1 END AS parent")
    got = graph.pre_order(star).collect()
    assert {(r.node, r.root, r.depth, r.place) for r in got} == {(n, 1, int(n > 1), n) for n in range(1, 302)}
    assert len(tables) <= 8
