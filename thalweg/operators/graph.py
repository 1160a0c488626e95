"""Recursion over parent pointers by pointer doubling.

A frame has node and parent (null at a root). Every round joins the pointers that still
move with the pointers of their targets, so a path of length n takes log2(n) rounds; each
round is a written table of what moved, which keeps plans flat. Nodes whose root is found
are set aside and shuffle no more as followers, so the root's key never holds them. Nodes
on a cycle never reach a root and are left out.

Implements: R1, R2, R5 (minima), R9 (paths), R10, R14-R16, A19, A20, N12 (parents).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.operators.ranking import running
from thalweg.sources.scratch import dropped, written

#: Rounds after which what still moves is on a cycle: paths are shorter than 2^40.
MOST_ROUNDS = 40


def _pointers(nodes: DataFrame) -> DataFrame:
    """node, ptr (the parent, or the node itself at a root), hops to it, and whether it is known to be a root."""
    ids = nodes.select(F.col("node").alias("parent"))
    linked = nodes.select("node", "parent").join(ids.distinct().withColumn("known", F.lit(True)), "parent", "left")
    p = linked.select("node", F.when(F.col("known"), F.col("parent")).otherwise(F.col("node")).alias("ptr"))
    return p.withColumns({"hops": (F.col("ptr") != F.col("node")).cast("long"), "done": F.col("ptr") == F.col("node")})


def _followed(p: DataFrame, most: int) -> list[DataFrame]:
    """Pointers (node, ptr, hops, done) followed until they are done; ``hops`` adds up along the way.

    What never gets there within ``most`` doublings is on a cycle, or leads into one.
    """
    found, moving = [p.where("done")], p.where("not done")
    for _ in range(most):
        if not moving.limit(1).count():
            break
        now = reduce(DataFrame.unionAll, [*found, moving])
        q = now.select(F.col("node").alias("ptr"), F.col("ptr").alias("far"), F.col("hops").alias("more"), F.col("done").alias("ends"))
        step = moving.join(q, "ptr").select("node", F.col("far").alias("ptr"), (F.col("hops") + F.col("more")).alias("hops"), F.col("ends").alias("done"))
        step = written(step, "pointers")
        found, moving = [*found, step.where("done")], step.where("not done")
    return found


def roots(nodes: DataFrame) -> DataFrame:
    """Node, root (where following parents ends) and depth (steps to it)."""
    p = written(_pointers(nodes), "pointers")
    found = _followed(p, p.count().bit_length() + 1)
    return reduce(DataFrame.unionAll, found).select("node", F.col("ptr").alias("root"), F.col("hops").alias("depth"))


def paths_from(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Start, node, steps: each of the nodes ``starts`` (start) with all that its pointers pass, at its fewest steps.

    Round k adds what lies 2^k steps beyond what is reached. Paths may share nodes. A path
    that enters a cycle ends where it would meet a node again.
    """
    jump = written(nodes.where("parent is not null and parent <> node").select("node", F.col("parent").alias("ptr")), "jumps")
    reach = written(starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("steps")), "paths")
    for k in range(MOST_ROUNDS):
        new = reach.join(jump, "node").groupBy("start", F.col("ptr").alias("node")).agg((F.min("steps") + (1 << k)).alias("steps"))
        new = written(new.join(reach, ["start", "node"], "left_anti").select("start", "node", "steps"), "paths")
        if not new.limit(1).count():
            break
        reach = reach.unionAll(new)
        far = jump.select(F.col("node").alias("ptr"), F.col("ptr").alias("far"))
        jump, old = written(jump.join(far, "ptr").select("node", F.col("far").alias("ptr")), "jumps"), jump
        dropped(old)
    dropped(jump)
    return reach


def _sizes(nodes: DataFrame, hops: int) -> DataFrame:
    """node, size: how many nodes there are from a node on down, for nodes without cycles of at most ``hops`` depth.

    Round k adds to each node the sizes, as far as they reach 2^k steps, of the nodes just 2^k below it.
    """
    last, p = None, nodes.select("node", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("size"))
    for _ in range(hops.bit_length()):
        up = p.where("ptr is not null").groupBy(F.col("ptr").alias("node")).agg(F.sum("size").alias("more"))
        q = p.select(F.col("node").alias("ptr"), F.col("ptr").alias("far"))
        nxt = p.join(up, "node", "left").join(q, "ptr", "left").select("node", F.col("far").alias("ptr"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        p = written(nxt, "sizes")
        if last is not None:
            dropped(last)
        last = p
    return p.select("node", "size")


def pre_order(nodes: DataFrame) -> DataFrame:
    """Node, from_node, root, depth and place: trees one after the other by root, each parent before its children.

    Children come in order of their names. A node's place is its parent's, one, and the sizes of
    the siblings before it; these steps are added up along the way to the root by doubling, so
    rounds follow the depth of the trees. Sizes of siblings are added up over ranges of all nodes,
    so a node with very many children is no group of its own.
    """
    found = written(roots(nodes), "pre-order-roots")
    # nodes on cycles have no root
    linked = found.join(nodes.select("node", "parent"), "node").select("node", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"))
    linked = written(linked, "orders")
    most = found.agg(F.max("depth")).first()[0] or 0  # one number
    sized = linked.join(_sizes(linked, most), "node")
    order = [F.col("parent").asc_nulls_first(), F.col("node").asc()]
    before = running(sized, order, "size", "before")
    first = before.where("parent is not null").groupBy("parent").agg(F.min("before").alias("first"))
    step = before.join(first, "parent", "left").select("node", "parent", (F.col("before") - F.coalesce("first", F.lit(0)) + 1).alias("step"))
    p = step.select("node", F.coalesce("parent", "node").alias("ptr"), F.col("step").alias("hops"), F.col("parent").isNull().alias("done"))
    # a root adds its step once, at the end
    p = written(p, "orders")
    top = p.where("done").select(F.col("node").alias("root"), F.col("hops").alias("start"))
    walked = reduce(DataFrame.unionAll, _followed(p.withColumn("hops", F.when(F.col("done"), 0).otherwise(F.col("hops"))), most.bit_length() + 1))
    places = walked.join(top, walked["ptr"] == top["root"]).select("node", (F.col("hops") + F.col("start")).alias("place"))
    return places.join(found, "node").join(nodes.select("node", F.col("parent").alias("from_node")), "node").select("node", "from_node", "root", "depth", "place")


#: Trees of so few nodes are not worth a round for each of their levels.
_FEW = 100_000


def descendants_extreme(nodes: DataFrame, value: Column, high: Column | None = None, least_only: bool = False) -> DataFrame:
    """Node, low, high: least ``value`` and largest ``high`` (``value`` by default) over a node and all below it.

    While at least a quarter of the nodes are leaves they hand their extremes to their parents
    and are set aside, so each round has at most three quarters of the last one's rows. What
    is left goes by doubling: round k hands each node's extremes to its ancestor 2^k steps
    up. Minima and maxima may be handed over twice, so overlapping spans do no harm. With
    ``least_only`` there is no ``high``, and none is carried along.
    """
    kept = {"low": (F.min, F.least)} if least_only else {"low": (F.min, F.least), "high": (F.max, F.greatest)}
    values = {"low": value, "high": value if high is None else high}
    rows = nodes.select("node", "parent", *(values[c].alias(c) for c in kept), F.lit(False).alias("leaf"))
    found = []
    for _ in range(MOST_ROUNDS):
        leaf, empty = F.col("leaf"), rows.schema["parent"].dataType
        up = rows.where("parent is not null").select(
            F.col("parent").alias("node"), F.lit(None).cast(empty).alias("parent"), *(F.when(leaf, F.col(c)).alias(c) for c in kept),
            F.lit(False).alias("own"), (~leaf).alias("above"),
        )
        own = rows.where(~leaf).select("node", "parent", *kept, F.lit(True).alias("own"), F.lit(False).alias("above"))
        both = own.unionAll(up).groupBy("node").agg(F.max("parent").alias("parent"), *(f(c).alias(c) for c, (f, _) in kept.items()), F.max("own").alias("own"), F.max("above").alias("above"))
        rows = written(both.where("own").select("node", "parent", *kept, (~F.col("above")).alias("leaf")), "extremes")
        left, leaves = rows.agg(F.count(F.lit(1)), F.count_if("leaf")).first()  # two numbers
        found.append(rows.where("leaf").select("node", *kept))
        if left <= _FEW or leaves * 4 < left:
            break
    last, p = None, rows.select("node", F.col("parent").alias("ptr"), *kept, "leaf")
    for _ in range(MOST_ROUNDS):
        if not p.where("ptr is not null").limit(1).count():
            break
        up = p.where("ptr is not null").groupBy(F.col("ptr").alias("node")).agg(*(f(c).alias(f"{c}2") for c, (f, _) in kept.items()))
        q = p.where("not leaf").select(F.col("node").alias("ptr"), F.col("ptr").alias("far"))
        nxt = p.join(up, "node", "left").join(q, "ptr", "left").select(
            "node", F.col("far").alias("ptr"), *(g(c, f"{c}2").alias(c) for c, (_, g) in kept.items()), "leaf"
        )
        p = written(nxt, "extremes")
        if last is not None:
            dropped(last)
        last = p
    return reduce(DataFrame.unionAll, [*found, p.where("not leaf").select("node", *kept)])


def child_counts(nodes: DataFrame) -> DataFrame:
    """Node and its number of children."""
    n = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_child"))
    return nodes.select("node").join(n, "node", "left").select("node", F.coalesce("n_child", F.lit(0)).alias("n_child"))


def without(nodes: DataFrame, gone: Column) -> DataFrame:
    """Nodes that stay, each hung on its nearest ancestor that stays (null: none)."""
    kept = nodes.withColumn("gone", F.coalesce(gone, F.lit(False)))
    # a node that goes points on; one that stays ends the search
    jump = kept.select("node", F.when(F.col("gone"), F.col("parent")).alias("parent"))
    end = roots(jump)
    stays = kept.where("not gone").select(F.col("node").alias("root"))
    target = end.join(stays, "root", "left_semi").select(F.col("node").alias("parent"), F.col("root").alias("new_parent"))
    return kept.where("not gone").join(target, "parent", "left").select("node", F.col("new_parent").alias("parent"))


def edges(nodes: DataFrame) -> DataFrame:
    """The connectivity matrix as its ones, (node, parent)."""
    return nodes.where("parent is not null").select("node", "parent")


def checked(nodes: DataFrame) -> DataFrame:
    """Fails where a pointer is negative or points at its own node."""
    bad = (F.col("parent") < 0) | (F.col("parent") == F.col("node"))
    return nodes.withColumn("parent", F.when(bad, F.raise_error(F.lit("bad parent pointer"))).otherwise(F.col("parent")))
