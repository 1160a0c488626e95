"""Forests of bends as adjacency tables: tree_id, node_id, from_node_id and attributes.

Implements: F3, F4, F6-F9, F14, N12, T6, X14, R13, A20.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions.scalar import step_length
from thalweg.operators import graph
from thalweg.operators.ranking import ranked_within
from thalweg.sources.scratch import written


def matching(forest: DataFrame, key: str, value: object) -> DataFrame:
    """nodes with an attribute's value."""
    return forest.where(F.col(key) == value)


def with_parent(forest: DataFrame, columns: list[str]) -> DataFrame:
    """Each node with its parent's ``columns`` as parent_*."""
    parent = forest.select(F.col("tree_id"), F.col("node_id").alias("from_node_id"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return forest.join(parent, ["tree_id", "from_node_id"], "left")


def parent_direction(forest: DataFrame) -> DataFrame:
    """0 at a root; -1 where the middle is nearer to the parent's centre than the own centre is; else 1.

    Needs x_2, y_2 (middle) and x_c, y_c (centre).
    """
    j = with_parent(forest, ["x_c", "y_c"])
    middle = step_length(F.col("x_2") - F.col("parent_x_c"), F.col("y_2") - F.col("parent_y_c"))
    centre = step_length(F.col("x_c") - F.col("parent_x_c"), F.col("y_c") - F.col("parent_y_c"))
    side = F.when(F.col("parent_x_c").isNull(), 0).when(middle < centre, -1).otherwise(1)
    return j.withColumn("direction", side.cast("long")).drop("parent_x_c", "parent_y_c")


def node_kinds(forest: DataFrame) -> DataFrame:
    """root_node, parent_node, leaf_node flags; leaves are the first bends."""
    has_child = forest.select(F.col("tree_id"), F.col("from_node_id").alias("node_id")).distinct().withColumn("_c", F.lit(1))
    known = forest.select("tree_id", F.col("node_id").alias("from_node_id")).withColumn("_p", F.lit(1))
    j = forest.join(has_child, ["tree_id", "node_id"], "left").join(known, ["tree_id", "from_node_id"], "left")
    j = j.withColumns({"root_node": F.col("_p").isNull().cast("long"), "leaf_node": F.col("_c").isNull().cast("long")})
    j = j.withColumn("parent_node", ((F.col("root_node") == 0) & (F.col("leaf_node") == 0)).cast("long"))
    return j.withColumn("is_meander", F.col("leaf_node")).drop("_c", "_p")


def pruned_by_sinuosity(forest: DataFrame, column: str, least: float = 1.1) -> DataFrame:
    """bends below ``least`` are none."""
    return forest.withColumn("is_meander", F.when(F.col(column) < least, 0).otherwise(F.col("is_meander")).cast("long"))


def pruned_by_width(forest: DataFrame, gamma: float = 10.0, most_radius: float = 1e6) -> DataFrame:
    """bends shorter than gamma widths hand over to a parent of bounded radius.

    All bends are judged at once, so the order of nodes does not matter; roots have no
    parent and hand over to none.
    """
    short = (F.col("is_meander") == 1) & (F.col("wavelength_c") < gamma * F.col("w_m"))
    given = with_parent(forest, ["radius"]).where(short & (F.col("parent_radius") < most_radius)).select("tree_id", F.col("from_node_id").alias("node_id")).distinct()
    out = forest.join(given.withColumn("_g", F.lit(1)), ["tree_id", "node_id"], "left")
    value = F.when(F.col("_g") == 1, 1).when(short, 0).otherwise(F.col("is_meander"))
    return out.withColumn("is_meander", value.cast("long")).drop("_g")


def pruned_by_power(forest: DataFrame, most_radius: Column) -> DataFrame:
    """F8: a parent whose children are all bends replaces them where it is stronger.

    A parent that is no root takes over when its power is above the mean power of the
    children that point to it and its radius is below ``most_radius``. Those children
    stop being bends; the others stop if they are weaker.
    """
    children = forest.groupBy("tree_id", F.col("from_node_id").alias("node_id")).agg(
        F.avg(F.when(F.col("direction") == 1, F.col("peak_pwr"))).alias("_mean"), F.min("leaf_node").alias("_all_leaves")
    )
    p = forest.join(children, ["tree_id", "node_id"])
    wins = (F.col("_all_leaves") == 1) & (F.col("is_meander") == 0) & (F.col("root_node") == 0) & (F.col("peak_pwr") > F.col("_mean")) & (F.col("radius") < most_radius)
    winners = p.where(wins).select("tree_id", "node_id", F.col("peak_pwr").alias("_pwr"))
    out = forest.join(winners.select("tree_id", "node_id", F.lit(1).alias("_won")), ["tree_id", "node_id"], "left")
    out = out.join(winners.select("tree_id", F.col("node_id").alias("from_node_id"), F.col("_pwr")), ["tree_id", "from_node_id"], "left")
    loses = F.col("_pwr").isNotNull() & ((F.col("direction") == 1) | (F.col("peak_pwr") < F.col("_pwr")))
    value = F.when(F.col("_won") == 1, 1).when(loses, 0).otherwise(F.col("is_meander"))
    return out.withColumn("is_meander", value.cast("long")).drop("_won", "_pwr")


def without_peaks(forest: DataFrame, gone: DataFrame) -> DataFrame:
    """Peak columns emptied for the listed (tree_id, node_id)."""
    j = forest.join(gone.select("tree_id", "node_id").distinct().withColumn("_g", F.lit(1)), ["tree_id", "node_id"], "left")
    peaks = [c for c in ("peak_pwr", "peak_row", "peak_col") if c in forest.columns]
    return j.withColumns({c: F.when(F.col("_g").isNull(), F.col(c)) for c in peaks}).drop("_g")


def renumbered(forest: DataFrame) -> DataFrame:
    """Bends of each tree numbered from 0 in order of s_c."""
    out = ranked_within(forest, ["tree_id", "is_meander"], [F.col("s_c").asc(), F.col("node_id").asc()], "meander_id")
    return out.withColumn("meander_id", F.when(F.col("is_meander") == 1, F.col("meander_id")))


def pruned(forest: DataFrame, method: str, **options) -> DataFrame:
    """the forest pruned by ``method``: sinuosity, width or peak_power, with that one's options."""
    methods = {"sinuosity": pruned_by_sinuosity, "width": pruned_by_width, "peak_power": pruned_by_power}
    if method not in methods:
        raise ValueError(f"unknown method {method}; known are {', '.join(methods)}")
    return methods[method](forest, **options)


def selected(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """one table of a data set, meander or tree_scales."""
    if name not in tables:
        raise ValueError(f"unknown table {name}; known are {', '.join(tables)}")
    return tables[name]


def by_power(forest: DataFrame) -> DataFrame:
    """Nodes of each tree with their rank by peak power, unknown power first, then the largest."""
    order = [F.isnan("peak_pwr").desc(), F.col("peak_pwr").desc_nulls_first(), F.col("node_id").asc()]
    return ranked_within(forest, ["tree_id"], order, "power_rank").withColumn("power_rank", F.col("power_rank") + 1)


def from_branches(branches: DataFrame) -> DataFrame:
    """The forest that branches make: river_id, tree_id, node_id, from_node_id, node, kinds, is_meander, meander_id.

    ``branches`` has river_id, branch_id, level (0 at the root, then one by one), node and
    meander_level. Branches of a river that start at one node are one tree; a node that
    several share is taken from the first of them, in order of branch_id, and hangs on the
    node one level up there. Trees are numbered by their first branch, nodes as they are met.
    The node that ends its branch is a leaf; the one at the branch's meander_level is a bend.
    """
    # Spark may take branches for as small as what they were made from, and written columns for as small as their files
    b = branches.select("river_id", "branch_id", "level", "node", "meander_level").hint("merge")
    by = ["river_id", "branch_id"]
    ends = b.groupBy(*by).agg(F.min_by("node", "level").alias("root"), F.max("level").alias("last"))
    trees = ranked_within(ends.groupBy("river_id", "root").agg(F.min("branch_id").alias("first_branch")), ["river_id"], [F.col("first_branch").asc()], "tree_id")
    above = b.select(*by, (F.col("level") + 1).alias("level"), F.col("node").alias("from_node"))
    rows = b.join(ends, by).join(above, [*by, "level"], "left")
    met = F.min_by(F.struct("branch_id", "level", "from_node", "last", "meander_level"), F.struct("branch_id", "level"))
    rows = rows.groupBy("river_id", "root", "node").agg(met.alias("f")).select("river_id", "root", "node", "f.*")
    rows = rows.join(trees.select("river_id", "root", "tree_id"), ["river_id", "root"])
    rows = written(ranked_within(rows, ["river_id", "tree_id"], [F.col("branch_id").asc(), F.col("level").asc()], "node_id"), "forest").hint("merge")
    parents = rows.select("river_id", "tree_id", F.col("node").alias("from_node"), F.col("node_id").alias("from_node_id"))
    rows = rows.join(parents, ["river_id", "tree_id", "from_node"], "left")
    root, leaf = F.col("node_id") == 0, F.col("level") == F.col("last")
    kinds = {"root_node": root, "leaf_node": ~root & leaf, "parent_node": ~root & ~leaf, "is_meander": F.col("level") == F.col("meander_level")}
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)).cast("long") for k, v in kinds.items()})
    bends = ranked_within(rows.where("is_meander = 1").select("river_id", "tree_id", "node_id"), ["river_id", "tree_id"], [F.col("node_id").asc()], "meander_id")
    out = rows.join(bends, ["river_id", "tree_id", "node_id"], "left").withColumn("meander_id", F.coalesce("meander_id", F.lit(-1)))
    return out.select("river_id", "tree_id", "node_id", "from_node_id", "node", "level", *kinds, "meander_id")


def linked(forest: DataFrame, links: DataFrame) -> DataFrame:
    """Trees hung on nodes of other trees: tree_id, node_id, from_node_id, depth, kinds, old_tree_id, old_node_id.

    ``links`` (tree_id, to_tree_id, to_node_id) names the node on which a tree's root is hung.
    A tree gets the number of the one it ends in; inside it the nodes of each former tree,
    in order of their numbers, keep their order in a range of their own. Trees that hang on
    one another in a circle have no root and are left out.
    """
    name = lambda tree, node: F.struct(F.col(tree).alias("tree"), F.col(node).alias("node"))
    known = forest.select("tree_id", F.col("node_id").alias("from_node_id"), F.lit(True).alias("inner"))
    rows = forest.select("tree_id", "node_id", "from_node_id").join(known, ["tree_id", "from_node_id"], "left").join(links, "tree_id", "left")
    above = F.when(F.col("inner"), name("tree_id", "from_node_id")).when(F.col("to_tree_id").isNotNull(), name("to_tree_id", "to_node_id"))
    rows = written(rows.select(name("tree_id", "node_id").alias("node"), above.alias("parent")), "linked")
    ends = graph.roots(rows)
    sizes = rows.groupBy(F.col("node.tree").alias("tree")).agg((F.max("node.node") + 1).alias("size"))
    of = ends.select(F.col("node.tree").alias("tree"), F.col("root.tree").alias("tree_id")).distinct().join(sizes, "tree")
    # one row a tree
    before = F.sum("size").over(Window.partitionBy("tree_id").orderBy("tree").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    of = written(of.select("tree", "tree_id", before.alias("offset")), "linked-trees")
    up = of.select(F.col("tree").alias("up_tree"), F.col("offset").alias("up_offset"))
    out = rows.join(ends.select("node", "depth"), "node").withColumns({"tree": F.col("node.tree"), "up_tree": F.col("parent.tree")}).join(of, "tree").join(up, "up_tree", "left")
    out = out.select(
        "tree_id", (F.col("offset") + F.col("node.node")).alias("node_id"), (F.col("up_offset") + F.col("parent.node")).alias("from_node_id"), "depth",
        F.col("tree").alias("old_tree_id"), F.col("node.node").alias("old_node_id"),
    )
    return node_kinds(out)
