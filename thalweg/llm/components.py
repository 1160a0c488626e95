"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import drop_table, materialise


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every child has one root and no root is a child."""
    twice = edges.groupBy("child").count().where("count > 1").select("child")
    deep = edges.select(F.col("root").alias("child")).distinct().join(edges.select("child"), "child", "left_semi")
    return twice.unionAll(deep).limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, ``root`` being the least node it reaches.

    ``edges`` has long columns ``a`` and ``b``; order, repeats and loops do not matter.
    Each round hangs every node's larger neighbours on its least one, then flattens;
    the number of rounds grows with the logarithm of the longest path. Minima are
    pre-aggregated per task, and the joins back are plain equi-joins whose skewed keys
    Spark splits. Rounds are written tables, so a lost executor repeats one at most.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("root"))
    now = materialise(pairs.distinct(), "components")
    while not _is_forest_of_stars(now):
        both = now.unionAll(now.select(F.col("root").alias("child"), F.col("child").alias("root")))
        least = both.groupBy("child").agg(F.least(F.min("root"), F.first("child")).alias("least"))
        # every neighbour above a node hangs on that node's least neighbour
        high = both.where("root > child").join(least, "child").select(F.col("root").alias("child"), F.col("least").alias("root"))
        high = materialise(high.where("child <> root").distinct(), "components")
        drop_table(now)
        # every neighbour below a node hangs on the least of them, and so does the node
        low = high.groupBy("child").agg(F.min("root").alias("least"))
        next_ = high.join(low, "child").select(F.col("root").alias("child"), F.col("least").alias("root"))
        next_ = next_.unionAll(low.select("child", F.col("least").alias("root")))
        now = materialise(next_.where("child <> root").distinct(), "components")
        drop_table(high)
    roots = now.select("root", F.col("root").alias("node")).distinct()
    return now.select(F.col("child").alias("node"), "root").unionAll(roots.select("node", "root"))
