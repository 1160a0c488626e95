"""All-pairs work inside groups of any size, split into pairs of blocks.

A group's rows are dealt to blocks of a bounded number of rows; each pair of blocks is
one unit of work, so no task holds more than two blocks and a group of any size spreads
over many tasks. Units give per-row counts and the edges of a spanning forest, never
the pairs: what they return is in proportion to the rows they read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import give_back

RESULT = "uid long, links long, root long"


def block_pairs(rows: DataFrame, group: list[str], uid: str, per_block: int, size: Column | None = None, volume: int = 4_000_000) -> DataFrame:
    """``rows`` once for every pair of blocks it takes part in: adds block_a, block_b, block.

    Groups of one row are left out: they have no pair. A block has about ``per_block`` rows,
    and rows of ``volume`` together in ``size`` where that is given.
    """
    full = F.count(F.lit(1)) / per_block
    blocks = full if size is None else F.greatest(full, F.sum(size.cast("double")) / volume)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows"), F.ceil(blocks).cast("int").alias("blocks")).where("group_rows > 1")
    sized = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64(uid), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = sized.withColumn("other", other)
    return spread.select(
        *rows.columns, "block", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b")
    )


def each_unit(
    spread: DataFrame, group: list[str], columns: list[str], work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]
) -> DataFrame:
    """Run ``work`` on every pair of blocks; gives (uid, links, root) rows.

    ``work`` gets one unit as an Arrow table of ``columns`` and block, block_a, block_b,
    and returns uids, links counted in this unit, and the least uid each is joined with.
    Units come one after another from sorted batches, so a task holds one at a time.
    """
    key = [*group, "block_a", "block_b"]
    dealt = spread.select(*key, "block", *columns).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        done: list[tuple] = []

        def finish() -> None:
            unit = pa.Table.from_batches(held)
            if len(unit) > 1:
                done.append(work(unit))

        def flush() -> pa.RecordBatch:
            arrays = [np.concatenate([np.asarray(x[i], np.int64) for x in done]) for i in range(3)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["uid", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_pylist() for k in key]
            keys = list(zip(*keys, strict=True))
            low = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != (keys[i - 1] if i else last):
                    if i > low:
                        held.append(batch.slice(low, i - low))
                    if i < len(keys):
                        if held:
                            finish()
                        held, low = [], i
            last = keys[-1]
            if sum(len(x[0]) for x in done) > 20_000:
                yield flush()
        if held:
            finish()
        if done:
            yield flush()
        held = []
        give_back()

    return dealt.mapInArrow(run, RESULT)


def shared_counts(row: np.ndarray, item: np.ndarray, left: np.ndarray, right: np.ndarray, wide: int = 4096) -> np.ndarray:
    """Items that each of the rows ``left`` has in common with each of ``right``.

    (row, item) are distinct, ``item`` being any sortable code. Items of one row alone add
    nothing; the others go through the product ``wide`` at a time.
    """
    order = np.argsort(item, kind="stable")
    item, row = item[order], row[order]
    count = np.diff(np.append(np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])), len(item))) if len(item) else np.zeros(0, int)
    column, kept = np.repeat(np.cumsum(count > 1) - 1, count), np.repeat(count > 1, count)
    row, column = row[kept], column[kept]
    n = int(max(left.max(initial=-1), right.max(initial=-1), row.max(initial=-1))) + 1
    place = np.full((2, n), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [low, low + wide])
        sides = []
        for k, side in enumerate((left, right)):
            at, c = place[k, row[a:b]], column[a:b] - low
            m = np.zeros((len(side), int(c.max()) + 1), np.float32)
            m[at[at >= 0], c[at >= 0]] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    return common


def forest(uids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least uid reachable from each row over the links (a[i], b[i]) of row numbers."""
    order = np.argsort(uids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    root = np.arange(len(uids))
    x, y = rank[a], rank[b]
    while True:
        least = root.copy()
        np.minimum.at(least, x, root[y])
        np.minimum.at(least, y, root[x])
        np.minimum.at(least, root[x], root[y])
        np.minimum.at(least, root[y], root[x])
        least = least[least]
        if (least == root).all():
            return uids[order][root[rank]]
        root = least
