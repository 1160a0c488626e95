"""Embedding near-duplicates by randomised-rotation binary codes.

Vectors are scaled to length one and turned by seeded random rotations. The packed signs
of the first rotation are a vector's code, stored with f, the inner product of the turned
vector with its code: the correction factor. The turned vector itself is stored in 16
levels a coordinate, with their step. <code(x), y> / f(x) is an unbiased estimate of
<x, y>, taken from x's code and y's levels. A pair whose cosine is at least t has an
estimate of at least t - sqrt(1 - t^2) e sqrt((1 - f^2) / f^2) / sqrt(D - 1), e being the
confidence in standard deviations, less what the levels round off; only pairs above that
bound are recomputed, in double precision.

Pairs are sought in tables keyed by (label, slice of the signs). The number of bits in a
slice follows the size of the largest label, and the number of tables follows from the
bits and the wanted recall at the threshold. Codes, factors and levels alone go through
the tables; the rows of which some pair is above the bound then meet again with their
whole vectors. A pair is counted by the first table in which both codes agree, so nothing
is counted twice and pairs are never written out. Equal vectors of a label stand for
each other and count as links by their number.

Defined cases: rows with a null label, and vectors that are null, zero or hold null or
non-finite components, link with nothing; a component of a row alone is its own id;
vectors of another dimension than their partner's link with nothing; rows with a null
vec_id have null components and are kept; repeated vec_ids are rows of their own that
share the id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.blocks import block_pairs, each_unit, forest
from thalweg.llm.common import materialise
from thalweg.llm.components import components


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random rotations of ``dim`` dimensions, stacked: (count * dim, dim)."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables of ``bits`` signs that a pair at the threshold needs to meet with that recall."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


@functools.lru_cache(maxsize=8)
def _turn(dim: int, count: int, seed: int) -> np.ndarray:
    """The rotations of this worker, made once."""
    return rotations(dim, count, seed)


def _coded(bits: int, tables: int, seed: int):
    """Column function: signs, factor, step and levels of a unit vector."""
    kind = T.StructType([T.StructField("signs", T.BinaryType()), T.StructField("f", T.FloatType()), T.StructField("step", T.FloatType()), T.StructField("levels", T.BinaryType())])

    @F.arrow_udf(kind)
    def coded(unit: pa.Array) -> pa.Array:
        signs, factors, steps, levels = [], [], [], []
        for value in unit:
            x = np.frombuffer(value.as_buffer(), "<f8")
            turned = _turn(len(x), max(1, -(-bits * tables // len(x))), seed) @ x
            signs.append(np.packbits(turned[: max(len(x), bits * tables)] > 0, bitorder="little").tobytes())
            own = turned[: len(x)]
            step = max(np.abs(own).max() / 7.5, 1e-30)
            grade = np.clip(np.floor(own / step) + 8, 0, 15).astype(np.uint8)  # the middle of a level is grade - 7.5 steps
            grade = np.append(grade, np.zeros(len(grade) % 2, np.uint8))
            factors.append(np.abs(own).sum() / math.sqrt(len(x)))
            steps.append(step)
            levels.append((grade[::2] | grade[1::2] << 4).tobytes())
        return pa.StructArray.from_arrays(
            [pa.array(signs, pa.binary()), pa.array(factors, pa.float32()), pa.array(steps, pa.float32()), pa.array(levels, pa.binary())], fields=[pa.field(f.name, t) for f, t in zip(kind.fields, (pa.binary(), pa.float32(), pa.float32(), pa.binary()), strict=True)]
        )

    return coded


def _slices(bits: int, tables: int):
    """Column function: the ``bits`` signs of each table as a number."""
    weights = (1 << np.arange(bits)).astype(np.int64)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def slices(signs: pa.Array) -> pa.Array:
        out = [np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), bitorder="little")[: bits * tables].reshape(tables, bits) @ weights for v in signs]
        return pa.array(out, pa.list_(pa.int64()))

    return slices


@F.arrow_udf(T.BinaryType())
def unit_vector(embedding: pa.Array) -> pa.Array:
    """The vector scaled to length one as little-endian doubles; null where it cannot link."""
    out = []
    for value in embedding.to_pylist():
        x = None
        if value and not any(v is None for v in value):
            x = np.array(value, float)
            top = np.abs(x).max() if np.isfinite(x).all() else 0.0
            # dividing by the largest first keeps very large and very small ones exact enough
            x = x / top / np.linalg.norm(x / top) if top > 0 else None
        out.append(None if x is None else x.astype("<f8").tobytes())
    return pa.array(out, pa.binary())


class _Unit:
    """The rows of one pair of blocks, and which of their pairs no earlier table has met."""

    def __init__(self, unit: pa.Table, bits: int):
        self.uids, block = unit.column("uid").to_numpy(), unit.column("block").to_numpy()
        one, other = unit.column("block_a")[0].as_py(), unit.column("block_b")[0].as_py()
        self.same, self.t, self.dim = one == other, unit.column("t")[0].as_py(), unit.column("dim")[0].as_py()
        self.left, self.right = np.flatnonzero(block == one), np.flatnonzero(block == other)
        packed = np.frombuffer(b"".join(unit.column("signs").to_pylist()), np.uint8).reshape(len(unit), -1)
        self.signs = np.unpackbits(packed, axis=1, bitorder="little")
        self.tables = self.signs[:, : bits * self.t].reshape(len(unit), self.t, bits)

    def pairs(self, near) -> tuple[np.ndarray, np.ndarray]:
        """Fresh pairs among those that ``near`` (rows, columns -> truth) finds, block by block."""
        a_all, b_all = [self.left[:0]], [self.left[:0]]
        for low in range(0, len(self.left), 256):
            rows = self.left[low : low + 256]
            a, b = np.nonzero(near(rows, self.right))
            a, b = rows[a], self.right[b]
            if self.same:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 1 << 14):
                x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                fresh = ~(self.tables[x] == self.tables[y]).all(axis=2).any(axis=1)
                a_all.append(x[fresh])
                b_all.append(y[fresh])
        return np.concatenate(a_all), np.concatenate(b_all)


def _estimate(threshold: float, confidence: float, bits: int):
    """Rows of a unit that have a pair above the bound."""

    def work(unit: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = _Unit(unit, bits)
        f, step = unit.column("f").to_numpy().astype(np.float32), unit.column("step").to_numpy().astype(np.float32)
        packed = np.frombuffer(b"".join(unit.column("levels").to_pylist()), np.uint8).reshape(len(unit), -1)
        grade = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(unit), -1)[:, : u.dim]
        turned = (grade.astype(np.float32) - np.float32(7.5)) * step[:, None]
        code = (u.signs[:, : u.dim].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(u.dim))
        slack = confidence * math.sqrt(1 - threshold**2) / math.sqrt(max(1, u.dim - 1)) * np.sqrt(np.maximum(0, 1 - f * f)) / f + 1e-5
        # rounding errs evenly within a step a coordinate, and the squares of a code's entries sum to one
        rounded = step * np.float32(confidence / math.sqrt(12))
        near = lambda a, b: (code[a] @ turned[b].T + rounded[None, b]) / f[a, None] >= threshold - slack[a, None]
        some = np.unique(np.concatenate(u.pairs(near)))
        return u.uids[some], np.full(len(some), u.t), u.uids[some]

    return work


def _exact(threshold: float, bits: int):
    """Links of a unit, by the product of whole vectors."""

    def work(unit: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = _Unit(unit, bits)
        weight = unit.column("weight").to_numpy()
        x = np.frombuffer(b"".join(unit.column("unit").to_pylist()), "<f8").reshape(-1, u.dim)
        a, b = u.pairs(lambda rows, columns: x[rows] @ x[columns].T >= threshold - 1e-9)
        kept = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 4096]], x[b[k : k + 4096]]) >= threshold for k in range(0, len(a), 4096)] or [a[:0] > 0])
        a, b = a[kept], b[kept]
        links = np.bincount(a, weight[b], len(u.uids)) + np.bincount(b, weight[a], len(u.uids))
        some = links > 0
        return u.uids[some], links[some].astype(np.int64), forest(u.uids, a, b)[some]

    return work


def links(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, confidence: float = 6.0, per_block: int = 2048, seed: int = 9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    rows = materialise(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.monotonically_increasing_id().alias("row"),
        F.when(F.col("label").isNotNull(), unit_vector("embedding")).alias("unit"),
    ), "vectors")
    # equal vectors of a label are one class, named by its least row
    same = ["label", "unit"]
    classes = rows.where("unit is not null").groupBy(*same).agg(
        F.min("row").alias("uid"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")
    )
    classes = materialise(classes, "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = int(min(20, max(4, math.ceil(math.log2(largest / 16 + 1)))))
    tables = tables_for(threshold, bits, recall)
    coded = classes.select("label", "uid", (F.length("unit") / 8).cast("int").alias("dim"), _coded(bits, tables, seed)("unit").alias("c"))
    coded = materialise(coded.select("label", "uid", "dim", "c.*"), "vector-codes")
    group = ["label", "dim", "t", "slice"]
    dealt = coded.select("*", F.posexplode(_slices(bits, tables)("signs")).alias("t", "slice"))
    spread = block_pairs(dealt, group, "uid", per_block)
    near = each_unit(spread, group, ["uid", "signs", "f", "step", "levels"], _estimate(threshold, confidence, bits))
    # (uid, table) with a pair above the bound: these meet again, in the same slices
    near = materialise(near.select("uid", F.col("links").cast("int").alias("t")).distinct(), "vector-near")
    whole = coded.select("label", "uid", "dim", "signs").join(classes.select("uid", "unit", "weight"), "uid")
    again = near.join(whole, "uid").withColumn("slice", F.element_at(_slices(bits, tables)("signs"), F.col("t") + 1))
    spread = block_pairs(again, group, "uid", per_block)
    found = materialise(each_unit(spread, group, ["uid", "weight", "unit", "signs"], _exact(threshold, bits)), "vector-links")
    return summarise(rows, classes, same, found, "vec_id", F.col("unit").isNotNull())


def summarise(rows: DataFrame, classes: DataFrame, same: list[str], found: DataFrame, name: str, linkable, more: Sequence[str] = ()) -> DataFrame:
    """n_links, component_id and kept of every row, from the class links ``found``, and the columns ``more``.

    A component is named by the least id of its rows; a row counts its class's other rows
    as links.
    """
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    c = classes.join(counts, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    c = c.withColumn("root", F.coalesce("root", "uid"))
    c = materialise(c.select(*same, "root", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "class-roots")
    least = c.groupBy("root").agg(F.min("least").alias("component_id"))
    known = c.join(least, "root").select(*same, "root", "n_links", "component_id")
    out = rows.join(known, same, "left")
    component = F.when(linkable, F.col("component_id")).otherwise(F.col(name))
    return out.select(
        name,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(name) == component, F.lit(True)).alias("kept"),
        *more,
    )
