"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source gets a budget of words. Its documents are taken whole for as many complete
epochs as fit; the rest of the budget goes to a weighted sample without replacement:
each document draws an exponential key scaled by its quality weight, and documents are
taken in key order while the running sum of words stays within the rest.

The draw of a document comes from a digest of its id and the seed, so reruns agree.
Running sums never need a source in one task: rows are range-sorted by source and key, so
Spark's sampled quantiles cut them into slices of about equally many rows, whatever the
weights are; slices have totals, and rows are ordered only inside their slice.

Defined cases: a null text has no word, and texts of any length count whole; a null or
unknown source is a source of its own, last in order; documents without words are never
taken; repeated rows draw equal keys and stand next to each other; ties of the key go by
doc_id, then size; an empty table gives an empty mix; other columns, whatever their
names, are ignored, or carried through by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.common import free_name, in_slices, materialise, ranges_for


def _text_counts(text: pa.Array) -> pa.Array:
    """Words (runs of anything but ASCII blanks) and symbols of whole texts."""
    words, symbols = [], []
    for value in text.cast(pa.large_binary()):
        raw = value.as_py() or b""
        words.append(len(raw.split()))
        symbols.append(len(raw) - len(raw.translate(None, b"#*$%&|<>")))
    return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(symbols, pa.int64())], ["words", "symbols"])


text_counts = F.arrow_udf(in_slices(_text_counts), T.StructType([T.StructField("words", T.LongType()), T.StructField("symbols", T.LongType())]))


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Word budget of each source from (source, source_size).

    Weights repeat over the sources in order of their names. All words are shared by
    weight; no source gets more than ``most`` times its size, and what is above is
    shared among the rest by weight until none is above. In order of size by weight the
    sources that stop come first, so running sums give the fixed point directly. One
    row per source is ordered here.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(every) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)
    big = "decimal(30,0)"
    s = sizes.select("source", "source_size", weight.cast(big).alias("w"), (F.col("source_size") * most).cast(big).alias("cap"))
    order = Window.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    # cap and weight of the sources up to here, the total, and the weight from here on
    s = s.select(
        "*",
        (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).cast(big).alias("capped"),
        (F.sum("w").over(whole) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w")).cast(big).alias("open_w"),
        F.sum("source_size").over(whole).cast(big).alias("all_size"),
    )
    level = (F.col("all_size") - F.col("capped")).cast("double") / F.col("open_w").cast("double")
    s = s.withColumn("stays", (F.col("cap").cast("double") / F.col("w").cast("double")) >= level)
    # the first that stays below its stop fixes the level of all after it
    at = F.min_by(F.struct("capped", "open_w", "all_size"), F.struct("capped", -F.col("open_w"))).over(whole)
    first = F.min(F.when(F.col("stays"), F.struct((F.col("cap").cast("double") / F.col("w").cast("double")).alias("r"), F.struct("capped", "open_w", "all_size").alias("v")))).over(whole)
    share = F.coalesce(first["v"], at)
    even = (F.col("w") * 1).cast("double") * (share["all_size"] - share["capped"]).cast("double") / share["open_w"].cast("double")
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), even).alias("target"))


def uniform(row_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def plan(rows: DataFrame, seed: int = 7, weights: Sequence[int] = (1, 2, 3), most: int = 3, cut: bool = True) -> DataFrame:
    """Words that the mix takes of each of ``rows`` (doc_id, source, size, quality).

    Adds source_size, target and taken. With ``cut`` the document on the budget's edge is
    taken in part, else it is taken whole if at least half of it fits. ``rows`` should be
    a written table: it is read several times.
    """
    u = uniform(F.col("doc_id"), seed)
    keyed = rows.withColumn("key", -F.log(u) / F.col("quality")).withColumn("tie", F.monotonically_increasing_id())
    keyed = keyed.repartitionByRange(ranges_for(rows, 4 << 20), "source", "key", "doc_id", "size", "tie").withColumn("slice", F.spark_partition_id())
    keyed = materialise(keyed.drop("tie"), "mixing-slices")
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    sizes = slices.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    ordered = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.select("source", "slice", (F.sum("n").over(ordered) - F.col("n")).alias("slice_start"))
    known = slices.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select(
        F.col("s.source").alias("src"), F.col("s.slice").alias("slc"), "slice_start", "source_size", "target"
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("running", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("src")) & (F.col("slice") == F.col("slc")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")).cast("long") - whole * F.col("source_size")
    room = rest - (F.col("slice_start") + F.col("running"))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", room)) if cut else F.when((room > 0) & (room * 2 >= F.col("size")), F.col("size")).otherwise(0)
    return placed.withColumn("taken", whole * F.col("size") + part).drop("src", "slc", "key", "slice", "running", "slice_start")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and quality weight of documents, written once.

    The weight falls with the share of symbols: 1 / (1 + symbols per word).
    """
    counted = docs.select("doc_id", "source", text_counts("text").alias("c"))
    size = F.col("c.words")
    quality = F.lit(1.0) / (1 + F.col("c.symbols").cast("double") / F.greatest(size, F.lit(1)))
    return materialise(counted.select("doc_id", "source", size.alias("size"), quality.alias("quality")), "mixing-sizes")


def mix(docs: DataFrame, seed: int = 7, cut: bool = True) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents; also source and quality."""
    return plan(measure(docs), seed, cut=cut)


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it whole."""
    digest = free_name(docs, "row_digest")
    times = free_name(docs, "copies")
    own = docs.withColumn(digest, F.xxhash64("doc_id", "source"))
    taken = mix(docs, seed, cut=False).where("taken > 0")
    counts = taken.groupBy("doc_id", "source").agg(F.max(F.expr("taken div size")).cast("int").alias(times))
    counts = counts.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), times)
    found = own.join(counts, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")))
    return found.select(*docs.columns, F.explode(F.expr(f"sequence(1, {times})")).alias(digest)).drop(digest)
