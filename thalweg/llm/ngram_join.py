"""N-gram Jaccard self-join of documents by a MinHash LSH forest.

A document's shingles are its runs of ``width`` words (all its words, where it has
fewer). Texts of equal words stand for one class. Each class has ``trees`` labels of
``depth`` minimum hashes; the labels of a tree, sorted, are the tree's prefix trie, in
which every subtree is a run of neighbours. Matched prefixes are shortened from the full
depth, level by level, until a pair at the threshold meets in some tree with the target
recall: at depth d that is 1 - (1 - t^d)^trees. As the threshold is one for all pairs, so
is this depth (7 of 8 at 0.8): here the forest comes to banding with a depth found from
the recall. Runs of that prefix link candidates; candidate components are then compared
all against all, exactly and in blocks, so pairs that no tree matched but whose component
did are found too.

Counts and a spanning forest leave the comparison, never the pairs, so a group of
near-copies costs rows in proportion to its size.

Defined cases: a null text, or one without words, has no shingles and links with
nothing; texts of any length are taken whole; null ids are rows of their own, and as
representatives come last; repeated rows are copies of each other; of several texts of
one doc_id that link, the one of least hash stays; an empty table gives an empty result;
other columns, whatever their names, are ignored, or carried by ``representatives``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.blocks import block_pairs, each_unit, forest, shared_counts
from thalweg.llm.common import drop_table, free_name, give_back, in_slices, materialise
from thalweg.llm.components import components
from thalweg.llm.embed_dedup import summarise

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash, kept for the life of a worker, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_WORDS = _Words()


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs of a text (UTF-8 bytes)."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    code = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        code = _scramble(code * _MIX + h[k : k + n])
    return np.unique(code)


def stop_depth(threshold: float, depth: int, trees: int, recall: float) -> int:
    """Prefix length at which a pair at the threshold is met with the target recall."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def signatures(docs: DataFrame, width: int, trees: int, depth: int, seed: int) -> DataFrame:
    """row, doc_id, hash of the text, digest of the words, number of shingles, labels (one binary per tree)."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, (trees * depth, 1), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    kind = T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("labels", T.ArrayType(T.BinaryType()))
    ])

    def sign(text: pa.Array) -> pa.Array:
        digests, sizes, labels = [], [], []
        for value in text.cast(pa.large_binary()):
            raw = value.as_py() or b""
            s = shingles(raw, width)
            sizes.append(len(s))
            if not len(s):
                digests.append(None)
                labels.append(None)
                continue
            digests.append(_digest(raw))
            least = np.full(trees * depth, np.iinfo(np.uint64).max, np.uint64)
            for low in range(0, len(s), 256):  # small blocks stay in the cache
                np.minimum(least, (odd * s[low : low + 256]).min(axis=1), out=least)
            top = (least >> np.uint64(32)).astype(">u4").reshape(trees, depth)
            labels.append([x.tobytes() for x in top])
        return pa.StructArray.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.list_(pa.binary()))], ["digest", "n", "labels"]
        )

    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"), F.arrow_udf(in_slices(sign), kind)("text").alias("s"))
    return signed.select("doc_id", "row", "h", "s.digest", "s.n", "s.labels")


def trie_links(classes: DataFrame, prefix: int) -> DataFrame:
    """(a, b): every class with the first of its run of equal prefixes, tree by tree.

    One range sort puts all tries in order; a run that crosses a border between ranges is
    carried on by the first and last rows of the ranges, two rows a tree and range.
    """
    labels = classes.select("uid", F.posexplode("labels").alias("tree", "label"))
    keyed = labels.select("uid", "tree", F.substring("label", 1, 4 * prefix).alias("prefix"))
    ordered = keyed.repartitionByRange("tree", "prefix", "uid").sortWithinPartitions("tree", "prefix", "uid")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside the range, and its border runs as (prefix key, head)."""
        head, key, first = 0, b"", True

        def border(key: bytes, head: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([head], pa.int64()), pa.array([head], pa.int64()), pa.array([key], pa.binary())], names=["a", "b", "border"])

        for batch in batches:
            if not batch.num_rows:
                continue
            uid = batch.column(0).to_numpy()
            tree = batch.column(1).to_numpy().astype(">u2").view(np.uint8).reshape(len(uid), 2)
            keys = np.concatenate([tree, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(uid), -1)], axis=1)
            new = np.append(keys[0].tobytes() != key, (keys[1:] != keys[:-1]).any(axis=1))
            start = np.maximum.accumulate(np.where(new, np.arange(len(uid)), -1))
            heads = np.where(start >= 0, uid[start], head)
            if first:
                first = False
                yield border(keys[0].tobytes(), int(uid[0]))
            out = ~new
            yield pa.RecordBatch.from_arrays([pa.array(uid[out]), pa.array(heads[out]), pa.nulls(int(out.sum()), pa.binary())], names=["a", "b", "border"])
            head, key = int(heads[-1]), keys[-1].tobytes()
        if not first:
            yield border(key, head)
        give_back()

    found = materialise(ordered.mapInArrow(runs, "a long, b long, border binary"), "trie-links")
    borders = found.where("border is not null").groupBy("border").agg(F.min("a").alias("b"), F.max("a").alias("a"))
    ends = found.where("border is not null").join(borders.select("border", F.col("b").alias("least")), "border")
    return found.where("border is null").select("a", "b").unionAll(ends.select("a", F.col("least").alias("b"))).where("a <> b")


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest()


def _digest_and_shingles(width: int):
    kind = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def packed(text: pa.Array) -> pa.Array:
        raws = [v.as_py() or b"" for v in text.cast(pa.large_binary())]
        sets = [shingles(raw, width).astype("<u8").tobytes() for raw in raws]
        return pa.StructArray.from_arrays([pa.array(map(_digest, raws), pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    return F.arrow_udf(in_slices(packed), kind)


def _compare(threshold: float):
    def work(unit: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        uids, weight = unit.column("uid").to_numpy(), unit.column("weight").to_numpy()
        block = unit.column("block").to_numpy()
        one, other = unit.column("block_a")[0].as_py(), unit.column("block_b")[0].as_py()
        sets = [np.frombuffer(v.as_buffer(), "<u8") for v in unit.column("shingles")]
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == other)
        common = shared_counts(row, np.concatenate(sets), left, right)
        union = size[left][:, None] + size[right][None, :] - common
        a, b = np.nonzero(common >= threshold * union - 1e-6)
        a, b = left[a], right[b]
        if one == other:
            a, b = a[a < b], b[a < b]
        links = np.bincount(a, weight[b], len(uids)) + np.bincount(b, weight[a], len(uids))
        root = forest(uids, a, b)
        some = links > 0
        return uids[some], links[some].astype(np.int64), root[some]

    return work


def links(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_links, component_id, kept of every row of (doc_id, text); options as for ``linked``."""
    return linked(docs, **options).select("doc_id", "n_links", "component_id", "kept")


def linked(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 24, depth: int = 8, recall: float = 0.995, per_block: int = 1024, seed: int = 8) -> DataFrame:
    """As ``links``, with the text's hash h and root, which names the row's component (null: it can have no link)."""
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = materialise(signatures(picked, width, trees, depth, seed), "signatures")
    some = rows.where("digest is not null").groupBy("digest")
    classes = some.agg(F.min("row").alias("uid"), F.min("labels").alias("labels"))
    near = components(trie_links(classes.select("uid", "labels"), stop_depth(threshold, depth, trees, recall)))
    near = materialise(near, "candidates")

    weighed = some.agg(F.min("row").alias("uid"), F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("place"))
    weighed = materialise(weighed, "classes")
    # the texts of candidates alone are read again, by the id and hash of one of their class's rows
    wanted = weighed.join(near.select(F.col("node").alias("uid"), F.col("root").alias("candidate")), "uid")
    texts = picked.join(wanted, picked["doc_id"].cast("long").eqNullSafe(F.col("place.doc_id")) & (F.xxhash64(picked["text"]) == F.col("place.h")))
    texts = texts.withColumn("s", _digest_and_shingles(width)("text")).where("s.digest = digest")
    sets = texts.groupBy("uid").agg(F.first("candidate").alias("candidate"), F.first("weight").alias("weight"), F.first("s.shingles").alias("shingles"))
    sets = materialise(sets, "candidate-shingles")
    spread = block_pairs(sets, ["candidate"], "uid", per_block)
    found = materialise(each_unit(spread, ["candidate"], ["uid", "weight", "shingles"], _compare(threshold)), "jaccard-links")
    drop_table(sets)
    return summarise(rows, weighed, ["digest"], found, "doc_id", F.col("digest").isNotNull(), ["h", "root"])


def representatives(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one of least doc_id, then hash of the text.

    Of repeated rows of one text and doc_id one stays, whatever their other columns hold.
    Rows without words can have no link, so all of them stay.
    """
    copy, id_, hash_, free, number = (free_name(docs, x) for x in ("copy_hash", "kept_id", "kept_hash", "kept_free", "kept_row"))
    rows = linked(docs, **options)
    least = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "h")).alias("r"))
    kept = least.select("r.doc_id", "r.h", F.lit(False).alias("free")).unionAll(rows.where("root is null").select("doc_id", "h", F.lit(True))).distinct()
    kept = kept.select(F.col("doc_id").alias(id_), F.col("h").alias(hash_), F.col("free").alias(free))
    own = docs.withColumn(copy, F.xxhash64("text"))
    left = own.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(copy) == F.col(hash_)))
    left = left.withColumn(number, F.when(F.col(free), F.monotonically_increasing_id()).otherwise(-1))
    return left.dropDuplicates(["doc_id", copy, number]).select(*docs.columns)
