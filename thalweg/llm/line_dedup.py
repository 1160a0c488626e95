r"""Fuzzy line deduplication by MinHash.

Lines are the ``\n``-split parts of a text; lines without a visible character are left
alone. A line's shingles are its runs of five characters, one starting at every character
(the whole line, where it has fewer). Equal lines form one class, named by a 64-bit hash.
A class's signature is ``bands`` * ``depth`` minimum hashes over its shingles, 16 bits of
each; ``depth`` of them make a band key. Two lines of Jaccard similarity s share a key with
probability 1 - (1 - s^depth)^bands, which is 0.998 at s = 0.8.

Lines of ordinary prose share keys too. So all lines that share a key first compare whole
signatures: a line goes on if some other agrees with it in nearly as many hashes as the
threshold asks for, 4.5 standard deviations less (one in 100,000 pairs at the threshold is
below that). Lines that go on are compared by the Jaccard similarity of their whole
shingle sets (a shingle by 44 bits of a hash). First, every line meets the least of its key, which joins most
near copies. Where a key's lines are then still in several groups, all of them are
compared across the groups. Both comparisons split crowded keys into pairs of blocks.
Links go to the distributed union-find, and each component keeps its first line, in order
of doc_id, line number and text hash.

Signing and comparing run in Arrow batches with numpy; a batch is worked on in slices of
bounded length, except that one line is one piece of work. Spark splits, sorts and joins.

Defined cases: a null text stays null and has no lines; an empty text has none either; a
null doc_id counts as least; rows with equal doc_id and text are one document and get the
same text; of several texts of one doc_id, that of the least hash comes first; an empty
table stays empty; lines and texts of any length are taken whole; all other columns,
whatever their names, are carried through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.blocks import block_pairs, each_unit, forest, shared_counts
from thalweg.llm.common import drop_table, free_name, give_back, materialise, ranges_for, release
from thalweg.llm.components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What Java's regular expressions take for blanks.
_BLANKS = " \t\n\x0b\x0c\r"
#: Stands for the characters that a line shorter than a shingle lacks.
_NONE = np.uint64(0x110000)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def hashed(codes: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of the lines codes[start:end] of code points, one line after the other; their first places and numbers."""
    n = np.maximum(1, end - start - width + 1)
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(start - first, n)
    padded = np.concatenate([codes, np.zeros(width, np.uint32)])
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * _MIX + padded[at + k]
    for i in np.flatnonzero(end - start < width):
        own = np.zeros(1, np.uint64)
        for c in [*codes[start[i] : end[i]], *[_NONE] * (width - (end[i] - start[i]))]:
            own = own * _MIX + np.uint64(c)
        h[first[i]] = own[0]
    return _scramble(h), first, n


def points(lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lines, one after the other, and where each starts and ends."""
    end = np.cumsum([len(x) for x in lines])
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4"), np.append(0, end[:-1]), end


def sets(lines: Sequence[str], width: int) -> np.ndarray:
    """The distinct shingles of fewer than a million lines: the line's number in the high 20 bits, 44 bits of a hash."""
    h, _, n = hashed(*points(lines), width)
    return np.unique(np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(44), n) | (h >> np.uint64(20)))


class Signer:
    """Signatures of lines."""

    def __init__(self, hashes: int, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 31, hashes, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.width = width

    def __call__(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(lines, 2 * hashes) bytes for the lines codes[start:end] of code points, none of them empty."""
        h, first, _ = hashed(codes, start, end, self.width)
        small = (h >> np.uint64(32)).astype(np.uint32)
        least = np.stack([np.minimum.reduceat(small * odd, first) for odd in self.odd], axis=1)
        mixed = _scramble(least.astype(np.uint64) * _MIX)
        # all low bytes, then all high ones: either half compares signatures
        return np.concatenate([mixed & np.uint64(255), (mixed >> np.uint64(8)) & np.uint64(255)], axis=1).astype(np.uint8)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of ``most`` in all, or of one."""
    low = held = 0
    for i, n in enumerate(sizes):
        if i > low and held + n > most:
            yield low, i
            low, held = i, 0
        held += n
    if low < len(sizes):
        yield low, len(sizes)


def signed(docs: DataFrame, hashes: int, width: int = 5, seed: int = 5) -> DataFrame:
    """doc_id, doc_hash, line (number), uid, signature of every line with a visible character."""
    schema = "doc_id long, doc_hash long, line int, uid long, signature binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(hashes, width, seed)
        for batch in batches:
            texts = [v.as_buffer().to_pybytes().decode("utf-8", "replace") if v.is_valid else "" for v in batch.column(2).cast(pa.large_binary())]
            for low, high in _slices([len(t) for t in texts], 1 << 18):
                found = [(i, k, x) for i in range(low, high) for k, x in enumerate(texts[i].split("\n")) if x.strip(_BLANKS)]
                if not found:
                    continue
                doc, line, own = zip(*found, strict=True)
                signature = signer(*points(own))
                bounds = np.arange(0, signature.size + 1, 2 * hashes, dtype=np.int32)
                uids = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in own], np.uint64).view(np.int64)
                of = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(line, pa.int32()), pa.array(uids),
                     pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bounds), pa.py_buffer(signature.tobytes())])],
                    names=["doc_id", "doc_hash", "line", "uid", "signature"])
        give_back()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_hash"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(each, schema)


def met(banded: DataFrame, ranges: int) -> DataFrame:
    """The distinct rows (key, uid) whose key several uids share, and a few others.

    One range sort by both columns brings them together, so a crowded key spreads over
    ranges; the first and last key of each range are kept too, for the next may share them.
    """
    ordered = banded.repartitionByRange(ranges, "key", "uid").sortWithinPartitions("key", "uid")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, uid, due, head = np.zeros(0, np.int64), np.zeros(0, np.int64), False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, uid = np.append(key, batch.column(0).to_numpy()), np.append(uid, batch.column(1).to_numpy())
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (uid[1:] != uid[:-1])])
            key, uid = key[fresh], uid[fresh]
            head = key[0] if head is None else head
            same = key[1:] == key[:-1]
            out = (key == head) | np.append(same, False) | np.append(False, same)
            out[0] |= due
            due, out[-1] = bool(out[-1]), False  # the last row waits for the next
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(uid[out])], names=["key", "uid"])
            key, uid = key[-1:], uid[-1:]
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(uid)], names=["key", "uid"])
        give_back()

    return ordered.mapInArrow(each, "key long, uid long")


def alike(near: DataFrame, signatures: DataFrame, threshold: float, hashes: int, per_block: int = 2048) -> DataFrame:
    """The rows (key, uid) whose signature nearly agrees with another one's of the key."""
    least = int(hashes * threshold - 4.5 * (hashes * threshold * (1 - threshold)) ** 0.5)
    spread = block_pairs(near, ["key"], "uid", per_block).join(signatures, "uid")
    unit = ["key", "block_a", "block_b"]
    dealt = spread.select(*unit, "block", "uid", "signature").repartition(*unit).sortWithinPartitions(*unit)

    def compared(rows: pa.Table) -> pa.RecordBatch:
        key, a, b, block, uid = (rows.column(i).to_numpy() for i in range(5))
        own = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8).reshape(len(key), hashes)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        unit_of = np.cumsum(new)
        good = np.zeros(len(key), bool)
        i = np.arange(len(key))
        for d in range(1, len(key)):
            i = i[i + d < len(key)]
            i = i[unit_of[i] == unit_of[i + d]]  # rows whose unit reaches so far
            if not len(i):
                break
            x = i[(a[i] == b[i]) | (block[i] != block[i + d])]
            for low in range(0, len(x), 1 << 16):
                y = x[low : low + (1 << 16)]
                y = y[np.count_nonzero(own[y] == own[y + d], axis=1) >= least]
                good[y] = good[y + d] = True
        return pa.RecordBatch.from_arrays([pa.array(key[good]), pa.array(uid[good])], names=["key", "uid"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            names = [held.column(i).to_numpy() for i in range(3)]
            ended = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names]))
            if len(ended):  # the last unit may go on in the next batch
                yield compared(held.slice(0, int(ended[-1]) + 1).combine_chunks())
                held = held.slice(int(ended[-1]) + 1)
        if held is not None:
            yield compared(held.combine_chunks())
        give_back()

    return dealt.mapInArrow(each, "key long, uid long").distinct()


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """uid and text of the lines ``wanted`` (uid, first), first being their place."""
    listed = wanted.groupBy(F.col("first.doc_id").alias("of_id"), F.col("first.doc_hash").alias("of_hash")).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), "uid")).alias("asked")
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_hash"), F.col("text").cast("string").alias("text"))
    found = own.join(listed, F.col("doc_hash").eqNullSafe(F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    cut = found.withColumn("parts", F.split("text", "\n"))
    each = F.transform("asked", lambda x: F.struct(x["uid"].alias("uid"), F.get("parts", x["line"]).alias("text")))
    return cut.select(F.inline(each)).groupBy("uid").agg(F.min("text").alias("text"))


def _similar(threshold: float, width: int):
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        x, y = a.to_pylist(), b.to_pylist()
        for low, high in _slices([len(s) + len(t) for s, t in zip(x, y, strict=True)], 1 << 19):
            one, other = sets(x[low:high], width), sets(y[low:high], width)
            count = lambda s, n=high - low: np.bincount((s >> np.uint64(44)).astype(np.int64), minlength=n)
            shared = count(np.intersect1d(one, other, assume_unique=True))
            out.append(shared >= threshold * (count(one) + count(other) - shared) - 1e-9)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return F.arrow_udf(similar, T.BooleanType())


def _compare(threshold: float, width: int):
    """Links between different groups (roots) of a unit of lines."""

    def work(unit: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        roots, block = unit.column("root").to_numpy(), unit.column("block").to_numpy()
        left = np.flatnonzero(block == unit.column("block_a")[0].as_py())
        right = np.flatnonzero(block == unit.column("block_b")[0].as_py())
        packed = sets(unit.column("text").to_pylist(), width)
        row = (packed >> np.uint64(44)).astype(np.int64)
        size = np.bincount(row, minlength=len(roots))
        common = shared_counts(row, packed & np.uint64((1 << 44) - 1), left, right)
        union = size[left][:, None] + size[right][None, :] - common
        a, b = np.nonzero((common >= threshold * union - 1e-6) & (roots[left][:, None] != roots[right][None, :]))
        if not len(a):
            return roots[:0], roots[:0], roots[:0]
        a, b = left[a], right[b]
        names, at = np.unique(roots, return_inverse=True)
        root = forest(names, at[a], at[b])
        moved = root != names
        return names[moved], np.ones(int(moved.sum()), np.int64), root[moved]

    return work


def groups(every: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, bands: int, depth: int, width: int) -> DataFrame:
    """(node, root) of the classes of lines (uid, first) that similar lines of one key join."""
    half = lambda low, b: F.substring("signature", low + b * depth + 1, depth)
    keys = F.array(*(F.xxhash64(F.lit(b), half(0, b), half(bands * depth, b)) for b in range(bands)))
    met_ = materialise(met(every.select(F.explode(keys).alias("key"), "uid"), ranges_for(every)), "line-keys")
    own = every.select("uid", F.substring("signature", 1, bands * depth).alias("signature"))
    own = own.join(met_.select("uid").distinct(), "uid", "left_semi").groupBy("uid").agg(F.min("signature").alias("signature"))
    near = materialise(alike(met_, own, threshold, bands * depth), "line-alike")
    drop_table(met_)
    heads = near.groupBy("key").agg(F.min("uid").alias("head"), F.max("uid").alias("last")).where("head < last").select("key", "head")
    pairs = near.join(heads, "key").where("uid <> head").select(F.col("head").alias("a"), F.col("uid").alias("b")).distinct()
    pairs = materialise(pairs, "line-pairs")
    wanted = pairs.select(F.col("a").alias("uid")).unionAll(pairs.select("b")).distinct()
    texts = materialise(texts_of(classes.select("uid", "first").join(wanted, "uid", "left_semi"), docs), "line-texts")
    both = pairs.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("y")), "b")
    both = both.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("x")), "a")
    linked = materialise(both.where(_similar(threshold, width)("x", "y")).select("a", "b"), "line-links")
    drop_table(pairs)
    joined = materialise(components(linked), "line-groups")

    rooted = near.join(joined.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    rooted = materialise(rooted.select("key", "uid", "root"), "line-rooted")
    drop_table(near)
    # two lines often share several keys: of keys with the same lines one is enough
    sums = [F.count(F.lit(1)).alias("rows"), F.bit_xor("uid").alias("xor"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("sum")]
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), *sums).where("low < high")
    apart = apart.groupBy("rows", "xor", "sum").agg(F.min("key").alias("key")).select("key")
    crowded = rooted.join(apart, "key", "left_semi").join(texts.select("uid", F.length("text").alias("n")), "uid")
    spread = block_pairs(crowded, ["key"], "uid", 512, F.col("n"), 1 << 20).join(texts, "uid")
    more = materialise(each_unit(spread, ["key"], ["uid", "root", "text"], _compare(threshold, width)), "line-more")
    for table in (rooted, texts):
        drop_table(table)
    more = materialise(components(more.select(F.col("uid").alias("a"), F.col("root").alias("b"))), "line-more-groups")
    moved = joined.join(more.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left")
    alone = more.join(joined.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("over", "root").alias("root")).unionAll(alone.select("node", "root"))


def removed(docs: DataFrame, threshold: float = 0.8, bands: int = 12, depth: int = 4, width: int = 5) -> DataFrame:
    """doc_id, doc_hash, gone: the line numbers that go, of each document that loses some."""
    every = materialise(signed(docs, bands * depth, width), "line-signatures")
    place = F.struct("doc_id", "line", "doc_hash")
    classes = every.groupBy("uid").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    classes = materialise(classes, "line-classes")
    roots = materialise(groups(every, classes, docs, threshold, bands, depth, width), "line-roots")
    placed = materialise(every.select("doc_id", "doc_hash", "line", "uid"), "line-places")
    drop_table(every)
    release(docs.sparkSession)
    grouped = classes.join(roots.select(F.col("node").alias("uid"), "root"), "uid")
    kept = grouped.groupBy("root").agg(F.min("first").alias("keep"))
    fuzzy = roots.join(kept, "root").select(F.col("node").alias("uid"), "keep")
    exact = classes.where("times > 1").join(roots.select(F.col("node").alias("uid")), "uid", "left_anti").select("uid", F.col("first").alias("keep"))
    gone = placed.join(fuzzy.unionAll(exact), "uid").where(~place.eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "doc_hash").agg(F.collect_set("line").alias("gone"))


def dedup(docs: DataFrame, threshold: float = 0.8, **options) -> tuple[DataFrame, str, str]:
    """``docs`` with the texts that are left, and the names of two added columns.

    These count the lines with a visible character before, and those that went. ``docs``
    needs doc_id and text.
    """
    n_lines, n_gone, key, id_, hash_, gone = (free_name(docs, x) for x in ("n_lines", "n_removed", "text_key", "gone_id", "gone_hash", "gone"))
    lost = removed(docs.select("doc_id", "text"), threshold, **options).select(F.col("doc_id").alias(id_), F.col("doc_hash").alias(hash_), F.col("gone").alias(gone))
    out = docs.withColumn(key, F.xxhash64("text"))
    out = out.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(hash_)), "left")
    parts = F.split("text", "\n")
    out = out.withColumn(n_lines, F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(r"[^\s]"))), F.lit(0)))
    out = out.withColumn(n_gone, F.coalesce(F.size(gone), F.lit(0)))
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    return out.drop(key, id_, hash_, gone), n_lines, n_gone
