"""Token-id files with random access: directly addressable codes.

A file set is a Parquet table of segments. A segment holds the ids of whole documents,
split into byte-wide levels: level 0 keeps the low byte of every id, level k the k-th
byte of the ids that need it. A bitmap per level says which ids go on to the next, and
a rank directory counts its set bits up to every 512-bit block. Token ``i`` is read with
one byte and one rank per level; no other token is decoded.

Columns: ``part`` and ``segment`` order the segments, ``first`` is the number of ids
before the segment within its part, ``doc_ids``, ``doc_tokens`` and ``doc_starts`` list its
documents in order, ``levels``, ``bitmaps`` and ``ranks`` are the code. A reader that asks
for tokens reads the listings alone first, then the code of the segments it needs.

Parquet is the container because Spark commits it atomically on every store and a lost
executor leaves nothing half written.

Defined cases: a null text counts as empty; an empty document has its end id alone; an
id that repeats keeps one entry per row, ordered by text; a null doc_id sorts first; an
empty table gives an empty file set; texts of any length lie whole in one segment; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.llm.tokens import encoder

#: Bits that one entry of a rank directory covers.
BLOCK = 512

SCHEMA = (
    "part int, segment int, first long, doc_ids array<long>, doc_tokens array<long>, doc_starts array<long>, n long, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


class Codes:
    """The code of one run of ids."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, np.uint32) for x in ranks]

    @staticmethod
    def build(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """(levels, bitmaps, rank directories) of unsigned 32-bit ids."""
        levels, bitmaps, ranks = [], [], []
        rest = ids.astype(np.uint32, copy=False)
        while len(rest):
            levels.append((rest & 0xFF).astype(np.uint8).tobytes())
            more = rest > 0xFF
            bits = np.packbits(more, bitorder="little")
            bitmaps.append(bits.tobytes())
            padded = np.concatenate([more, np.zeros(-len(more) % BLOCK, bool)]).reshape(-1, BLOCK)
            before = np.concatenate([[0], np.cumsum(padded.sum(axis=1))[:-1]])
            ranks.append(before.astype(np.uint32).tobytes())
            rest = rest[more] >> np.uint32(8)
        return levels, bitmaps, ranks

    def _rank(self, level: int, i: int) -> int:
        """Set bits of the level's bitmap before position ``i``."""
        block = i // BLOCK
        if block == len(self.ranks[level]):
            block -= 1
        low = block * BLOCK // 8
        bits = np.unpackbits(self.bitmaps[level][low : i // 8 + 1], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[: i - block * BLOCK].sum())

    def __getitem__(self, i: int) -> int:
        value, shift, level = 0, 0, 0
        while True:
            value |= int(self.levels[level][i]) << shift
            if not self.bitmaps[level][i // 8] >> (i % 8) & 1:
                return value
            i, shift, level = self._rank(level, i), shift + 8, level + 1

    def take(self, i: np.ndarray) -> np.ndarray:
        """The ids at the positions ``i``, in any order: a byte and a rank per level each."""
        out = np.zeros(len(i), np.uint32)
        at, shift, level = np.arange(len(i)), 0, 0
        while len(at):
            out[at] |= self.levels[level][i].astype(np.uint32) << np.uint32(shift)
            bitmap = self.bitmaps[level]
            more = bitmap[i // 8] >> (i % 8) & 1 == 1
            at, i = at[more], i[more]
            if not len(i):
                break
            # whole bytes of the block before the position, and the low bits of its own byte
            block = i // BLOCK
            byte = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
            own = np.where(byte < (i // 8)[:, None], bitmap[np.minimum(byte, len(bitmap) - 1)], 0).astype(np.uint8)
            low = bitmap[i // 8] & ((1 << (i % 8)) - 1).astype(np.uint8)
            i = self.ranks[level][block].astype(np.int64) + np.bitwise_count(own).sum(axis=1) + np.bitwise_count(low)
            shift, level = shift + 8, level + 1
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive): a rank per level, then their bytes alone."""
        out = np.zeros(stop - start, np.uint32)
        at, shift, level = np.arange(stop - start), 0, 0
        while len(at):
            out[at] |= self.levels[level][start : start + len(at)].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(self.bitmaps[level][start // 8 : (start + len(at) + 7) // 8], bitorder="little")
            more = bits[start % 8 : start % 8 + len(at)].astype(bool)
            if not more.any():
                break
            start = self._rank(level, start)
            at, shift, level = at[more], shift + 8, level + 1
        return out


def _row(part: int, segment: int, first: int, docs: list, sizes: list[int], ids: list[np.ndarray]) -> dict:
    run = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    levels, bitmaps, ranks = Codes.build(run)
    return {"part": part, "segment": segment, "first": first, "doc_ids": docs, "doc_tokens": sizes,
            "doc_starts": (np.cumsum(sizes) - sizes).tolist(), "n": len(run),
            "levels": levels, "bitmaps": bitmaps, "ranks": ranks}


def encode(docs: DataFrame, tokenizer: str, end_id: int, segment_tokens: int = 1 << 18) -> DataFrame:
    """Segments of the documents (doc_id, text) in ascending doc_id order.

    ``tokenizer`` is the vocabulary file, ``end_id`` closes each document. A segment is
    closed by the document that fills it to ``segment_tokens``.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()),
                            ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("n", pa.int64()),
                            *((x, pa.list_(pa.binary())) for x in ("levels", "bitmaps", "ranks"))])
        segment = first = held = 0
        ids: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = bpe.encode(text.as_py())
                ids += [own, end]
                names.append(doc_id)
                sizes.append(len(own) + 1)
                held += len(own) + 1
                if held >= segment_tokens:
                    yield pa.RecordBatch.from_pylist([_row(part, segment, first, names, sizes, ids)], schema)
                    segment, first, held, ids, names, sizes = segment + 1, first + held, 0, [], [], []
        if names:
            yield pa.RecordBatch.from_pylist([_row(part, segment, first, names, sizes, ids)], schema)

    return ordered.mapInArrow(write, SCHEMA)


def documents(segments: DataFrame) -> DataFrame:
    """Each document read back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before: those of earlier parts, of earlier
    segments of the part, of earlier documents of the segment. Only one row per part is
    brought into order.
    """
    parts = segments.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select(
        F.col("part").alias("of_part"),
        (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_start"),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["levels"], row["bitmaps"], row["ranks"])
                at, starts, sums = 0, [], []
                for n in row["doc_tokens"]:
                    starts.append(row["first"] + at)
                    sums.append(zlib.crc32(codes.slice(at, at + n).astype("<u4").tobytes()))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(starts), pa.int32()),
                     pa.array(starts, pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    rows = segments.mapInArrow(read, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return rows.join(before, rows.part == before.of_part).select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokens(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Single tokens by address: ``wanted`` has (doc_id, at); returns (doc_id, at, token).

    The document is looked up in the segments' own listing. Positions asked for are
    gathered by segment, each once and so no more than the segment has, and a segment is
    loaded once for all of them; its tokens are read by rank. Positions outside the
    document give null.
    """
    listed = segments.select("part", "segment", F.explode(F.arrays_zip("doc_ids", "doc_tokens", "doc_starts")).alias("d"))
    listed = listed.select("part", "segment", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_tokens").alias("n"), F.col("d.doc_starts").alias("from"))
    asked = wanted.select("doc_id", F.col("at").cast("long").alias("at")).join(listed, "doc_id", "left")
    inside = (F.col("at") >= 0) & (F.col("at") < F.col("n"))
    asked = asked.select("doc_id", "at", "part", "segment", F.when(inside, F.col("from") + F.col("at")).alias("i"))
    places = asked.where("i is not null").select("part", "segment", "i").distinct().groupBy("part", "segment").agg(F.collect_list("i").alias("places"))
    loaded = places.join(segments.select("part", "segment", "levels", "bitmaps", "ranks"), ["part", "segment"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, segment, places, *code = (batch.column(c)[k] for c in range(6))
                i = places.values.to_numpy()
                found = Codes(*(x.as_py() for x in code)).take(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), part.as_py(), np.int32)), pa.array(np.full(len(i), segment.as_py(), np.int32)), pa.array(i), pa.array(found.astype(np.int64))],
                    names=["part", "segment", "i", "token"],
                )

    read = loaded.select("part", "segment", "places", "levels", "bitmaps", "ranks").mapInArrow(pick, "part int, segment int, i long, token long")
    return asked.join(read, ["part", "segment", "i"], "left").select("doc_id", "at", "token")


def write_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, path: str) -> DataFrame:
    """Write the files at ``path`` and return what ``documents`` reads from them."""
    encode(docs, tokenizer, end_id).write.parquet(path)
    return documents(spark.read.schema(SCHEMA).parquet(path))
