"""Packing documents into training sequences along a space-filling curve.

Every document gets a hashed bag of token ids, projected to four dimensions by a seeded
sign matrix; its place on a Hilbert curve through these is the sort key. Documents are
range-sorted by the key, so neighbours on the curve share sequences, and the stream of
each range is cut every ``length`` ids. The rest of a range is cut into powers of two,
which need no padding.

Defined cases: a null text is empty and holds its end id alone; equal documents lie next
to each other, ordered by doc_id; a null doc_id sorts first; rows that repeat are packed
as often as they occur; texts of any length are packed whole, in chunks of bounded size;
an empty table gives no piece; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thalweg.llm.common import give_back, materialise, ranges_for
from thalweg.llm.tokens import encoder

#: Buckets of the hashed vectors, dimensions after projection, bits of each on the curve.
BUCKETS, DIMS, BITS = 4096, 4, 15

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "hilbert_key long"
)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned ``points`` (n, dims), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(set_, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class _Curve:
    """Place of a document on the curve, from its ids."""

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (BUCKETS, DIMS))

    def spread(self, ids: np.ndarray) -> np.ndarray:
        """The projected direction of one document's hashed counts."""
        hashed = (ids * np.uint32(2654435761)) >> np.uint32(20)
        counts = np.bincount(hashed, minlength=BUCKETS).astype(float)
        return (counts @ self.signs) / max(1.0, np.sqrt(counts @ counts))

    def keys(self, spreads: list[np.ndarray]) -> np.ndarray:
        """Places of a batch of documents on the curve."""
        # the projections of unrelated vectors are near to normal: a logistic curve spreads them evenly
        even = 1 / (1 + np.exp(-1.702 * np.clip(np.array(spreads), -30, 30)))
        return hilbert(np.minimum(even * (1 << BITS), (1 << BITS) - 1), BITS)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, chunk: int = 4096) -> DataFrame:
    """doc_id, key on the curve, start, doc_tokens, ids (little-endian unsigned 32-bit, with the end id).

    A document gives a row for each ``chunk`` of its ids, so rows are of bounded size and
    ranges of equally many rows hold about equally many ids.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, curve, end = encoder(tokenizer), _Curve(), np.array([end_id], np.uint32)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):  # enough for numpy, and little is held
                some = batch.slice(low, 512)
                spreads, rows = [], []
                for k, text in enumerate(some.column(1)):
                    own = np.concatenate([bpe.encode(text.as_py() or ""), end]).astype("<u4")
                    spreads.append(curve.spread(own))
                    rows += [(k, at, len(own), own[at : at + chunk].tobytes()) for at in range(0, len(own), chunk)]
                of, start, total, ids = zip(*rows, strict=True)
                of = np.array(of)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(of)), pa.array(curve.keys(spreads)[of], pa.int64()), pa.array(start, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "hilbert_key", "start", "doc_tokens", "ids"],
                )
        give_back()

    picked = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return picked.mapInArrow(each, "doc_id long, hilbert_key long, start long, doc_tokens long, ids binary")


def cut(ordered: DataFrame, length: int) -> DataFrame:
    """Pieces of the sorted documents, partition by partition.

    Sequence ids are unique: the partition in the high bits, a running number below.
    At most one open sequence is held in memory.
    """
    if length & (length - 1):
        raise ValueError("the sequence length has to be a power of two")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        number = filled = 0
        open_: list[tuple] = []  # (doc, key, start, ids, doc_tokens) of the open sequence
        names = PIECES.replace(",", " ").split()[::2]

        def emit(pieces: list[tuple], sequence: int) -> list[tuple]:
            rows, at = [], 0
            for doc, key, start, ids, n in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, base + sequence, at, key))
                at += len(ids)
            return rows

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc, key, start, total, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                at = 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    open_.append((doc, key, start + at, ids[at : at + take].copy(), total))
                    at, filled = at + take, filled + take
                    if filled == length:
                        rows += emit(open_, number)
                        number, filled, open_ = number + 1, 0, []
            if rows:
                yield table(rows)
        while filled:  # the rest of the range, in powers of two
            room = 1 << (filled.bit_length() - 1)
            taken, left = [], []
            for doc, key, start, ids, n in open_:
                here = ids[:room]
                if len(here):
                    taken.append((doc, key, start, here, n))
                if len(ids) > len(here):
                    left.append((doc, key, start + len(here), ids[len(here) :], n))
                room -= len(here)
            yield table(emit(taken, number))
            number, open_ = number + 1, left
            filled = sum(len(x[3]) for x in left)
        give_back()

    return ordered.mapInArrow(each, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Pieces of all documents: where each run of a document's ids lies in which sequence.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32,
    doc_tokens, sequence_id, offset (place in the sequence), hilbert_key. The ids are
    written once, so that the range sort samples them without encoding twice and the number
    of ranges follows from their bytes; ties of
    the key are broken by doc_id, so one large group of copies spreads over ranges.
    """
    coded = materialise(tokenise(docs, tokenizer, end_id), "packing-ids")
    order = ("hilbert_key", "doc_id", "start", "ids")
    ordered = coded.repartitionByRange(ranges_for(coded, 8 << 20), *order[:3]).sortWithinPartitions(*order)
    return cut(ordered, length)
