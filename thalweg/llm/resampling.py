"""Importance resampling towards a target distribution of hashed word n-grams.

The features of a text are its single words and its runs of two words. The features of
all documents, and those of the target texts, are counted in buckets; a bucket's gain is
the log ratio of its smoothed shares. A document weighs the mean gain of its features;
Gumbel noise on the weights turns the highest scores into a draw without replacement in
proportion to the ratios.

Each distinct feature of a batch is hashed once: its words get integer ids, a run of two
is a tuple of ids packed into one number, the distinct tuples are sorted out, the bytes of
each are hashed, and the buckets are joined back to all occurrences by place. A dictionary
belongs to a task and its words stay from batch to batch within a bound; one for the whole
corpus would send every n-gram of every document through two shuffles, where here at most
one count a bucket leaves a task. Texts are so read twice, which costs less than
storing what was found in them. The driver holds one gain a bucket.

Defined cases: a null text has no words; a document without features weighs nothing; a
null doc_id reads as ``null`` in the draw's hash and stands first among ties; repeated
rows are documents of their own; an empty table gives an empty result, and an empty target
leaves the smoothing alone; texts of any length are taken whole; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import drop_table, give_back, materialise
from thalweg.operators.ranking import ranked

#: Over UTF-8 after lower-casing: letters and digits of ASCII, and the bytes of every other character.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Features:
    """Buckets of the features of texts; one per task."""

    def __init__(self, buckets: int, keep: int = 400_000):
        self.buckets, self.keep = buckets, keep
        self._forget()

    def _forget(self) -> None:
        self._ids: dict[bytes, int] = {}
        self._follows: list[bytes] = []  # a word's bytes after the blank before it
        self._sums: list[int] = []  # checksum of each word

    def _numbered(self, run: list[bytes]) -> np.ndarray:
        ids = self._ids
        for word in {*run}.difference(ids):
            ids[word] = len(ids)
            self._follows.append(b" " + word)
            self._sums.append(zlib.crc32(word))
        return np.fromiter(map(ids.__getitem__, run), np.int64, len(run))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document and bucket of every feature of ``texts``, words first, and the number of words of each text."""
        if len(self._ids) > self.keep:
            self._forget()
        each = [self._numbered(_WORD.findall(text.lower())) for text in texts]
        n = np.array([len(x) for x in each], np.int64)
        flat = np.concatenate(each) if each else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), n)
        single = np.array(self._sums, np.int64)[flat] % self.buckets
        inside = doc[:-1] == doc[1:]
        distinct, place = np.unique((flat[:-1] << 32 | flat[1:])[inside], return_inverse=True)
        # a checksum goes on over further bytes: the first word's over the blank and the second
        first, second = (distinct >> 32).tolist(), (distinct & 0xFFFFFFFF).tolist()
        sums = map(zlib.crc32, map(self._follows.__getitem__, second), map(self._sums.__getitem__, first))
        double = np.fromiter(sums, np.int64, len(distinct)) % self.buckets
        return np.concatenate([doc, doc[:-1][inside]]), np.concatenate([single, double[place]]), n


def _slices(texts: pa.Array, rows: int = 2048, size: int = 4 << 20) -> Iterator[list[bytes]]:
    """The texts in order, in slices of at most so many rows, and of so many bytes and one text more."""
    held, total = [], 0
    for text in texts.cast(pa.large_binary()):
        held.append(text.as_py() or b"")
        total += len(held[-1])
        if len(held) == rows or total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def histogram(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often the whole texts of ``texts`` have a feature of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for some in _slices(batch.column(0)):
                total += np.bincount(own.of(some)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])
        own = None
        give_back()

    counted = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's share in the target over its share in the source, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(len(gain))
        for batch in batches:
            columns = []
            for some in _slices(batch.column(1)):
                doc, bucket, words = own.of(some)
                n, total = np.bincount(doc, minlength=len(some)), np.zeros(len(some), np.int64)
                np.add.at(total, doc, gain[bucket])
                columns.append((words, n, total // np.maximum(n, 1)))
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(c)) for c in zip(*columns, strict=True))],
                                                 names=["doc_id", "n_words", "n_features", "weight"])
        own = None
        give_back()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, least: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document.

    Of the N documents with at least ``least`` words the floor(``percent`` N / 100) of
    highest score are drawn, ties to the smaller doc_id, and ranked from 1; the others'
    rank is null.
    """
    rows = weighed(docs, gains(histogram(docs, buckets), histogram(target, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = rows.withColumn("score", F.col("weight") + F.floor(F.log(-F.log(share)) * -1000))
    rows = materialise(rows.withColumn("fit", F.col("n_words") >= least), "importance")
    drawn = rows.where("fit").count() * percent // 100
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    out = ranked(rows, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    drop_table(rows)
    return out.drop("fit")
