"""A corpus pipeline of five of the operators, each stage written and read again.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Stages accept nulls in any column, empty and
very long texts, repeated rows, empty tables and further columns, as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import line_dedup, mixing, ngram_join, packing, quality
from thalweg.llm.common import materialise, table
from thalweg.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that no learned rule rejects."""
    judged, _, _, kept = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where(kept).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that have a near copy earlier; documents with no line left go."""
    left, n_lines, n_removed = line_dedup.dedup(docs)
    left = left.where((F.col(n_removed) == 0) | (F.col(n_lines) > F.col(n_removed)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links join."""
    return ngram_join.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, in order along the curve."""
    return packing.pack(docs, vocabulary(), end_id=1, length=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("packing", packed),
]

#: Tokenising and the learned rules are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
