"""Shared helpers: the scratch folder, written intermediate tables, table reading."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.sources.scratch import scratch_path

#: Words of every contract here: runs of anything but blanks and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set at ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_sample(rows: DataFrame, key: str, bound: int, total: int) -> DataFrame:
    """At most ``bound`` of ``rows``, the least by the hash column ``key``, ties by all columns.

    ``total`` is about the number of rows. A threshold on the hash lets some four times
    the bound through before anything is ordered, so no task or driver meets more,
    however many partitions there are.
    """
    if total > 4 * bound:
        rows = rows.where(F.pmod(F.col(key), F.lit(1 << 40)) < int((1 << 40) * 4 * bound / total))
    return rows.orderBy(F.pmod(F.col(key), F.lit(1 << 40)), *rows.columns).limit(bound)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts lineage with a table every executor can read, so a lost executor costs only
    its running tasks. Shuffle files of the jobs before are unreachable by now and are
    released first rather than at the driver's next collection, so that they do not lie
    beside those of this job.
    """
    spark = df.sparkSession
    release(spark)
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranges_for(written: DataFrame, per: int = 32 << 20) -> int:
    """Partitions that deal a written table out by ``per`` bytes of its files, the session's number at least."""
    spark = written.sparkSession
    size = 0
    for folder in {file.rsplit("/", 1)[0] for file in written.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        size += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per))


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files that no plan refers to."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and no plan needs any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def give_back() -> None:
    """Return what this Python worker has freed to the system.

    Workers are reused by later tasks, and an idle one would hold it beside the JVM.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library alone has it
    if trim is not None:
        trim(0)


def in_slices(function: Callable[[pa.Array], pa.Array], rows: int = 512) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """``function`` over Arrow batches, ``rows`` rows at a time, for an iterator UDF."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.concat_arrays([function(batch.slice(low, rows)) for low in range(0, max(1, len(batch)), rows)])
        batch = None
        give_back()

    run.__name__ = function.__name__
    return run


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
