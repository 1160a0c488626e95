"""Written intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder.

    Where none is set, a local session gets a local one; on a cluster that is an error,
    for each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "thalweg-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/thalweg/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table on shared storage, read back: lineage ends, every executor sees it."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` wrote and no plan needs any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
