"""Reading and writing tables of rivers, bends, trees and flow lines.

Implements: IO1, IO2, IO4-IO8, IO12-IO15, IO17, IO18, U6; IO3 as the two tables of endings, IO20 and IO21 as
``load`` and ``Store.read`` of their tables.

A data set is a folder with one table per kind. A table's rivers are dealt to a fixed
number of buckets by a hash of river_id, and a manifest names the files of each bucket with
the least and largest river_id in them, so that a read of some rivers opens their files
alone, however many rivers there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.functions.scalar import wkt_line

READERS = {"parquet": "parquet", "csv": "csv", "txt": "csv", "json": "json", "orc": "orc", "feather": "feather"}
WRITERS = {"parquet": "parquet", "csv": "csv", "txt": "csv", "json": "json", "orc": "orc"}


class FormatError(ValueError):
    """A file of a kind that is not supported."""


def _kind(path: str, known: dict[str, str]) -> str:
    if not isinstance(path, str):
        raise TypeError("the path has to be a string")
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in known:
        raise FormatError(f"cannot handle .{ending}; known are {', '.join(known)}")
    return known[ending]


def load(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """IO1: a table by its ending. Text tables have a header and inferred types.

    Feather files are read by pyarrow inside one task per file; the other kinds by Spark.
    """
    kind = _kind(path, READERS)
    if kind == "feather":
        out = _feather(spark, path)
    elif kind == "csv":
        out = spark.read.csv(path, header=True, inferSchema=True)
    else:
        out = spark.read.format(kind).load(path)
    return out if columns is None else out.select(*columns)


def _feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather files through Spark's binary reader, so any store works."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")

    def headers(batches):
        for batch in batches:
            for content in batch.column(0):
                schema = pa.ipc.open_file(content.as_buffer()).schema
                yield pa.RecordBatch.from_arrays([pa.array([schema.serialize().to_pybytes()])], names=["schema"])

    head = files.limit(1).mapInArrow(headers, "schema binary").collect()  # a schema alone, not its file
    if not head:
        return spark.createDataFrame([], T.StructType())
    schema = from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(head[0]["schema"])))

    def each(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from pa.ipc.open_file(content.as_buffer()).read_all().to_batches()

    return files.mapInArrow(each, schema)


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """IO2: a table by its ending, replaced as a whole; arrays become text where the kind has none."""
    kind = _kind(path, WRITERS)
    if kind == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    writer = df.write.mode("overwrite")
    writer = writer.option("header", True) if kind == "csv" else writer
    (writer.partitionBy(by) if by else writer).format(kind).save(path)


def layer(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """IO5: one layer of a folder of Parquet tables; a missing one is a KeyError."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise KeyError(name)
    return spark.read.parquet(path)


class Store:
    """IO4, IO12-IO15, IO17: a data set of tables by river_id.

    Every write makes new files and then replaces the manifest in one rename, so readers
    see a table as it was before or after; ``swept`` deletes what no manifest names. Of two
    writers at the same time the later one's manifest stays.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 1024):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _files(self, path: str):
        """The path for Hadoop, and its file system."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _bucket(self, buckets: int, river: Column) -> Column:
        return F.pmod(F.xxhash64(river.cast("string")), F.lit(buckets)).cast("int")

    def manifest(self, table: str) -> dict:
        """``buckets``, ``schema`` and ``files``: bucket, file, low, high (river ids as text, or null if none is known) and rows of each."""
        path, system = self._files(f"{self._path(table)}/manifest.json")
        if not system.exists(path):
            raise KeyError(table)
        rows = self.spark.read.text(path.toString(), wholetext=True).collect()  # a line for each file of the table
        return json.loads(rows[0].value)

    def _dealt(self, table: str, df: DataFrame, buckets: int) -> list[dict]:
        """New files of ``df``, each of one bucket and in order of river_id; what is large is split over several."""
        path = f"{self._path(table)}/data-{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self._bucket(buckets, F.col("river_id"))).hint("rebalance", F.col("_bucket"))
        rows.sortWithinPartitions("_bucket", "river_id").write.partitionBy("_bucket").parquet(path)
        back = self.spark.read.schema(rows.schema).parquet(path)
        text = lambda f: f(F.col("river_id")).cast("string")
        found = back.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_bucket").alias("bucket")).agg(text(F.min).alias("low"), text(F.max).alias("high"), F.count(F.lit(1)).alias("rows"))
        return [r.asDict() for r in found.collect()]  # one row a file

    def _replace(self, table: str, manifest: dict) -> None:
        last, system = self._files(f"{self._path(table)}/manifest.json")
        new, _ = self._files(f"{self._path(table)}/manifest-{uuid.uuid4().hex}.tmp")
        out = system.create(new)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(last.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(new), context.makeQualified(last), options)

    def write(self, table: str, df: DataFrame) -> None:
        self._replace(table, {"buckets": self.buckets, "schema": df.schema.json(), "files": self._dealt(table, df, self.buckets)})

    def _read(self, manifest: dict, files: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(x["file"] for x in files))

    def _of(self, manifest: dict, rivers: list) -> list[dict]:
        """The files that may hold one of the rivers: their bucket's, and of these the ones whose span it lies in."""
        kind = T.StructType.fromJson(json.loads(manifest["schema"]))["river_id"].dataType
        asked = self.spark.createDataFrame([(r,) for r in rivers], T.StructType([T.StructField("river_id", kind)]))
        by: dict[int, list] = {}
        for row in asked.distinct().select("river_id", self._bucket(manifest["buckets"], F.col("river_id")).alias("b")).collect():
            by.setdefault(row.b, []).append(row.river_id)
        number = isinstance(kind, T.NumericType)
        value = lambda x: float(x) if number else str(x)

        def holds(x: dict) -> bool:
            wanted = by.get(x["bucket"], [])
            return any(r is None or (x["low"] is not None and value(x["low"]) <= value(r) <= value(x["high"])) for r in wanted)

        return [x for x in manifest["files"] if holds(x)]

    def read(self, table: str, rivers: Iterable | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """A table, or some rivers of it; of ``columns`` those that the table lacks are null."""
        manifest = self.manifest(table)
        rivers = None if rivers is None else list(rivers)
        df = self._read(manifest, manifest["files"] if rivers is None else self._of(manifest, rivers))
        if rivers is not None:
            df = df.where(F.col("river_id").isin(*(r for r in rivers if r is not None)) | (F.col("river_id").isNull() if None in rivers else F.lit(False)))
        if columns is None:
            return df
        return df.select("river_id", *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns if c != "river_id"))

    def rivers(self) -> DataFrame:
        """IO15: the ids of the data set."""
        return self.read("points").select("river_id").distinct()

    def longest_first(self) -> DataFrame:
        """IO14, T3: rivers with their length, longest first."""
        return self.read("points").groupBy("river_id").agg(F.max("s").alias("length")).orderBy(F.col("length").desc(), "river_id")

    def upsert(self, table: str, df: DataFrame) -> None:
        """The rivers of ``df`` replace theirs; only the buckets they lie in are written anew."""
        manifest = self.manifest(table)
        buckets = manifest["buckets"]
        touched = {r.b for r in df.select(self._bucket(buckets, F.col("river_id")).alias("b")).distinct().collect()}  # as many as buckets at most
        old = self._read(manifest, [x for x in manifest["files"] if x["bucket"] in touched])
        new = df.select("river_id").distinct().withColumnRenamed("river_id", "_r")
        kept = old.join(new, old.river_id.eqNullSafe(new["_r"]), "left_anti").unionByName(df, allowMissingColumns=True)
        files = self._dealt(table, kept, buckets)
        self._replace(table, {"buckets": buckets, "schema": kept.schema.json(), "files": [x for x in manifest["files"] if x["bucket"] not in touched] + files})

    def swept(self, table: str) -> int:
        """Deletes the data files that the manifest does not name, and gives their number."""
        tail = lambda file: file.rsplit("/", 3)[1:]  # noqa: E731  write, bucket and part
        named = {tuple(tail(x["file"])) for x in self.manifest(table)["files"]}
        path, system = self._files(self._path(table))
        gone, every = 0, system.listFiles(path, True)
        while every.hasNext():
            file = every.next().getPath()
            if file.getName().endswith(".parquet") and tuple(tail(file.toString())) not in named:
                system.delete(file, False)
                gone += 1
        return gone


def bend_geometries(bends: DataFrame, x: str = "x", y: str = "y", shape: str = "line") -> DataFrame:
    """IO6: array columns replaced by one WKT column."""
    arrays = [f.name for f in bends.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if shape == "line":
        wkt = wkt_line(F.col(x), F.col(y))
    elif shape == "point":
        wkt = F.format_string("POINT (%s %s)", F.element_at(x, 1).cast("string"), F.element_at(y, 1).cast("string"))
    else:
        raise ValueError(f"unknown shape {shape}")
    return bends.withColumn("geometry", wkt).drop(*arrays)


def save_bends(bends: DataFrame, path: str) -> None:
    """IO18: bends split into folders by the side they curve to."""
    bends.write.mode("overwrite").partitionBy("curvature_side").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """IO7: each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
