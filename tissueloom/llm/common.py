"""Shared plumbing of the corpus operators: staged tables and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch handed to Python, so that very long texts stay within a worker's memory.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir``, or, in local mode only, one set here where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            path = set_dir.get()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tissueloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def steps_dir(spark: SparkSession) -> str:
    """The folder of this application's stored steps."""
    return f"{shared_dir(spark)}/tissueloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{steps_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes all stored steps of this application: for when its results have been written or read."""
    delete(spark, steps_dir(spark))


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the stored tables behind frames of ``staged`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None) if df is not None else None
        if path:
            delete(df.sparkSession, path)
            df._staged_path = None


def bounded_batches(spark: SparkSession) -> None:
    """Caps Arrow batches by rows and bytes (only ever lowering what the session allows)."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        size = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB"))
    except Exception:  # not a setting of this Spark, or written with a unit
        size = 0
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, make, schema: str, columns: list[str]) -> DataFrame:
    """``mapInArrow`` over ``columns``; ``make()`` runs once a task and returns batch -> dict of columns."""
    bounded_batches(df.sparkSession)
    out = df.select(*columns)

    def run(batches):
        target = None
        f = make()
        for batch in batches:
            made = f(batch)
            if target is None:
                target = arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array(made[x.name], x.type) for x in target], schema=target)

    return out.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as ``a long, b string``."""
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    fields = (x.strip().split() for x in ddl.split(","))
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


def give_back() -> None:
    """Returns freed memory to the system (glibc keeps it otherwise), after work on large pieces."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings; null reads as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def field(name: str) -> str:
    """A column name quoted for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def map_whole(df: DataFrame, make) -> DataFrame:
    """``mapInArrow`` over all columns, schema kept; ``make()`` runs once a task and returns batch -> batch."""
    bounded_batches(df.sparkSession)

    def run(batches):
        f = make()
        for batch in batches:
            yield f(batch)

    return df.mapInArrow(run, df.schema)


def with_column(batch: pa.RecordBatch, name: str, values) -> pa.RecordBatch:
    """The batch with one of its columns replaced."""
    k = batch.schema.get_field_index(name)
    columns = list(batch.columns)
    columns[k] = pa.array(values, batch.schema.field(k).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


#: Bits of a membership bitmap: its size is the same whatever it is made from.
BITMAP = 1 << 25


def thinned(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``column`` is not among ``keys`` (one column): it loses no row that is.

    The keys' hashes set bits of a bitmap of fixed size (4 MB), which goes to all tasks. Where
    keys are so many that it fills up, fewer rows go; an exact join follows in any case.
    """
    bounded_batches(df.sparkSession)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
    bits = keys.select(place(keys.columns[0]).alias("h")).select(F.expr("h div 32 as w"), F.expr("shiftleft(1L, int(h % 32)) as b"))
    words = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(BITMAP // 32, np.uint32)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            hit = (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(hit.astype(bool)))

    return df.withColumn("_place", place(column)).mapInArrow(run, df.schema)
