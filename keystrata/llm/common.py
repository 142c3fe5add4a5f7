"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch handed to Python; rows keep a batch of ordinary texts at a few MB.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path is only ever opened by Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds what one Arrow batch holds, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def releasing(run):
    """The function over batches, which releases memory when its task ends."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return held


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session has it.

    Where it is unset (tests on one machine), a folder below the warehouse directory.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Whether Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut by a copy that survives executors.

    The copy goes with drop_cut(), or else when the driver ends; the shuffle files that made it go at once.
    """
    return cut_each([df], tag)


def cut_each(frames: Iterable[DataFrame], tag: str = "step") -> DataFrame:
    """One copy, as by cut(), of frames of one schema (one at least), written one after the other."""
    path = None
    for df in frames:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/keystrata-{tag}-{uuid.uuid4().hex}"
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files behind a table made by cut()."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/keystrata-" in f:
            where, fs = _file_system(df.sparkSession, f)
            fs.delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: str, modulus: int):
    """crc32 of the key's decimal text, modulo: the fold that a row belongs to (null key: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus
