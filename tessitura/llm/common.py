"""Helpers that the training-data operators share: tables, durable intermediates, bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words in every operator here: space and 0x09-0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows of an Arrow batch of texts: with Spark's own 10,000, batches of long texts fill a worker's memory.
BATCH_ROWS = 1_000


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows at most, for this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, opened with Spark's reader only, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a fresh local one where it is unset and the master
    is local (tests). On a cluster executors would write to disks of their own, so an unset folder raises there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_tessitura_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessitura-")
        spark._tessitura_dir = folder
    return folder.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends, lost executors cost nothing.

    Once it is written nothing asks for its shuffles again, so Spark deletes them at the end of the write.
    """
    spark = df.sparkSession
    path, setting = f"{shared_dir(spark)}/tessitura/{name}-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessitura_table = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``durable`` tables that nothing reads any more; other DataFrames are let be."""
    for df in tables:
        path = getattr(df, "_tessitura_table", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def crc_fold(column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    key = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def hashed_fraction(df: DataFrame, key: Column, fraction: float, seed: str) -> DataFrame:
    """Rows whose hash of ``key`` falls under ``fraction``; the same rows in every run."""
    if fraction >= 1:
        return df
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000))
    return df.filter(draw < F.lit(int(fraction * 1_000_000)))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def plus(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with further columns, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


_STATE: dict = {}


def clear_state() -> None:
    """Drop what an earlier operator left in this Python worker."""
    _STATE.clear()


def worker_state(key: str, build):
    """What a Python worker keeps between tasks: one operator's state only, so stages don't add up in a reused worker."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = build()
    return _STATE[key]
