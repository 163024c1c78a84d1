"""Helpers that the operators share: tables, scratch tables, hashes and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every contract here counts them.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch that goes to a Python worker: texts may be long.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20

#: Rows of a table of sizes that may be broadcast; beyond, it is joined by a shuffle.
FEW = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, unless the session already asks for smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def tidied(run: Callable) -> Callable:
    """run, for mapInArrow or applyInArrow, after which its worker gives freed memory back: workers live on from task to task."""

    def streamed(*args):
        try:
            yield from run(*args)
        finally:
            _give_back()

    def grouped(*args):
        try:
            return run(*args)
        finally:
            _give_back()

    # a function of two arguments, as pyspark tells by the signature, gets a key and its group
    return (lambda key, group: grouped(key, group)) if run.__code__.co_argcount == 2 else (lambda batches: streamed(batches))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when the driver ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"  # one process, one machine
    top = _path(spark, f"{base.rstrip('/')}/ledgerfold/{spark.sparkContext.applicationId}")
    top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)
    return f"{top.toString()}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives a lost executor.

    The job's shuffle files go as soon as it has ended. Scratch.write also lets the table itself go early.
    """
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


class Scratch:
    """The written tables of one run of an operator: each goes after its last reader, all that are left at the end."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = _path(t.sparkSession, t._scratch)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            self.tables = [x for x in self.tables if x is not t]

    def __exit__(self, *_) -> None:
        self.drop(*self.tables)


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, with as many underscores before each as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def lowest_hashes(df: DataFrame, key: str, per: str, most: int) -> DataFrame:
    """About `most` rows of each value of `per` (all, where there are no more): those whose key hashes
    below the share that gives so many. Repeatable, without a sort, and no task holds a whole class.
    The number is binomial, so it exceeds `most` by a few times its root at most."""
    sizes = df.filter(F.col(per).isNotNull()).groupBy(per).agg(F.count("*").alias("_size"))
    few = sizes.limit(FEW + 1).collect()
    if not few:
        return df.filter(F.lit(False))
    if len(few) <= FEW:  # the rows themselves are then not dealt by value, where a common value is one task
        known = [F.struct(F.lit(r[per]).cast(sizes.schema[per].dataType).alias(per), F.lit(r["_size"]).cast("long").alias("_size")) for r in few]
        sizes = F.broadcast(df.sparkSession.range(1).select(F.inline(F.array(*known))))
    place = F.xxhash64(F.col(key), F.lit(17)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return df.join(sizes, per).filter(place * F.col("_size") < most).drop("_size")


def input_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects below df (file sizes, for a scan); where it knows nothing, those of its texts, counted."""
    expected = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if expected >= 1 << 60:  # the optimizer's default for a source without statistics
        wide = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
        expected = sum(x or 0 for x in df.agg(F.count("*"), *wide).first())
    return max(1, expected)


def power_of_two(x: float) -> int:
    """The least power of two that is not below x."""
    return 1 << max(0, int(-(-x // 1)) - 1).bit_length() if x > 1 else 1


def as_batches(rows: Iterable[dict], schema: pa.Schema, rows_at_once: int = 2048, bytes_at_once: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded number of rows and of bytes in binary or text columns."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))
        if len(held) >= rows_at_once or size >= bytes_at_once:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
