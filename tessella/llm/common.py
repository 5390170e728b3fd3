"""Pieces shared by the text operators: words, case folding, materialised tables."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a worker gets of a table at once, as Catalyst sizes it (compressed, for files). Beyond KNOWN it is no size but Catalyst's sign that
#: it has none.
BUCKET_BYTES, KNOWN = 32 << 20, 1 << 50


def bucket_count(df: DataFrame) -> int:
    """Into how many buckets workers deal what ``df`` gives: the session's shuffle partitions, and more where these would be too large
    for a worker's memory. Several buckets may share a partition; a worker holds one at a time."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_partitions(df.sparkSession), -(-size // BUCKET_BYTES) if size < KNOWN else 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the vectorised path of lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` uses it often but it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may do without; one is made for it here."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        configured = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def _give_back() -> None:
    """Return this worker's free memory to the system: workers are kept between tasks, and so is what their allocators hold."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a worker's function for mapInArrow() or applyInArrow(), giving back memory when it is done."""
    if inspect.isgeneratorfunction(run):

        def of_batches(batches):
            try:
                yield from run(batches)
            finally:
                _give_back()

        return of_batches
    if len(inspect.signature(run).parameters) == 1:

        def of_group(table):
            try:
                return run(table)
            finally:
                _give_back()

        return of_group

    def of_two(first, second):
        try:
            return run(first, second)
        finally:
            _give_back()

    return of_two


_SCOPES: list[list[str]] = []
#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write ``df`` as Parquet; the shuffles that fed it are released."""
    spark = df.sparkSession
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_FREE, before) if before is not None else spark.conf.unset(_FREE)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads the files. The files also give Catalyst true sizes, so
    that it broadcasts a side only when that side is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}"
    write(df, path, partition_by)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize() gave and that nothing will read again."""
    for table in tables:
        delete(table.sparkSession, table.written_to)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Workers get at most so many rows at a time from tables written inside, where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end, but for those passed through the function that it gives."""
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_to)
        return table

    _SCOPES.append([])
    try:
        yield keep
    finally:
        mine = _SCOPES.pop()
        for path in mine:
            if path not in kept:
                delete(spark, path)
        if _SCOPES:
            _SCOPES[-1].extend(p for p in mine if p in kept)


def cleanup(spark: SparkSession) -> None:
    """Remove every table that materialize() wrote into the shared folder."""
    delete(spark, f"{shared_dir(spark)}/tessella")
