"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).  Where none is set, a local session gets a temporary one, and
    any other an error: its executors could not see such a folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: tables in between need a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-checkpoint-"))
        found = context.getCheckpointDir()
    return found


#: rows that go to a Python worker at once while tables are written: whole texts lie in memory several times on the way
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of ``BATCH_ROWS`` rows at most for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def released(run):
    """``run``, a function for mapInArrow, after which the worker gives back the memory that its arrays have left behind: workers live on,
    beside an executor that may need it."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return wrapped


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends here, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def drop_written(df: DataFrame) -> None:
    """Remove a table made by :func:`written` once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_row(doc_id="doc_id"):
    """True where crc32(doc_id as text) mod 3 is not 1 (null ids count as the text '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def one_key(column: Column) -> Column:
    """``column`` as a text that is never null, so that rows with a null meet in joins and windows like any other."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n"))


#: a key with a larger share of the rows of a join than one of so many is broadcast: there are no more such keys than this
HEAVY = 256


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has each of ``keys`` once and in ``rows`` the number of rows of ``left`` with it.

    Keys with over 1/HEAVY of all rows, HEAVY at most, meet their rows in a broadcast, the others in a shuffle, so that no key is a task of
    its own.  ``right`` is read several times: let it be a written table.  ``how``: inner, or left."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    heavy, light = right.where(F.col(rows) * HEAVY > total).drop(rows), right.where(F.col(rows) * HEAVY <= total).drop(rows)
    common = left.join(F.broadcast(heavy), keys)
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return common.unionByName(rest)
