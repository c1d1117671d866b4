"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: Tables of ``cut`` that are still there; results may read them, so they go when the driver ends.
_tables: set[str] = set()


def _delete(jvm, conf, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _sweep() -> None:
    jvm = SparkContext._jvm
    for path in list(_tables) if jvm is not None else []:
        with contextlib.suppress(Exception):  # the store or the JVM may be gone before
            _delete(jvm, jvm.org.apache.hadoop.conf.Configuration(), path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``.  Only a local master, where everything runs on one
    machine, gets a temporary folder when the setting is missing; a cluster gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="skyverify-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which ends its lineage.

    What follows sees the same rows however often it is computed, also after a lost executor.  The
    shuffle files of the write are deleted when it has ended, the table itself by ``drop_cut`` or
    when the driver ends.  ``by`` makes a folder for each of a column's few values.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.partitionBy(*[by] if by else []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if by:
        out = out.select(df.columns)
    out.cut_path = path
    _tables.add(path)
    return out


def drop_cut(df: DataFrame, part: str = "") -> None:
    """Delete a table of ``cut``, or one folder of it, that no later action reads."""
    spark = df.sparkSession
    _delete(spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), f"{df.cut_path}/{part}")
    if not part:
        _tables.discard(df.cut_path)


#: A key that holds at least one in so many rows is frequent, so there are no more frequent keys than this.
FREQUENT = 1000


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row for each key with its number of rows in ``size``.

    Rows of frequent keys stay where they are and get their group by broadcast, of at most FREQUENT
    rows; all others are exchanged by key.  ``total`` is the number of all rows.
    """
    often = F.col(size) * F.lit(FREQUENT) >= F.lit(total)
    sent = F.broadcast(groups.where(often))
    rest = rows.join(F.broadcast(groups.where(often).select(*keys)), keys, "left_anti")
    return rows.join(sent, keys).unionByName(rest.join(groups.where(~often), keys))


def partitions(spark: SparkSession) -> int:
    """Partitions for an exchange whose partition numbers go into names."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, since whole texts pass through Python workers.

    A single larger row is a batch.  Plans read these settings when they run, so they stay.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow string column; empty where it is null."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
