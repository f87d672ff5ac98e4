"""What the operators of this package share: words, shared storage, shipping of code to executors."""

from __future__ import annotations

import atexit
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
SEPARATORS = r"[\x20\x09-\x0D]+"

#: Rows and bytes in a batch between the JVM and Python workers, at most (or one larger row).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

#: Work folders made inside the enclosing ``noted`` block of this thread or task, if there is one.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library's modules to the executors (once per application), for functions that run in Python there.

    Bounds the session's Arrow batches too, where it has not set smaller ones: in rows, and in bytes if that was left at
    its default.
    """
    # Texts can be long: batches of the default 10,000 of them would take a worker's memory by themselves.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == f"{64 << 20}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:  # the whole library, so that any copy of it will do
        for top, folders, names in os.walk(root):
            folders[:] = [f for f in folders if f != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="strandline-"), "strandline_llm.zip")
    with open(path, "wb") as f:
        f.write(blob.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; removed when the driver ends.

    Where the setting is absent (tests on one machine) a local temporary folder serves; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "strandline-checkpoints")
    path = f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"
    if (within := _noted.get()) is not None:
        within.append(path)
    atexit.register(_remove, spark, path)
    return path


@contextmanager
def noted() -> Iterator[list[str]]:
    """The work folders made inside the block, and in no other thread's or block's."""
    folders: list[str] = []
    token = _noted.set(folders)
    try:
        yield folders
    finally:
        _noted.reset(token)
        if (around := _noted.get()) is not None:
            around.extend(folders)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder is temporary anyway
        pass


def save(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``folder`` and return the table read back: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    # Small row groups take less memory a task; texts shrink to half of what the default codec leaves.
    df.write.mode("overwrite").option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables, or whole work folders, that no later plan reads.

    Shuffle files of finished jobs go only when the driver collects its garbage; that is asked for here too.
    """
    for path in paths:
        _remove(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """Array of the words of ``text``; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of ``text`` as long; null gives 0."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SEPARATORS))).cast("long")


def row_key(*columns: str) -> Column:
    """64-bit identity of a row by the named columns; nulls count as values."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def threshold(share: float) -> int:
    """The 64-bit hash below which ``share`` of all hashes lie: as fine as the hashes are, so that no share comes to nothing."""
    return max(-(2**63) + 1, min(2**63 - 1, int(share * 2**64) - 2**63))


def sampled(mark: Column, share: float) -> Column:
    """Whether a row with the 64-bit hash ``mark`` is among ``share`` (0 to 1) of all rows."""
    return F.lit(True) if share >= 1 else mark < F.lit(threshold(share))


def whole(df: DataFrame, *without: str) -> Column:
    """The row of ``df``, or all but some columns, as one column ``row``: its columns cannot clash with an operator's names."""
    held = [F.col(quoted(c)) for c in df.columns if c not in without]
    return F.struct(*(held or [F.lit(True).alias("none")])).alias("row")


def unwrapped(df: DataFrame, **instead: Column) -> list[Column]:
    """The columns of ``df`` from the column ``row`` that ``whole`` made, some of them from elsewhere."""
    return [(instead[c] if c in instead else F.col("row")[c]).alias(c) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
