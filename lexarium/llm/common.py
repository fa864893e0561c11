"""Shared pieces: contract words, shared tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space: space and U+0009 to U+000D.
WS = "[\\x20\\x09-\\x0D]"
NOT_WS = "[^\\x20\\x09-\\x0D]"

_made: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None
_caches: dict[str, Callable[[], None]] = {}
_at_work: str | None = None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """array<string> of the maximal runs without white space; [] for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local tests."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="lexarium-")
    return _own_dir


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is scratch
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later uses don't recompute it and losing an executor loses nothing."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() made, once nothing reads them any more. An empty one has no files to go by and stays until the driver ends."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark df for a broadcast if it has at most max_rows rows; otherwise the join shuffles (and AQE splits hot keys)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def works_as(name: str, clear: Callable[[], None]) -> None:
    """Called by a task in a Python worker that keeps caches under this name. Workers outlive tasks: those of other names are emptied, and free pages go back to the system."""
    global _at_work
    _caches[name] = clear
    if _at_work != name:
        for other, empty in _caches.items():
            if other != name:
                empty()
        _at_work = name
        trim()


def trim() -> None:
    """Give freed pages back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def double_array(values) -> Column:
    """A literal array<double>, folded once at planning."""
    return F.expr("from_json('[" + ",".join(repr(float(v)) for v in values) + "]', 'array<double>')")
