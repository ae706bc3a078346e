"""Written intermediate tables in the folder that all executors share.

A table written here cuts the lineage and outlives a lost executor. The folder is the session's
``spark.checkpoint.dir``. Only a session with a local master (tests, a laptop) may leave it unset: then a
temporary folder of this machine is chosen and stored in the session.

The tables of an application lie in one folder, which is deleted when the driver's process ends; a long
session deletes those of one piece of work with :func:`temporary_tables`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
#: Else shuffle files stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleared: set[str] = set()
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Raises on a cluster whose session names none."""
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CONF} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mathloom-")
        spark.conf.set(_CONF, found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _own_dir(spark: SparkSession) -> str:
    """The folder of this application, which the end of the process deletes."""
    path = f"{shared_dir(spark)}/mathloom/{spark.sparkContext.applicationId}"
    if path not in _cleared:
        _cleared.add(path)

        def clear() -> None:
            with suppress(Exception):  # the session may be gone already
                _delete(spark, path)

        atexit.register(clear)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. What the write shuffled is deleted at its end."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    if _scopes:
        _scopes[-1].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._mathloom_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no later plan reads."""
    if path := getattr(df, "_mathloom_path", None):
        _delete(df.sparkSession, path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all tables that were written inside; results must have been consumed by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)
