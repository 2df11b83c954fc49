"""Folders for tables that cut lineage or hold a run's output."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


# Folders of local sessions that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a temporary folder; on a
    cluster a machine-local folder would lose data with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="folioseek-")
    return _LOCAL_FOLDERS[context.applicationId]


# The folders of the operations that are open in this thread, the innermost last.
_OPEN = threading.local()


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Folders that ``fresh_path`` names inside are dropped at the end.

    For an operation that has written its result elsewhere by then.
    """
    _OPEN.stack = [*getattr(_OPEN, "stack", []), []]
    try:
        yield
    finally:
        *_OPEN.stack, paths = _OPEN.stack
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    path = f"{shared_folder(spark)}/folioseek/{name}-{uuid4().hex}"
    if getattr(_OPEN, "stack", None):
        _OPEN.stack[-1].append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` computed once and read back from a table in the shared folder; ``options`` are those of its writer."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
