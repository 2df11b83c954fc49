"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[tuple[str, str]] = set()


def ship_packages(spark: SparkSession, root: Path, *packages: str) -> None:
    """Send pure-Python packages below ``root`` to the executors, once per session.

    Needed where the cluster does not have them installed.
    """
    for package in packages:
        key = (spark.sparkContext.applicationId, package)
        if key not in _SHIPPED:
            target = Path(tempfile.mkdtemp(prefix="ship-")) / package
            spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", root, package))
            _SHIPPED.add(key)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SCANNED_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
_HELD_LOCK = threading.Lock()
# By application and setting: how many blocks hold it, and the value that they found.
_HELD: dict[tuple[str, str], tuple[int, str]] = {}


@contextmanager
def _held(spark: SparkSession, setting: str, value: int) -> Iterator[None]:
    """Jobs that run inside have the setting; threads may open it at once, and the last one restores what the first one found."""
    key = spark.sparkContext.applicationId, setting
    with _HELD_LOCK:
        count, before = _HELD.get(key, (0, spark.conf.get(setting)))
        _HELD[key] = count + 1, before
        spark.conf.set(setting, value)
    try:
        yield
    finally:
        with _HELD_LOCK:
            count, before = _HELD.pop(key)
            if count > 1:
                _HELD[key] = count - 1, before
            else:
                spark.conf.set(setting, before)


@contextmanager
def small_scans(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs that run inside decode ``rows`` rows of a file at a time, for rows that are large; None leaves the session as it is.

    A task holds the decoded columns of as many rows in arrays that only grow, of 4,096 rows by default.
    """
    with nullcontext() if rows is None else _held(spark, SCANNED_ROWS, rows):
        yield


@contextmanager
def small_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """``small_scans`` that also hand ``rows`` rows at a time to Python."""
    with small_scans(spark, rows), nullcontext() if rows is None else _held(spark, BATCH_ROWS, rows):
        yield
