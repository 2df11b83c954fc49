"""Versions of a folder's content that are published in one step.

What a version consists of is written aside first. A version then becomes the
current one by a single rename of a small file that describes it, named by its
number. A reader takes the file with the highest number and keeps to what it
describes; a writer that dies before the rename has changed nothing.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import SparkSession


class VersionTaken(RuntimeError):
    """Another writer has published the version first."""


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, files = _file_system(spark, f"{path}/published")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name) for name in names if name.isdigit())


def current(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the current version; 0 and None if nothing is published."""
    numbers = _numbers(spark, path)
    return (numbers[-1], read(spark, path, numbers[-1])) if numbers else (0, None)


def read(spark: SparkSession, path: str, number: int) -> dict:
    """The content of a version."""
    file, files = _file_system(spark, f"{path}/published/{number:012d}")
    stream = files.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Make ``content`` version ``number``; ``VersionTaken`` if there is one of that number."""
    target, files = _file_system(spark, f"{path}/published/{number:012d}")
    aside = _file_system(spark, f"{path}/published/.{uuid4().hex}")[0]
    stream = files.create(aside, False)
    stream.write(json.dumps(content).encode())
    stream.close()
    try:
        if files.exists(target) or not files.rename(aside, target):
            raise VersionTaken(f"version {number} of {path} is there already")
    finally:
        if files.exists(aside):
            files.delete(aside, False)


def drop_folders(spark: SparkSession, path: str, keep: set[str]) -> list[str]:
    """Remove folders directly below ``path`` whose names are not in ``keep``; returns the removed names."""
    folder, files = _file_system(spark, path)
    if not files.exists(folder):
        return []
    gone = [status.getPath() for status in files.listStatus(folder) if status.getPath().getName() not in keep]
    for child in gone:
        files.delete(child, True)
    return sorted(child.getName() for child in gone)


def drop_versions(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Forget all but the newest ``keep`` versions; returns the numbers that stay."""
    numbers = _numbers(spark, path)
    for number in numbers[:-keep]:
        file, files = _file_system(spark, f"{path}/published/{number:012d}")
        files.delete(file, False)
    return numbers[-keep:]
