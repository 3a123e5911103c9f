"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source files with the application, once; workers may have neither our path nor our folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tensorloom-src-")
    archive = os.path.join(folder, "tensorloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    if spark.conf.get(_ROWS, "10000") == "10000":  # the default is made for short rows; ours carry texts
        spark.conf.set(_ROWS, "2000")
    _shipped.add(context.applicationId)


def give_back() -> None:
    """Returns freed memory to the system: an idle worker waits beside others on its machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, with the package at hand in the workers, and their memory given back at each task's end."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_groups(groups, function: Callable, schema: str) -> DataFrame:
    """applyInPandas of grouped rows, with the workers' memory given back after each group; the package must have been shipped."""

    def run(group):
        try:
            return function(group)
        finally:
            give_back()

    return groups.applyInPandas(run, schema)


def map_cogroups(groups, others, function: Callable, schema: str) -> DataFrame:
    """The same of the groups of two DataFrames that have the same keys."""

    def run(group, other):
        try:
            return function(group, other)
        finally:
            give_back()

    return groups.cogroup(others).applyInPandas(run, schema)
