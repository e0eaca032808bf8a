"""Sends the package to the Python workers, wherever the driver found it, and keeps their memory small."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession


@lru_cache
def _sent(application: str) -> None:
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="assayer-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = Path(folder) / "assayer-code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for path in sorted((root / "assayer").rglob("*.py")):
            z.write(path, path.relative_to(root))
    SparkSession.active().sparkContext.addPyFile(str(at))


def ship(spark: SparkSession) -> None:
    """Once for each application: workers need not find the package on a path of their own."""
    _sent(spark.sparkContext.applicationId)


@lru_cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Memory that is free in this process goes back to the system (where the C library can)."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def frugal(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f` for `mapInArrow`, giving free memory back after each batch: a worker lives on, and what it holds counts, while others run."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from f(fed())
        give_back()

    return run
