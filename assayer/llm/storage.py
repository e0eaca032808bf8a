"""Tables written to the folder that all executors share, to cut lineage between passes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _own_dir(application: str) -> str:
    at = tempfile.mkdtemp(prefix="assayer-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return f"file://{at}"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a folder of our own only where none is set and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _own_dir(spark.sparkContext.applicationId)
    return at.rstrip("/")


class Scratch:
    """Named Parquet tables of one operator run. `drop` removes those that no later plan reads, the application's end all others."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str = "t", rows: int | None = None, rows_a_file: int = 100_000, **options: int | str) -> DataFrame:
        """Write `df` and read it again: later plans start at the files, not at `df`'s lineage.

        rows: as many as `df` may have, where that is known and its last stage reads no more than that: a small table then is a
        few files, not one for each task.
        """
        self.count += 1
        at = f"{self.root}/{self.count:03d}-{name}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // rows_a_file)))
        df.write.option("compression", "zstd").options(**options).parquet(at)
        if self.count == 1:
            files, path = self._files(self.root)
            files.deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if found := table.inputFiles():
                files, path = self._files(found[0].rsplit("/", 1)[0])
                files.delete(path, True)

    def _files(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path
