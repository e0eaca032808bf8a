"""SQLite and DuckDB files as Spark sources, read in ranges of row ids; queries then run on Spark.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", "/shared/shop.sqlite").option("table", "orders").load()

The file has to be at that path for every executor. Tables without row ids, and views, are read by one task.
"""

from __future__ import annotations

import sqlite3
import sys
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

# Workers need not have this package on a path of their own.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 10_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    """Row ids from `first` up to and without `end`; None: all rows."""

    def __init__(self, first: int | None, end: int | None):
        self.first, self.end = first, end

    def where(self) -> str:
        return "" if self.first is None else f" WHERE rowid >= {self.first} AND rowid < {self.end}"


def ranges(bounds: tuple[int | None, int | None] | None, parts: int) -> list[Range]:
    if bounds is None or bounds[0] is None:
        return [Range(None, None)]
    first, last = bounds
    step = max(1, -(-(last - first + 1) // parts))
    return [Range(a, a + step) for a in range(first, last + 1, step)]


# SQLite


def sqlite_connection(path: str) -> sqlite3.Connection:
    """Read only; `path` may be a file: URI."""
    uri = path if path.startswith("file:") else f"file:{path}"
    con = sqlite3.connect(uri + ("&" if "?" in uri else "?") + "mode=ro" if "mode=" not in uri else uri, uri=True)
    con.text_factory = lambda raw: raw.decode("utf-8", "replace")
    return con


def sqlite_tables(path: str) -> list[str]:
    with closing(sqlite_connection(path)) as con:
        return [n for (n,) in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY rowid")]


def sqlite_ddl(path: str) -> str:
    """The statements that made the tables, in their order."""
    with closing(sqlite_connection(path)) as con:
        return ";\n".join(sql for (sql,) in con.execute("SELECT sql FROM sqlite_master WHERE type = 'table' AND sql IS NOT NULL ORDER BY rowid"))


def declared(kind: str):
    """The type that a declaration means by SQLite's rules of affinity; for columns without values."""
    kind = kind.upper()
    if "INT" in kind:
        return LongType()
    if any(k in kind for k in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if not kind or "BLOB" in kind:
        return BinaryType()
    return DoubleType()


def held_type(kinds: set[str], declaration: str):
    """The type of the values that a column holds, as SQLite lets any value stand anywhere: mixed ones are texts."""
    kinds = kinds - {"null"}
    if not kinds:
        return declared(declaration)
    if kinds == {"integer"}:
        return LongType()
    if kinds <= {"integer", "real"}:
        return DoubleType()
    return BinaryType() if kinds == {"blob"} else StringType()


class SqliteSource(DataSource):
    """Options: `path`, `table`, `numPartitions` (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        table = self.options["table"]
        with closing(sqlite_connection(self.options["path"])) as con:
            columns = [(r[1], r[2] or "") for r in con.execute(f"PRAGMA table_info({quoted(table)})")]
            if not columns:
                raise ValueError(f"no table {table}")
            held = [{k for (k,) in con.execute(f"SELECT DISTINCT typeof({quoted(c)}) FROM {quoted(table)}")} for c, _ in columns]
        return StructType([StructField(c, held_type(kinds, d)) for (c, d), kinds in zip(columns, held, strict=True)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options["path"], self.options["table"], int(self.options.get("numPartitions", 8)))


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str, parts: int):
        self.schema, self.path, self.table, self.parts = schema, path, table, parts

    def partitions(self) -> list[Range]:
        with closing(sqlite_connection(self.path)) as con:
            try:
                bounds = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                return ranges(bounds if all(isinstance(b, int) for b in bounds) else None, self.parts)
            except sqlite3.OperationalError:
                return [Range(None, None)]

    def read(self, partition: Range) -> Iterator[tuple]:
        convert = [{LongType: None, DoubleType: float, StringType: lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), BinaryType: bytes}[type(f.dataType)] for f in self.schema]
        columns = ", ".join(quoted(f.name) for f in self.schema)
        with closing(sqlite_connection(self.path)) as con:
            for row in con.execute(f"SELECT {columns} FROM {quoted(self.table)}{partition.where()}"):
                yield tuple(v if v is None or c is None else c(v) for v, c in zip(row, convert, strict=True))


# DuckDB


class DuckDbSource(DataSource):
    """Options: `path`, `table`, `numPartitions` (8). Needs the duckdb module where it is read."""

    @classmethod
    def name(cls) -> str:
        return "duckdb"

    def schema(self) -> StructType:
        import duckdb

        with duckdb.connect(self.options["path"], read_only=True) as con:
            return from_arrow_schema(con.execute(f"SELECT * FROM {quoted(self.options['table'])} LIMIT 0").to_arrow_table().schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return DuckDbReader(self.options["path"], self.options["table"], int(self.options.get("numPartitions", 8)))


class DuckDbReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int):
        self.path, self.table, self.parts = path, table, parts

    def partitions(self) -> list[Range]:
        import duckdb

        with duckdb.connect(self.path, read_only=True) as con:
            try:
                return ranges(con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone(), self.parts)
            except duckdb.Error:  # a view
                return [Range(None, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(self.path, read_only=True) as con:
            yield from con.execute(f"SELECT * FROM {quoted(self.table)}{partition.where()}").to_arrow_reader(BATCH)


def duckdb_tables(path: str) -> list[str]:
    import duckdb

    with duckdb.connect(path, read_only=True) as con:
        return [n for (n,) in con.execute("SELECT table_name FROM information_schema.tables WHERE table_schema = 'main' ORDER BY table_name").fetchall()]


def register(spark: SparkSession) -> None:
    for source in (SqliteSource, DuckDbSource):
        spark.dataSource.register(source)
