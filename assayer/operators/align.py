"""Bringing two results side by side: columns by name, types, authored rows as relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from assayer.model import Rows


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Columns:
    shared: list[str]
    missing: list[str]
    unexpected: list[str]
    order_differs: bool


def reconcile(actual: list[str], expected: list[str], column_order: str = "ignore") -> Columns:
    """Columns by exact name: shared ones in expected order, and whether the whole lists differ where their order counts."""
    shared = [c for c in expected if c in actual]
    return Columns(shared, [c for c in expected if c not in actual], [c for c in actual if c not in expected], column_order == "strict" and list(actual) != list(expected))


def type_mismatches(actual: StructType | None, expected: StructType | None, shared: list[str]) -> list[tuple[str, str, str]]:
    """Shared columns whose types differ. Without a schema on either side there is nothing to refute."""
    if actual is None or expected is None:
        return []
    return [(c, expected[c].dataType.simpleString(), actual[c].dataType.simpleString()) for c in shared if expected[c].dataType.simpleString() != actual[c].dataType.simpleString()]


def relation(spark: SparkSession, rows: Rows) -> DataFrame:
    """Authored rows as a DataFrame; none of them with a schema is an empty relation of it."""
    if rows.schema is not None:
        return spark.createDataFrame([[r.get(f.name) for f in rows.schema] for r in rows.rows], rows.schema)
    names = list(rows.rows[0]) if rows.rows else []
    if not names:
        return spark.createDataFrame([], StructType([]))
    return spark.createDataFrame([[r.get(n) for n in names] for r in rows.rows], names)


def aligned(df: DataFrame, shared: list[str]) -> DataFrame:
    """The shared columns in expected order. Maps and variants, which Spark can't group or subtract by, become JSON text."""
    kinds = {f.name: f.dataType for f in df.schema}
    comparable = lambda c: F.to_json(quoted(c)) if isinstance(kinds[c], (MapType, VariantType)) else quoted(c)
    return df.select(*[comparable(c).alias(c) for c in shared])
