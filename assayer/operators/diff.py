"""Differences of two results as plans: bags by one signed union, keyed rows by one full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.functions.tolerance import numeric, rounded, scale_of, within
from assayer.model import SAMPLE_ROWS
from assayer.operators.align import aligned, quoted


def with_tolerance(df: DataFrame, shared: list[str], schema: StructType | None, tolerance: float) -> DataFrame:
    """Numeric columns of the expected schema rounded to the tolerance's scale. A tolerance of 0 or no schema: as they are."""
    if not tolerance or schema is None:
        return df
    scale, names = scale_of(tolerance), numeric(schema, shared)
    # Either side's own type decides how its values fit; a column is wrapped on both sides or on none.
    return df.select(*[(rounded(quoted(c).cast(schema[c].dataType) if df.schema[c].dataType != schema[c].dataType else quoted(c), schema[c].dataType, scale) if c in names else quoted(c)).alias(c) for c in shared])


def unsorted(df: DataFrame) -> DataFrame:
    """The same rows, for bags, in which no sort counts: Spark leaves out those at the root of a join's side, but not of a union's."""
    tree = df.sparkSession._jvm.org.apache.spark.sql.catalyst.trees.TreePattern
    if not df._jdf.queryExecution().analyzed().containsPattern(tree.SORT()):
        return df
    return df.crossJoin(F.broadcast(df.sparkSession.sql("SELECT * FROM VALUES (1) AS t(one)").select()))  # one row, no column


def signed_counts(expected: DataFrame, actual: DataFrame, shared: list[str], distinct: bool = False) -> DataFrame:
    """Distinct rows with `__n`: occurrences expected less actual ones. One exchange, with partial sums; nulls are equal.

    distinct: 1 for rows that only the expected side has and -1 for those that only the actual one has, found by the same one table of
    rows for each task; sides made distinct beforehand would take three more.
    """
    marks = (1, 2) if distinct else (1, -1)
    left, right = (unsorted(df.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(shared)])).withColumn("__s", F.lit(s).cast("bigint")) for df, s in zip((expected, actual), marks, strict=True))
    names = [f"c{k}" for k in range(len(shared))]
    seen = F.bit_or("__s")
    n = seen.bitwiseAND(1) - F.shiftright(seen, 1) if distinct else F.sum("__s")
    return left.unionAll(right).groupBy(*names).agg(n.alias("__n")).where("__n <> 0")


def bag_counts(expected: DataFrame, actual: DataFrame, shared: list[str], distinct: bool = False) -> DataFrame:
    """One row: how many rows are missing from the actual bag (distinct: set) and how many it has too many."""
    if not shared:
        return expected.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("missing"), F.lit(0).cast("bigint").alias("extra"))
    total = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).cast("bigint")
    return signed_counts(expected, actual, shared, distinct).agg(total(F.col("__n")).alias("missing"), total(-F.col("__n")).alias("extra"))


def bag_sample(left: DataFrame, right: DataFrame, shared: list[str], limit: int = SAMPLE_ROWS, distinct: bool = False) -> DataFrame:
    """The first `limit` rows (in the order of all columns) that `left` has and `right` does not, each as often as it lacks (distinct: once)."""
    rows = signed_counts(left, right, shared, distinct).where("__n > 0")
    names = [f"c{k}" for k in range(len(shared))]
    first = rows.orderBy(*names).limit(limit)  # at most so many distinct rows are needed
    copies = first.select(*names, F.explode(F.sequence(F.lit(1), F.least("__n", F.lit(limit)))).alias("__k"))
    return copies.orderBy(*names, "__k").limit(limit).select(*[F.col(n).alias(c) for n, c in zip(names, shared, strict=True)])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many key values without a null occur more than once."""
    present = df.where(~_any_null(keys))
    return present.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("__n")).where("__n > 1").agg(F.count("*").alias("duplicates"))


def _any_null(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | quoted(k).isNull()
    return out


def keyed_join(expected: DataFrame, actual: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Full outer join on equal keys, columns as e0.. and a0.., with presence marks. Null keys meet nothing, and their rows go round the join."""
    e = expected.select(*[quoted(c).alias(f"e{k}") for k, c in enumerate(shared)], F.lit(True).alias("in_e"))
    a = actual.select(*[quoted(c).alias(f"a{k}") for k, c in enumerate(shared)], F.lit(True).alias("in_a"))
    condition = F.lit(True)
    for key in keys:
        k = shared.index(key)
        condition = condition & (F.col(f"e{k}") == F.col(f"a{k}"))
    lost_e, lost_a = (_any_null([f"{side}{shared.index(key)}" for key in keys]) for side in "ea")
    joined = e.where(~lost_e).join(a.where(~lost_a), condition, "full_outer")
    return joined.unionByName(e.where(lost_e), allowMissingColumns=True).unionByName(a.where(lost_a), allowMissingColumns=True)


def matches(k: int, is_numeric: bool, null_equality: str, tolerance: float) -> Column:
    """Whether column `k` agrees in a joined row: never null."""
    e, a = F.col(f"e{k}"), F.col(f"a{k}")
    equal = within(e, a, tolerance) if is_numeric and tolerance else e == a
    both_null = e.isNull() & a.isNull() if null_equality == "equal" else F.lit(False)
    return F.coalesce(equal, F.lit(False)) | both_null


def keyed_stats(expected: DataFrame, actual: DataFrame, keys: list[str], shared: list[str], schema: StructType | None = None, null_equality: str = "equal", tolerance: float = 1e-9) -> DataFrame:
    """One row: `missing`, `extra`, and for each column that is no key `m_<column>`, the joined rows in which it differs."""
    numbers = set(numeric(schema, shared))
    joined = keyed_join(expected, actual, keys, shared)
    both = F.col("in_e").isNotNull() & F.col("in_a").isNotNull()
    stats = [F.count_if(F.col("in_a").isNull()).alias("missing"), F.count_if(F.col("in_e").isNull()).alias("extra")]
    stats += [F.count_if(both & ~matches(k, c in numbers, null_equality, tolerance)).alias(f"m_{c}") for k, c in enumerate(shared) if c not in keys]
    return joined.agg(*stats)


def keyed_sample(expected: DataFrame, actual: DataFrame, keys: list[str], shared: list[str], side: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of one side (`missing`: expected only, `extra`: actual only) under their own names, the first in order."""
    joined = keyed_join(expected, actual, keys, shared)
    own, other = ("e", "in_a") if side == "missing" else ("a", "in_e")
    rows = joined.where(F.col(other).isNull()).select(*[F.col(f"{own}{k}").alias(c) for k, c in enumerate(shared)])
    return rows.orderBy(*[quoted(c) for c in shared]).limit(limit)


def prepared(expected: DataFrame, actual: DataFrame, shared: list[str], schema: StructType | None, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Both sides ready for a bag comparison."""
    return tuple(with_tolerance(aligned(df, shared), shared, schema, tolerance) for df in (expected, actual))
