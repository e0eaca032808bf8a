"""Execution accuracy: whether two results hold the same rows by position, as lists, bags or sets, or under some order of columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegerType, NumericType, StringType

from assayer.operators.align import quoted
from assayer.operators.diff import bag_counts, bag_sample

SAMPLE = 5


def _digits(column: Column) -> Column:
    """A decimal's digits without zeros at the end."""
    text = column.cast("string")
    return F.when(column == 0, F.lit("0")).when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _number(column: Column, kind: DataType) -> Column:
    """Whole numbers and decimals exactly, at any size; doubles as the shortest digits that mean them. 1 and 1.0 are one."""
    if isinstance(kind, DecimalType):
        return _digits(column)
    if not isinstance(kind, (FloatType, DoubleType)):
        return column.cast("string")
    value = column.cast("double")
    near = value.try_cast("decimal(38,18)")
    whole = (F.abs(value) < F.lit(9e18)) & (value == F.rint(value))
    return F.when(whole, value.try_cast("bigint").cast("string")).when(near.cast("double") == value, _digits(near)).otherwise(value.cast("string"))


def comparable(column: Column, kind: DataType) -> Column:
    """A text by which values are equal as in a loosely typed language: 1, 1.0 and true are one; texts equal texts only."""
    if isinstance(kind, (NumericType, BooleanType)):
        value, kind = (column.cast("int"), IntegerType()) if isinstance(kind, BooleanType) else (column, kind)
        return F.concat(F.lit("n"), _number(value, kind))
    if isinstance(kind, StringType):
        return F.concat(F.lit("s"), column)
    return F.concat(F.lit("o"), F.to_json(F.struct(column.alias("v"))) if column is not None else None)


def by_position(df: DataFrame) -> DataFrame:
    """Columns named by position, values in comparable form, nulls kept."""
    return df.select(*[F.when(quoted(f.name).isNotNull(), comparable(quoted(f.name), f.dataType)).alias(f"p{k}") for k, f in enumerate(df.schema)])


def equal_bags(a: DataFrame, b: DataFrame, distinct: bool = False) -> bool:
    row = bag_counts(a, b, a.columns, distinct).first()
    return row["missing"] == 0 and row["extra"] == 0


def with_index(df: DataFrame, held: list[DataFrame]) -> DataFrame:
    """Rows with their place in the frame's order: the place within a partition, and where that partition starts.

    What is kept between the two passes is added to `held`, for the caller to release.
    """
    marked = df.withColumn("__id", F.monotonically_increasing_id()).persist()
    held.append(marked)
    part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["count"]) for r in marked.groupBy(part.alias("p")).count().collect())  # one row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    first = df.sparkSession.createDataFrame(starts or [(0, 0)], "p bigint, first bigint")
    return marked.join(F.broadcast(first), part == first["p"]).withColumn("__at", F.col("first") + within).drop("__id", "p", "first")


def equal_lists(a: DataFrame, b: DataFrame) -> bool:
    """Row by row in the frames' order."""
    held: list[DataFrame] = []
    try:
        left, right = with_index(a, held), with_index(b, held).toDF(*[f"r_{c}" for c in b.columns], "__at_r")
        joined = left.join(right, F.col("__at") == F.col("__at_r"), "full_outer")
        same = F.col("__at").isNotNull() & F.col("__at_r").isNotNull()
        for c in a.columns:
            same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
        return joined.where(~same).isEmpty()
    finally:
        for df in held:
            df.unpersist()


def ordered(spark, sql: str) -> bool:
    """Whether the statement orders its result: a global sort at the root of the parsed plan, below limits and WITH only."""
    try:
        node = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return False
    while node.nodeName() in ("UnresolvedWith", "GlobalLimit", "LocalLimit", "Offset"):
        node = node.child()
    return node.nodeName() == "Sort" and bool(getattr(node, "global")())


def fingerprints(df: DataFrame) -> DataFrame:
    """For each column `k` a number that only columns of equal bags of values share (but for hash collisions): the sum of the hashes
    of its values, nulls counted too. One aggregation with partial sums; no cell leaves its task."""
    sums = [F.sum(F.xxhash64(quoted(c), quoted(c).isNull()).cast("decimal(20,0)")) for c in df.columns]
    return df.agg(F.count("*").alias("n"), F.array(*sums).alias("f")).select("n", F.posexplode("f").alias("k", "fingerprint"))


def bijections(gold: list, model: list) -> Iterator[list[int]]:
    """Orders of the model's columns in which each has the gold column's fingerprint."""

    def extend(done: list[int]) -> Iterator[list[int]]:
        if len(done) == len(gold):
            yield done
            return
        for j, f in enumerate(model):
            if j not in done and f == gold[len(done)]:
                yield from extend([*done, j])

    yield from extend([])


def equal_by_value(gold: DataFrame, model: DataFrame, compare, distinct: bool = False) -> bool:
    """Whether some order of the model's columns makes the results equal. Two empty results are; an empty and another are not.
    distinct: `compare` takes them as sets, so fingerprints are those of their distinct rows."""
    one, other = (fingerprints(df.distinct() if distinct else df) for df in (gold, model))
    both = one.withColumn("gold", F.lit(True)).unionByName(other.withColumn("gold", F.lit(False)))
    found = sorted(both.collect(), key=lambda r: r["k"])  # a row for each column
    g, m = ([r for r in found if r["gold"] == side] for side in (True, False))
    sizes = g[0]["n"], m[0]["n"]
    if not all(sizes):
        return not any(sizes)
    if len(g) != len(m):
        return False
    g, m = ([r["fingerprint"] for r in side] for side in (g, m))
    return any(compare(gold, model.select(*[F.col(f"p{j}").alias(f"p{k}") for k, j in enumerate(order)])) for order in bijections(g, m))


@dataclass(frozen=True)
class ExecutionAccuracy:
    """row_order: "auto" (if the gold statement orders), "strict" or "ignore"; multiplicity: "multiset" or "set"; columns: "positional" or "by_value"."""

    row_order: str = "auto"
    multiplicity: str = "multiset"
    columns: str = "positional"

    def agrees(self, gold: DataFrame, model: DataFrame, gold_sql: str = "") -> bool:
        g, m = by_position(gold), by_position(model)
        strict = self.row_order == "strict" or self.row_order == "auto" and ordered(gold.sparkSession, gold_sql)
        # Order, where it counts, says more than multiplicity.
        compare = equal_lists if strict else lambda a, b: equal_bags(a, b, self.multiplicity == "set")
        if self.columns == "by_value":
            return equal_by_value(g, m, compare, self.multiplicity == "set" and not strict)
        return len(g.columns) == len(m.columns) and compare(g, m)

    def samples(self, gold: DataFrame, model: DataFrame) -> tuple[list, list]:
        """Up to five rows that each side has and the other lacks."""
        g, m = by_position(gold), by_position(model)
        if len(g.columns) != len(m.columns):
            return g.limit(SAMPLE).collect(), m.limit(SAMPLE).collect()
        distinct = self.multiplicity == "set"
        return bag_sample(g, m, g.columns, SAMPLE, distinct).collect(), bag_sample(m, g, g.columns, SAMPLE, distinct).collect()


SPIDER = ExecutionAccuracy(columns="by_value")
BIRD = ExecutionAccuracy(row_order="ignore", multiplicity="set")
