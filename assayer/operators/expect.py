"""Data-quality expectations: all scalar checks of a suite in one aggregation, samples only where one fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.model import SAMPLE_ROWS, Expectation, ExpectationSuite, Outcome, canonical_type
from assayer.operators.align import quoted


def null_sample(df: DataFrame, column: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    return df.where(quoted(column).isNull()).orderBy(*[quoted(c) for c in df.columns]).limit(limit)


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Values, without null, that occur more than once, and how often."""
    return df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias(column)).agg(F.count("*").alias("n")).where("n > 1")


def unique_sample(df: DataFrame, column: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    return repeated_values(df, column).orderBy(F.desc("n"), quoted(column)).limit(limit)


def evaluate(df: DataFrame, suite: ExpectationSuite) -> list[Outcome]:
    """One outcome for each expectation. A check of a column that is absent fails."""
    have = set(df.columns)
    counts = {k: F.count_if(quoted(e.column).isNull()) for k, e in enumerate(suite.expectations) if e.kind == "not_null" and e.column in have}
    counts |= {k: F.count("*") for k, e in enumerate(suite.expectations) if e.kind == "row_count"}
    found: dict[int, int] = {}
    if counts:
        row = df.agg(*[c.alias(f"x{k}") for k, c in counts.items()]).first()
        found = {k: row[f"x{k}"] for k in counts}
    for k, e in enumerate(suite.expectations):
        if e.kind == "unique" and e.column in have:
            found[k] = repeated_values(df, e.column).count()
    return [_outcome(df, e, found.get(k)) for k, e in enumerate(suite.expectations)]


def _outcome(df: DataFrame, e: Expectation, found: int | None) -> Outcome:
    dicts = lambda sample: tuple(r.asDict() for r in sample.collect())
    if e.kind == "row_count":
        return Outcome(e, found == e.value, str(e.value), str(found))
    if e.kind == "column_presence":
        lost = [c for c in e.columns if c not in df.columns]
        return Outcome(e, not lost, ", ".join(e.columns), ", ".join(df.columns), len(lost))
    if e.column not in df.columns:
        return Outcome(e, False, e.type or e.kind, "no such column")
    if e.kind == "column_type":
        want, is_ = canonical_type(e.type, df.sparkSession), df.schema[e.column].dataType.simpleString()
        return Outcome(e, want == is_, want, is_)
    sample = null_sample if e.kind == "not_null" else unique_sample
    return Outcome(e, found == 0, "0", str(found), found, dicts(sample(df, e.column)) if found else ())
