"""Plain records that pass between engine, comparisons and reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Literal

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructType

SAMPLE_ROWS = 20


@dataclass(frozen=True)
class Rows:
    """Authored rows. With a schema values and types are compared, without one values only and with no tolerance."""

    rows: tuple[dict[str, Any], ...]
    schema: StructType | None = None


@dataclass(frozen=True)
class GoldQuery:
    """The rows that this SQL gives are expected."""

    sql: str


@dataclass(frozen=True)
class Expectation:
    """A rule for a result: row_count (value), column_presence (columns), column_type (column, type), not_null and unique (column)."""

    kind: Literal["row_count", "column_presence", "column_type", "not_null", "unique"]
    column: str | None = None
    value: int | None = None
    columns: tuple[str, ...] = ()
    type: str | None = None


@dataclass(frozen=True)
class ExpectationSuite:
    expectations: tuple[Expectation, ...]


Expected = Rows | GoldQuery | ExpectationSuite


@dataclass(frozen=True)
class Comparison:
    column_order: Literal["ignore", "strict"] = "ignore"
    null_equality: Literal["equal", "distinct"] = "equal"
    float_tolerance: float = 1e-9
    match_key: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.float_tolerance >= 0:
            raise ValueError("float_tolerance is below 0")


@dataclass(frozen=True)
class ExecutionError:
    kind: Literal["query_failed", "budget_exceeded", "duplicate_columns", "type_probe_failed", "platform_unavailable"]
    message: str
    sqlstate: str | None = None
    condition: str | None = None
    params: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Execution:
    """A lazily evaluated result, or the error that came instead. `seconds` is what analysis (and any action so far) took."""

    df: DataFrame | None
    error: ExecutionError | None = None
    seconds: float = 0.0

    @property
    def ok(self) -> bool:
        return self.error is None


@dataclass(frozen=True)
class EvalCase:
    id: str
    input: str
    expected: Expected
    comparison: Comparison = Comparison()
    max_seconds: float | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ResultDiff:
    missing_count: int = 0
    unexpected_count: int = 0
    missing_sample: tuple[dict, ...] = ()
    unexpected_sample: tuple[dict, ...] = ()
    missing_columns: tuple[str, ...] = ()
    unexpected_columns: tuple[str, ...] = ()
    type_mismatches: tuple[tuple[str, str, str], ...] = ()  # column, expected, actual
    column_mismatches: tuple[tuple[str, int], ...] = ()
    order_differs: bool = False


@dataclass(frozen=True)
class Outcome:
    expectation: Expectation
    passed: bool
    expected: str | None = None
    actual: str | None = None
    failing_count: int | None = None
    sample: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Score:
    """A verdict. Inconclusive ones carry neither score nor basis."""

    scorer: str
    verdict: Literal["pass", "fail", "inconclusive"]
    score: float | None = None
    basis: Literal["proven", "observed", "judged"] | None = None
    explanation: str = ""
    diff: ResultDiff | None = None
    outcomes: tuple[Outcome, ...] = ()
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.verdict == "inconclusive" and (self.score is not None or self.basis is not None):
            raise ValueError("an inconclusive score has neither score nor basis")


def canonical_type(kind: DataType | str, spark=None) -> str:
    """The name by which types are held equal. Authored names are resolved by the parser; unknown ones stay as written."""
    if isinstance(kind, DataType):
        return kind.simpleString()
    try:
        return spark.sql(f"SELECT CAST(NULL AS {kind}) AS t").schema[0].dataType.simpleString()
    except Exception:
        return kind
