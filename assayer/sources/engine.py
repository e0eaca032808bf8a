"""Running SQL: errors as values, a guard against twin column names, and time budgets that cancel Spark jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from assayer.model import Execution, ExecutionError


def translate(error: Exception) -> ExecutionError:
    """State, condition and parameters of Spark's errors; Py4J errors give their text. A message is never empty."""
    if isinstance(error, PySparkException):
        return ExecutionError("query_failed", error.getMessage() or str(error) or type(error).__name__, error.getSqlState(), error.getCondition(), dict(error.getMessageParameters() or {}))
    return ExecutionError("query_failed", str(error) or type(error).__name__)


def disconnected(error: ExecutionError) -> bool:
    """Whether the platform was lost rather than the statement wrong: connection states (08...), or a stopped session."""
    return (error.sqlstate or "").startswith("08") or error.kind == "platform_unavailable" or "SparkContext was shut down" in error.message or "stopped SparkContext" in error.message


def twin_columns(names: list[str]) -> list[str]:
    return sorted({n for n in names if names.count(n) > 1})


class Budget:
    """Seconds that the queries of a case share. None: no limit."""

    def __init__(self, seconds: float | None):
        self.left = seconds

    def spend(self, seconds: float) -> None:
        if self.left is not None:
            self.left = max(0.0, self.left - seconds)

    @property
    def gone(self) -> bool:
        return self.left is not None and self.left <= 0


class Engine:
    """A Spark session on which candidate and expected queries run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> Engine:
        """The Parquet tables of a folder as views in a session of their own."""
        own = spark.newSession()
        for t in tables:
            own.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return cls(own)

    def execute(self, sql: str, budget: Budget | None = None) -> Execution:
        """Analyse one statement. Its rows are computed by what reads `df`, not here; commands run at once."""
        if budget and budget.gone:
            return Execution(None, ExecutionError("budget_exceeded", "no time is left for this query"))
        began = time.monotonic()
        try:
            df = self.spark.sql(sql)
            twins = twin_columns(df.columns)
        except Exception as e:
            return Execution(None, translate(e), time.monotonic() - began)
        took = time.monotonic() - began
        if budget:
            budget.spend(took)
        if twins:
            return Execution(None, ExecutionError("duplicate_columns", f"columns of one name: {', '.join(twins)}"), took)
        return Execution(df, None, took)

    def action(self, run: Callable[[], Any], budget: Budget | None = None, grace: float = 1.0) -> tuple[Any, ExecutionError | None]:
        """What `run` returns, or an error. Beyond the budget its Spark jobs are cancelled, and a late result does not count."""
        if budget and budget.gone:
            return None, ExecutionError("budget_exceeded", "no time is left for this query")
        began = time.monotonic()
        try:
            if budget is None or budget.left is None:
                return run(), None
            return self._watched(run, budget.left, grace)
        except Exception as e:
            return None, translate(e)
        finally:
            if budget:
                budget.spend(time.monotonic() - began)

    def _watched(self, run: Callable[[], Any], seconds: float, grace: float) -> tuple[Any, ExecutionError | None]:
        from pyspark import InheritableThread

        sc, group, box = self.spark.sparkContext, f"assayer-{uuid.uuid4().hex}", {}

        def work():
            sc.setJobGroup(group, "watched query", interruptOnCancel=True)
            try:
                box["value"] = run()
            except Exception as e:
                box["error"] = e

        worker = InheritableThread(target=work, daemon=True)
        worker.start()
        worker.join(seconds)
        if worker.is_alive():
            sc.cancelJobGroup(group)
            worker.join(grace)
            return None, ExecutionError("budget_exceeded", f"took more than {seconds:g} s")
        return (None, translate(box["error"])) if "error" in box else (box["value"], None)

    def scalar(self, sql: str, budget: Budget | None = None) -> tuple[Any, ExecutionError | None]:
        """The one value of a result of one row and one column; null is a value."""
        done = self.execute(sql, budget)
        if not done.ok:
            return None, done.error
        rows, error = self.action(lambda: done.df.take(2), budget)
        if error:
            return None, error
        if len(rows) != 1 or len(done.df.columns) != 1:
            return None, ExecutionError("query_failed", f"one value expected, {len(rows)} or more rows of {len(done.df.columns)} columns found")
        return rows[0][0], None

    def healthy(self) -> bool:
        """Whether the session answers; a stopped one does not."""
        return self.spark.sparkContext._jsc is not None and self.scalar("SELECT 1")[0] == 1


def run_many(work: list[Callable[[], Any]], threads: int = 1) -> list[Any]:
    """Results in the order of `work`; with threads, several at a time."""
    if threads <= 1:
        return [w() for w in work]
    out: list[Any] = [None] * len(work)
    todo = iter(enumerate(work))
    lock = threading.Lock()

    def worker():
        while True:
            with lock:
                item = next(todo, None)
            if item is None:
                return
            out[item[0]] = item[1]()

    pool = [threading.Thread(target=worker) for _ in range(threads)]
    for t in pool:
        t.start()
    for t in pool:
        t.join()
    return out


def ddl(df: DataFrame, name: str) -> str:
    """A table's columns as a CREATE TABLE statement, for prompts."""
    return f"CREATE TABLE {name} (\n" + ",\n".join(f"  {f.name} {f.dataType.simpleString()}" for f in df.schema) + "\n)"
