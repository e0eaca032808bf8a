"""Running cases: solve, execute, score, report; and the accuracy of many."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.model import EvalCase, Score
from assayer.score import ResultSetEquivalence, Scorer
from assayer.sources.engine import Budget, Engine, run_many


@dataclass(frozen=True)
class CaseReport:
    """outcome: passed, scored_failure, solver_failure or execution_failure."""

    case: EvalCase
    outcome: str
    sql: str | None = None
    scores: tuple[Score, ...] = ()
    error: str | None = None

    def __post_init__(self):
        good = bool(self.scores) and all(s.verdict == "pass" for s in self.scores)
        if self.outcome not in ("passed", "scored_failure", "solver_failure", "execution_failure"):
            raise ValueError(f"no outcome {self.outcome}")
        if (self.outcome == "passed") != good:
            raise ValueError("a case passes when all of its scores do, and only then")
        if self.outcome == "scored_failure" and not self.scores:
            raise ValueError("a failure of scoring has a score that is no pass")
        if self.outcome in ("solver_failure", "execution_failure") and not self.error:
            raise ValueError("a failure before scoring has an error")
        if self.outcome == "solver_failure" and (self.sql or self.scores):
            raise ValueError("a failure of the solver has neither statement nor scores")

    @property
    def passed(self) -> bool:
        return self.outcome == "passed"


def evaluate_case(engine: Engine, case: EvalCase, solver: Callable[[EvalCase], str], scorers: Sequence[Scorer] = (ResultSetEquivalence(),)) -> CaseReport:
    """Never raises for what the solver or the statement does."""
    try:
        sql = solver(case)
    except Exception as e:
        return CaseReport(case, "solver_failure", error=str(e) or type(e).__name__)
    if not sql:
        return CaseReport(case, "solver_failure", error="empty response")
    return score_case(engine, case, sql, scorers)


def score_case(engine: Engine, case: EvalCase, sql: str, scorers: Sequence[Scorer]) -> CaseReport:
    budget = Budget(case.max_seconds)
    run = engine.execute(sql, budget)
    if not run.ok:
        return CaseReport(case, "execution_failure", sql, error=f"{run.error.kind}: {run.error.message}")
    if not scorers:
        raise ValueError("no scorers")
    scores = tuple(s.score(engine, case, sql, budget) for s in scorers)
    return CaseReport(case, "passed" if all(s.verdict == "pass" for s in scores) else "scored_failure", sql, scores)


def assert_eval(engine: Engine, case: EvalCase, solver, scorers: Sequence[Scorer] = (ResultSetEquivalence(),)) -> CaseReport:
    """The report, which the run collects too; AssertionError with all that is known if the case did not pass."""
    from assayer import reporting

    report = reporting.record(evaluate_case(engine, case, solver, scorers))
    if not report.passed:
        raise AssertionError(reporting.failure_text(report))
    return report


def run_benchmark(engine: Engine | Callable[[EvalCase], Engine], cases: Iterable[EvalCase], solver, scorers: Sequence[Scorer] = (ResultSetEquivalence(),), limit: int | None = None, threads: int = 1) -> list[CaseReport]:
    """Solvers may run side by side; statements run one after another, in the order of the cases. `engine`: one for all, or what gives a case's."""
    chosen = list(islice(cases, limit))

    def solve(case: EvalCase):
        try:
            return solver(case), None
        except Exception as e:
            return None, str(e) or type(e).__name__

    answers = run_many([lambda c=c: solve(c) for c in chosen], threads)
    out = []
    for case, (sql, error) in zip(chosen, answers, strict=True):
        if not sql or error:
            out.append(CaseReport(case, "solver_failure", error=error or "empty response"))
            continue
        try:
            own = engine if isinstance(engine, Engine) else engine(case)
        except Exception as e:
            out.append(CaseReport(case, "execution_failure", sql, error=f"platform_unavailable: {e}"))
            continue
        out.append(score_case(own, case, sql, scorers))
    return out


def report_rows(spark: SparkSession, reports: Sequence[CaseReport]) -> DataFrame:
    rows = [(r.case.id, r.outcome, r.passed, r.case.metadata.get("difficulty"), r.error) for r in reports]
    return spark.createDataFrame(rows, "case_id string, outcome string, passed boolean, difficulty string, error string")


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: total, passed, accuracy (0.0 without cases)."""
    return rows.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).select("total", "passed", F.coalesce(F.col("passed") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("accuracy"))


def by_difficulty(rows: DataFrame) -> DataFrame:
    """Accuracy of each difficulty; cases without one are left out."""
    return rows.where("difficulty is not null").groupBy("difficulty").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).withColumn("accuracy", F.col("passed") / F.col("total"))


def report_json(reports: Sequence[CaseReport]) -> str:
    passed = sum(r.passed for r in reports)
    cases = [{"id": r.case.id, "outcome": r.outcome, "sql": r.sql, "error": r.error, "scores": [{"scorer": s.scorer, "verdict": s.verdict, "score": s.score, "basis": s.basis, "explanation": s.explanation, "diff": asdict(s.diff) if s.diff else None} for s in r.scores]} for r in reports]
    return json.dumps({"passed": passed, "failed": len(reports) - passed, "cases": cases}, indent=2, default=str)


def summary_text(reports: Sequence[CaseReport]) -> str:
    lines = [f"{'PASS' if r.passed else 'FAIL'}  {r.case.id}" + ("" if r.passed else f"  {r.outcome}" + (f": {r.error}" if r.error else "")) for r in reports]
    passed = sum(r.passed for r in reports)
    return "\n".join([*lines, f"{passed}/{len(reports)} passed" + (f" ({100 * passed / len(reports):.1f} %)" if reports else "")])
