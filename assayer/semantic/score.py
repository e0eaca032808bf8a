"""Verdicts on metric queries: by what they ask for, by what they give, or by a judge."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.judging import GRADE, graded
from assayer.model import Score
from assayer.operators.accuracy import by_position, equal_bags, equal_by_value
from assayer.semantic.compile import Compiler, MetricQuery, ResolutionError


@dataclass(frozen=True)
class MetricCase:
    id: str
    question: str
    gold: MetricQuery


@dataclass(frozen=True)
class SpecEquivalence:
    """Equal canonical queries pass, and one that means nothing fails; both are proven. Others are left open."""

    compiler: Compiler
    name: str = "metric_spec_equivalence"

    def score(self, spark: SparkSession, case: MetricCase, query: MetricQuery) -> Score:
        gold = self.compiler.canonical(case.gold)
        try:
            candidate = self.compiler.canonical(query)
        except ResolutionError as e:
            return Score(self.name, "fail", 0.0, "proven", str(e))
        return Score(self.name, "pass", 1.0, "proven") if candidate == gold else Score(self.name, "inconclusive", explanation="the queries differ")


@dataclass(frozen=True)
class ResultEquivalence:
    """Rows as bags, numbers to six places, columns by value; the candidate may have more columns if they part no rows.

    A candidate that can't run is scored as `on_error`; a gold query that can't run leaves the verdict open.
    """

    compiler: Compiler
    on_error: str = "inconclusive"
    name: str = "metric_result_equivalence"

    def score(self, spark: SparkSession, case: MetricCase, query: MetricQuery) -> Score:
        candidate, error = self._compiled(spark, query)
        if error:
            return self._failed(error)
        gold, error = self._compiled(spark, case.gold)
        if error:
            return Score(self.name, "inconclusive", explanation=f"gold query: {error}")
        try:
            same = results_agree(gold, candidate)
        except Exception as e:
            # Plans run as rows are compared: see which one it is.
            own = _error_of(lambda: candidate.write.format("noop").mode("overwrite").save())
            return self._failed(own) if own else Score(self.name, "inconclusive", explanation=f"gold query: {str(e) or type(e).__name__}")
        return Score(self.name, "pass" if same else "fail", 1.0 if same else 0.0, "observed")

    def _compiled(self, spark: SparkSession, query: MetricQuery) -> tuple[DataFrame | None, str]:
        try:
            return self.compiler.compile(spark, query), ""
        except Exception as e:
            return None, str(e) or type(e).__name__

    def _failed(self, why: str) -> Score:
        if self.on_error == "fail":
            return Score(self.name, "fail", basis="observed", explanation=f"candidate: {why}")
        return Score(self.name, "inconclusive", explanation=f"candidate: {why}")


def _error_of(run: Callable[[], object]) -> str:
    try:
        run()
    except Exception as e:
        return str(e) or type(e).__name__
    return ""


def _rounded(df: DataFrame) -> DataFrame:
    kinds = {"double", "float", "decimal"}
    return df.select(*[(F.round(F.col(f"`{c}`").cast("double"), 6) if k.split("(")[0] in kinds else F.col(f"`{c}`")).alias(c) for c, k in df.dtypes])


def results_agree(gold: DataFrame, candidate: DataFrame) -> bool:
    """Equal as bags under some order of columns. Of a wider candidate some choice of columns has to be, one that keeps its
    distinct rows distinct; repeated rows may repeat. Two empty results are equal at any width."""
    g, c = by_position(_rounded(gold)), by_position(_rounded(candidate))
    if len(c.columns) <= len(g.columns) or g.isEmpty() or c.isEmpty():
        return equal_by_value(g, c, equal_bags)
    n = c.distinct().count()
    for chosen in combinations(range(len(c.columns)), len(g.columns)):
        part = c.select(*[F.col(f"p{j}").alias(f"p{k}") for k, j in enumerate(chosen)])
        if part.distinct().count() == n and equal_by_value(g, part, equal_bags):
            return True
    return False


@dataclass(frozen=True)
class MetricJudge:
    """`ask`: any callable of case and query that gives a number in [0, 1], or a language model that is prompted for one."""

    ask: Callable[[MetricCase, MetricQuery], float] | object
    threshold: float = 0.5
    name: str = "metric_judge"

    def score(self, spark: SparkSession, case: MetricCase, query: MetricQuery) -> Score:
        try:
            value, why = graded(self.ask, self.prompt(case, query)) if hasattr(self.ask, "complete") else (float(self.ask(case, query)), "")
        except Exception as e:
            return Score(self.name, "inconclusive", explanation=str(e) or type(e).__name__)
        value = min(1.0, max(0.0, value))
        return Score(self.name, "pass" if value >= self.threshold else "fail", value, "judged", why)

    def prompt(self, case: MetricCase, query: MetricQuery) -> str:
        task = "Two metric queries follow. Do they ask for the same thing: metrics, names to group by, filters, order and limit? A default grain that is written out, and the order of names to group by, make no difference."
        return "\n\n".join([task, f"Question: {case.question}", f"Answer:\n{as_text(query)}", f"Reference:\n{as_text(case.gold)}", GRADE])


def as_text(q: MetricQuery) -> str:
    """A metric query's parts, a line each."""
    parts = (("metrics", ", ".join(q.metrics)), ("group by", ", ".join(q.group_by)), ("where", " AND ".join(q.where)), ("order by", ", ".join(q.order_by)), ("limit", "" if q.limit is None else str(q.limit)))
    return "\n".join(f"{name}: {value}" for name, value in parts if value)


def first_decisive(scorers, spark: SparkSession, case: MetricCase, query: MetricQuery) -> Score:
    if not scorers:
        raise ValueError("no scorers")
    for scorer in scorers:
        found = scorer.score(spark, case, query)
        if found.verdict != "inconclusive":
            break
    return found


def strict(compiler: Compiler) -> tuple:
    """By what is asked for, then by what it gives; a candidate that can't run is wrong."""
    return (SpecEquivalence(compiler), ResultEquivalence(compiler, "fail"))


def metric_layer_equivalence(compiler: Compiler, ask) -> tuple:
    """By what is asked for, then by what it gives, then by a judge."""
    return (SpecEquivalence(compiler), ResultEquivalence(compiler), MetricJudge(ask))


def run_metric_benchmark(spark: SparkSession, cases, solver, scorers) -> list[tuple[str, Score]]:
    """A verdict for each case, in their order; a solver that raises fails its case."""
    out = []
    for case in cases:
        try:
            query = solver(case)
        except Exception as e:
            out.append((case.id, Score("solver", "fail", explanation=str(e) or type(e).__name__)))
            continue
        out.append((case.id, first_decisive(scorers, spark, case, query)))
    return out
