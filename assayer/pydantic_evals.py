"""SQL equivalence for evaluation frameworks: a verdict and its reason from texts, and an evaluator where pydantic-evals is there."""

from __future__ import annotations

import asyncio
from dataclasses import dataclass

from assayer.benchmark import score_case
from assayer.model import EvalCase, GoldQuery, Rows
from assayer.reporting import failure_text
from assayer.score import observed_equivalence
from assayer.sources.engine import Engine

try:
    from pydantic_evals.evaluators import EvaluationReason, Evaluator
except ImportError:  # the framework can be left out
    EvaluationReason = Evaluator = None


def judge_sql(engine: Engine, sql: str, expected: str | GoldQuery | Rows, name: str = "case", question: str = "") -> tuple[bool, str]:
    """Whether a statement gives what is expected (a text is a gold statement), and why; ValueError for what is no statement or no expectation."""
    if not isinstance(sql, str) or not sql.strip():
        raise ValueError("a statement is needed")
    gold = GoldQuery(expected) if isinstance(expected, str) else expected
    if not isinstance(gold, (GoldQuery, Rows)):
        raise ValueError(f"expected a statement or rows, not {type(expected).__name__}")
    report = score_case(engine, EvalCase(name, question or name, gold), sql, (observed_equivalence(),))
    return report.passed, f"{report.scores[0].basis}" if report.passed else failure_text(report)


if Evaluator is not None:

    @dataclass
    class SqlEquivalence(Evaluator):
        """Scores `ctx.output` against `ctx.expected_output` on the engine, off the event loop's thread."""

        engine: Engine

        def evaluate(self, ctx):
            value, reason = judge_sql(self.engine, ctx.output, ctx.expected_output, ctx.name or "case", ctx.inputs if isinstance(ctx.inputs, str) else "")
            return EvaluationReason(value=value, reason=reason)

        async def evaluate_async(self, ctx):
            return await asyncio.to_thread(self.evaluate, ctx)
