"""What answers a question: any callable of a case, or a language model behind one small interface."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from assayer.model import EvalCase
from assayer.semantic.compile import MetricQuery
from assayer.semantic.score import MetricCase
from assayer.sources.cases import extract_sql


class Llm(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass
class ScriptedLlm:
    """Gives its replies in turn and keeps the prompts: for tests and offline use."""

    replies: Sequence[str]
    prompts: list[str] = field(default_factory=list)

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.replies[len(self.prompts) - 1]


@dataclass
class PromptSolver:
    """Asks for one statement over the tables that `schema` describes."""

    llm: Llm
    schema: Callable[[EvalCase], str] = lambda case: case.metadata.get("context", "")
    dialect: str = "Spark SQL"

    def __call__(self, case: EvalCase) -> str | None:
        return extract_sql(self.llm.complete(f"Tables:\n{self.schema(case)}\n\nQuestion: {case.input}\n\nAnswer with one {self.dialect} statement in a fenced block."))


@dataclass
class MetricSolver:
    """Asks for a metric query as JSON with metrics, group_by, where, order_by and limit."""

    llm: Llm
    names: Sequence[str] = ()

    def __call__(self, case: MetricCase) -> MetricQuery:
        reply = extract_sql(self.llm.complete(f"Metrics and names to group by: {', '.join(self.names)}\n\nQuestion: {case.question}\n\nAnswer with a metric query as JSON."))
        raw = json.loads(reply or "null")
        if not isinstance(raw, dict):
            raise ValueError("the reply is no metric query")
        return MetricQuery(tuple(raw["metrics"]), *[tuple(raw.get(k) or ()) for k in ("group_by", "where", "order_by")], raw.get("limit"))
