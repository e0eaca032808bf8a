import pytest

from assayer.model import EvalCase, GoldQuery
from assayer.semantic.compile import MetricQuery
from assayer.semantic.score import MetricCase
from assayer.solvers import MetricSolver, PromptSolver, ScriptedLlm


def test_prompt_solver():
    llm = ScriptedLlm(["```sql\nSELECT 1\n```", "   "])
    solve, case = PromptSolver(llm), EvalCase("c", "How many?", GoldQuery("SELECT 1"), metadata={"context": "CREATE TABLE t"})
    assert solve(case) == "SELECT 1" and solve(case) is None
    assert "CREATE TABLE t" in llm.prompts[0] and "How many?" in llm.prompts[0]


def test_metric_solver():
    case = MetricCase("c", "?", MetricQuery(("m",)))
    solve = MetricSolver(ScriptedLlm(['{"metrics": ["m"], "order_by": ["-m"], "limit": 3}', "[]"]))
    assert solve(case) == MetricQuery(("m",), order_by=("-m",), limit=3)
    with pytest.raises(ValueError):
        solve(case)
