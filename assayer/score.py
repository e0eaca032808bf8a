"""Scorers: verdicts on a candidate statement, and how they are combined."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Protocol

from assayer.judging import GRADE, Example, graded
from assayer.model import EvalCase, ExpectationSuite, GoldQuery, ResultDiff, Score
from assayer.operators import diff, expect
from assayer.operators.accuracy import ExecutionAccuracy as Comparator
from assayer.operators.align import reconcile, relation, type_mismatches
from assayer.plans.equivalence import equivalent
from assayer.sources.engine import Budget, Engine


class Scorer(Protocol):
    def score(self, engine: Engine, case: EvalCase, sql: str, budget: Budget) -> Score: ...


def misconfigured(name: str, why: str) -> Score:
    return Score(name, "inconclusive", explanation=why, metadata={"scorer_misconfigured": True})


@dataclass(frozen=True)
class ResultSetEquivalence:
    """Rows, columns and types of the candidate's result against expected rows or a gold statement's."""

    name: str = "result_set_equivalence"

    def score(self, engine: Engine, case: EvalCase, sql: str, budget: Budget) -> Score:
        if isinstance(case.expected, ExpectationSuite):
            return misconfigured(self.name, "expects rows or a gold query")
        actual = engine.execute(sql, budget)
        if not actual.ok:
            return Score(self.name, "fail", explanation=actual.error.message)
        if isinstance(case.expected, GoldQuery):
            gold = engine.execute(case.expected.sql, budget)
            if not gold.ok:
                return Score(self.name, "fail", explanation=gold.error.message, metadata={"gold_query_failed": True})
            expected, schema = gold.df, gold.df.schema
        else:
            expected, schema = relation(engine.spark, case.expected), case.expected.schema
        return self._compare(engine, case, expected, schema, actual.df, budget)

    def _compare(self, engine: Engine, case: EvalCase, expected, schema, actual, budget: Budget) -> Score:
        c = case.comparison
        columns = reconcile(actual.columns, expected.columns, c.column_order)
        if c.null_equality == "distinct" and not c.match_key:
            return Score(self.name, "fail", explanation="distinct nulls need a match key")
        kinds = type_mismatches(actual.schema, schema, columns.shared)
        facts = ResultDiff(missing_columns=tuple(columns.missing), unexpected_columns=tuple(columns.unexpected), type_mismatches=tuple(kinds), order_differs=columns.order_differs)
        tolerance = c.float_tolerance if schema is not None else 0.0
        compare = self._keyed if c.match_key else self._bags
        facts, error = compare(engine, case, facts, expected, actual, columns.shared, schema, tolerance, budget)
        if error:
            return Score(self.name, "fail", explanation=error)
        equal = facts == ResultDiff()
        return Score(self.name, "pass" if equal else "fail", 1.0 if equal else 0.0, "observed", diff=None if equal else facts)

    def _bags(self, engine, case, facts, expected, actual, shared, schema, tolerance, budget):
        if not shared:
            return facts, None
        e, a = diff.prepared(expected, actual, shared, schema, tolerance)
        row, error = engine.action(lambda: diff.bag_counts(e, a, shared).first(), budget)
        if error:
            return facts, error.message
        samples = []
        for n, left, right in ((row["missing"], e, a), (row["extra"], a, e)):
            found, error = engine.action(lambda left=left, right=right: [r.asDict() for r in diff.bag_sample(left, right, shared).collect()], budget) if n else ([], None)
            if error:
                return facts, error.message
            samples.append(tuple(found))
        return replace(facts, missing_count=row["missing"], unexpected_count=row["extra"], missing_sample=samples[0], unexpected_sample=samples[1]), None

    def _keyed(self, engine, case, facts, expected, actual, shared, schema, tolerance, budget):
        keys = list(case.comparison.match_key)
        if lost := [k for k in keys if k not in shared]:
            return facts, f"match key columns are not shared: {', '.join(lost)}"
        for side, df in (("expected", expected), ("actual", actual)):
            row, error = engine.action(lambda df=df: diff.duplicate_keys(df, keys).first(), budget)
            if error:
                return facts, error.message
            if row["duplicates"]:
                return facts, f"the match key is not unique in the {side} rows"
        row, error = engine.action(lambda: diff.keyed_stats(expected, actual, keys, shared, schema, case.comparison.null_equality, tolerance).first(), budget)
        if error:
            return facts, error.message
        wrong = tuple((c, row[f"m_{c}"]) for c in shared if c not in keys and row[f"m_{c}"])
        samples = []
        for n, side in ((row["missing"], "missing"), (row["extra"], "extra")):
            found, error = engine.action(lambda side=side: [r.asDict() for r in diff.keyed_sample(expected, actual, keys, shared, side).collect()], budget) if n else ([], None)
            if error:
                return facts, error.message
            samples.append(tuple(found))
        return replace(facts, missing_count=row["missing"], unexpected_count=row["extra"], column_mismatches=wrong, missing_sample=samples[0], unexpected_sample=samples[1]), None


@dataclass(frozen=True)
class ExecutionAccuracy:
    comparator: Comparator = Comparator()
    name: str = "execution_accuracy"

    def score(self, engine: Engine, case: EvalCase, sql: str, budget: Budget) -> Score:
        if not isinstance(case.expected, GoldQuery):
            return misconfigured(self.name, "expects a gold query")
        gold, model = engine.execute(case.expected.sql, budget), engine.execute(sql, budget)
        if not model.ok:
            return Score(self.name, "fail", explanation=model.error.message)
        if not gold.ok:
            return Score(self.name, "fail", explanation=gold.error.message, metadata={"gold_query_failed": True})
        same, error = engine.action(lambda: self.comparator.agrees(gold.df, model.df, case.expected.sql), budget)
        if error:
            return Score(self.name, "fail", explanation=error.message)
        if same:
            return Score(self.name, "pass", 1.0, "observed")
        (missing, extra), error = engine.action(lambda: self.comparator.samples(gold.df, model.df), budget)
        facts = None if error else ResultDiff(missing_sample=tuple(r.asDict() for r in missing), unexpected_sample=tuple(r.asDict() for r in extra))
        return Score(self.name, "fail", 0.0, "observed", diff=facts)


@dataclass(frozen=True)
class SemanticEquivalence:
    """Checks in turn, each "equivalent" or "unknown"; the first that confirms decides."""

    checks: Sequence = (equivalent,)
    name: str = "semantic_equivalence"

    def score(self, engine: Engine, case: EvalCase, sql: str, budget: Budget) -> Score:
        if not isinstance(case.expected, GoldQuery):
            return misconfigured(self.name, "expects a gold query")
        if any(check(engine.spark, case.expected.sql, sql) == "equivalent" for check in self.checks):
            return Score(self.name, "pass", 1.0, "proven")
        return Score(self.name, "inconclusive", explanation="no check confirms it")


@dataclass(frozen=True)
class Expectations:
    name: str = "expectation_suite"

    def score(self, engine: Engine, case: EvalCase, sql: str, budget: Budget) -> Score:
        if not isinstance(case.expected, ExpectationSuite):
            return misconfigured(self.name, "expects an expectation suite")
        actual = engine.execute(sql, budget)
        if not actual.ok:
            return Score(self.name, "fail", explanation=actual.error.message)
        outcomes, error = engine.action(lambda: expect.evaluate(actual.df, case.expected), budget)
        if error:
            return Score(self.name, "fail", explanation=error.message)
        good = all(o.passed for o in outcomes)
        return Score(self.name, "pass" if good else "fail", 1.0 if good else 0.0, "observed", outcomes=tuple(outcomes))


@dataclass(frozen=True)
class Judge:
    """Asks whether the statement answers the question: a number in [0, 1], `threshold` or more passes.

    `ask` is any callable of case and statement, or a language model that is prompted with the criteria, and with steps,
    a rubric (from, to, meaning) and examples where there are any. `show` names what it sees of the case.
    """

    ask: object
    threshold: float = 0.5
    name: str = "judge"
    criteria: str = "The statement answers the question."
    steps: tuple[str, ...] = ()
    rubric: tuple[tuple[float, float, str], ...] = ()
    examples: tuple[Example, ...] = ()
    show: tuple[str, ...] = ("question", "answer", "reference")

    def __post_init__(self):
        if any(low > high for low, high, _ in self.rubric):
            raise ValueError("a band of the rubric ends before it begins")

    def score(self, engine: Engine, case: EvalCase, sql: str, budget: Budget) -> Score:
        try:
            value, why = graded(self.ask, self.prompt(case, sql)) if hasattr(self.ask, "complete") else (float(self.ask(case, sql)), "")
        except Exception as e:
            return Score(self.name, "inconclusive", explanation=str(e) or type(e).__name__)
        value = min(1.0, max(0.0, value))
        return Score(self.name, "pass" if value >= self.threshold else "fail", value, "judged", why)

    def prompt(self, case: EvalCase, sql: str) -> str:
        seen = {"question": case.input, "answer": sql, "reference": case.expected.sql if isinstance(case.expected, GoldQuery) else None}
        parts = [f"Grade by this standard: {self.criteria}"]
        parts += ["Steps:\n" + "\n".join(f"{k}. {s}" for k, s in enumerate(self.steps, 1))] if self.steps else []
        parts += ["Scores:\n" + "\n".join(f"{low} to {high}: {what}" for low, high, what in self.rubric)] if self.rubric else []
        parts += [f"Example\n{e}" for e in self.examples]
        parts += [f"{name.capitalize()}:\n{seen[name]}" for name in self.show if seen[name] is not None]
        return "\n\n".join([*parts, GRADE])


@dataclass(frozen=True)
class FirstDecisive:
    """The first verdict that passes or fails; if none does, the last. The trail stands in the metadata."""

    scorers: tuple[Scorer, ...]
    name: str = "first_decisive"

    def __post_init__(self):
        if not self.scorers:
            raise ValueError("no scorers")

    def score(self, engine: Engine, case: EvalCase, sql: str, budget: Budget) -> Score:
        trail: list[Score] = []
        for scorer in self.scorers:
            trail.append(scorer.score(engine, case, sql, budget))
            if trail[-1].verdict != "inconclusive":
                break
        return replace(trail[-1], scorer=self.name, metadata=trail[-1].metadata | {"trail": [(s.scorer, s.verdict) for s in trail]})


def observed_equivalence() -> FirstDecisive:
    return FirstDecisive((SemanticEquivalence(), ResultSetEquivalence()))


def sql_equivalence_judge(ask) -> Judge:
    """A judge of whether two statements give the same rows on any data."""
    return Judge(
        ask,
        criteria="Two statements are equivalent if they give the same rows whatever the tables hold. How they are written, names and order of columns, and true against 1 make no difference; filters, joins, aggregates or columns that differ do.",
        examples=(
            Example("SELECT city FROM shops WHERE is_open = 1", "SELECT city FROM shops WHERE is_open = TRUE", 1.0, "the filter is the same"),
            Example("SELECT max(price) FROM items", "SELECT min(price) FROM items", 0.0, "another aggregate"),
            Example("WITH s AS (SELECT * FROM shops) SELECT city FROM s", "SELECT city FROM shops", 1.0, "the name for the rows changes nothing"),
        ),
    )


def judged_equivalence(ask) -> FirstDecisive:
    return FirstDecisive((SemanticEquivalence(), sql_equivalence_judge(ask)))
