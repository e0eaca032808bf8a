"""What a run came to: reports collected as cases are asserted, text for people, JSON for programs."""

from __future__ import annotations

import textwrap
from collections.abc import Iterable, Sequence
from typing import Any

from assayer.benchmark import CaseReport, report_json
from assayer.model import ResultDiff, Score

_RUN: list[CaseReport] = []


def record(report: CaseReport) -> CaseReport:
    _RUN.append(report)
    return report


def extend(reports: Iterable[CaseReport]) -> None:
    _RUN.extend(reports)


def reports() -> list[CaseReport]:
    return list(_RUN)


def clear() -> None:
    _RUN.clear()


def run_json() -> str:
    return report_json(_RUN)


def table(rows: Sequence[Sequence[Any]], head: Sequence[str]) -> str:
    """Columns side by side under their heads; cells are cut to 60 characters."""
    cells = [[textwrap.shorten(str(c), 60, placeholder="...") if c != "" else "" for c in row] for row in (head, *rows)]
    width = [max(len(r[k]) for r in cells) for k in range(len(head))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(row, width, strict=True)).rstrip() for row in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])


def diff_text(diff: ResultDiff) -> str:
    """Every part of a difference that there is, samples of rows as tables."""
    parts = []
    if diff.missing_columns:
        parts.append(f"missing columns: {', '.join(diff.missing_columns)}")
    if diff.unexpected_columns:
        parts.append(f"unexpected columns: {', '.join(diff.unexpected_columns)}")
    if diff.order_differs:
        parts.append("columns stand in another order")
    if diff.type_mismatches:
        parts.append(table(diff.type_mismatches, ("column", "expected", "actual")))
    if diff.column_mismatches:
        parts.append(table(diff.column_mismatches, ("column", "rows that differ")))
    for what, n, sample in (("missing", diff.missing_count, diff.missing_sample), ("unexpected", diff.unexpected_count, diff.unexpected_sample)):
        if n or sample:
            names = list(dict.fromkeys(k for row in sample for k in row))
            parts.append(f"{what} rows: {n or len(sample)}" + (f", first {len(sample)}:\n" + table([[repr(row.get(k)) for k in names] for row in sample], names) if sample else ""))
    return "\n".join(parts)


def score_text(score: Score) -> str:
    lines = [f"{score.scorer}: {score.verdict}" + (f" ({score.basis})" if score.basis else "") + (f": {score.explanation}" if score.explanation else "")]
    lines += [textwrap.indent(diff_text(score.diff), "  ")] if score.diff else []
    lines += [f"  {o.expectation.kind} {o.expectation.column or ''}: expected {o.expected}, found {o.actual}" for o in score.outcomes if not o.passed]
    return "\n".join(lines)


def failure_text(report: CaseReport) -> str:
    """A failed case with its statement, its error, and each score that is no pass."""
    lines = [f"case {report.case.id}: {report.outcome}", f"  question: {report.case.input}"]
    lines += [f"  statement: {report.sql}"] if report.sql else []
    lines += [f"  error: {report.error}"] if report.error else []
    lines += [textwrap.indent(score_text(s), "  ") for s in report.scores if s.verdict != "pass"]
    return "\n".join(lines)


def summary(of: Sequence[CaseReport]) -> str:
    """A line for each case, and how many passed."""
    detail = lambda r: r.error or ", ".join(s.scorer for s in r.scores if s.verdict != "pass")
    passed = sum(r.passed for r in of)
    return table([(r.case.id, "PASS" if r.passed else "FAIL", detail(r)) for r in of], ("case", "result", "detail")) + f"\n{passed} passed, {len(of) - passed} failed"
