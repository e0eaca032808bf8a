"""Cases as tests: `pytest -p assayer.pytest_plugin`. The `case` fixture, a summary at the end, and the run as JSON."""

from __future__ import annotations

import pickle
from pathlib import Path

import pytest

from assayer import reporting
from assayer.sources.cases import case_of

SHIPPED = "assayer_reports"


def pytest_addoption(parser: pytest.Parser) -> None:
    parser.getgroup("assayer").addoption("--assayer-json", metavar="PATH", help="write the run's reports as JSON")


@pytest.fixture
def case(request: pytest.FixtureRequest):
    """The case that `@eval_case(...)` attached to the test."""
    found = case_of(request.function)
    if found is None:
        raise pytest.UsageError(f"{request.function.__name__} asks for a case but has no @eval_case(...)")
    return found


def pytest_terminal_summary(terminalreporter, exitstatus: int, config: pytest.Config) -> None:
    if not hasattr(config, "workerinput") and (found := reporting.reports()):
        terminalreporter.write_sep("=", "cases")
        for line in reporting.summary(found).splitlines():
            terminalreporter.write_line(line)


def pytest_sessionfinish(session: pytest.Session, exitstatus: int) -> None:
    """Workers of a distributed run hand their reports over; the main process writes them."""
    if (out := getattr(session.config, "workeroutput", None)) is not None:
        out[SHIPPED] = pickle.dumps(reporting.reports()).hex()
    elif path := session.config.getoption("--assayer-json"):
        Path(path).write_text(reporting.run_json(), encoding="utf-8")


@pytest.hookimpl(optionalhook=True)
def pytest_testnodedown(node, error) -> None:
    if shipped := getattr(node, "workeroutput", {}).get(SHIPPED):
        reporting.extend(pickle.loads(bytes.fromhex(shipped)))  # noqa: S301 - from a process of this run
