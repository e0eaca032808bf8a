"""Command line: tests of cases, benchmark files, transformation projects, metric questions, data sets, and whether platforms answer.

Answers come from a JSON file (`--answers`: case id and answer), or from a language model: `--llm package.module:factory` names
what makes an object with `complete(prompt)`.
"""

from __future__ import annotations

import argparse
import importlib
import json
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from assayer import benchmark, reporting
from assayer.model import EvalCase
from assayer.operators.accuracy import BIRD, SPIDER
from assayer.score import ExecutionAccuracy, Expectations
from assayer.semantic.compile import Compiler, MetricQuery
from assayer.semantic.score import metric_layer_equivalence, run_metric_benchmark, strict
from assayer.solvers import MetricSolver, PromptSolver
from assayer.sources import archive, cases, platforms
from assayer.sources.engine import Engine
from assayer.sources.project import Project


class Wrong(Exception):
    """What the user has to put right; printed without a trace."""


def loaded(name: str):
    """What `package.module:attribute` names, called if it is a factory."""
    module, _, attribute = name.partition(":")
    try:
        found = getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError, ValueError) as e:
        raise Wrong(f"{name} can't be loaded: {e}") from e
    return found() if isinstance(found, type) or not hasattr(found, "complete") else found


def answers_of(path: str) -> dict[str, object]:
    """By case id: a list of objects with case_id and sql (or query), or one object."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    return {r["case_id"]: r.get("sql", r.get("query")) for r in raw} if isinstance(raw, list) else raw


def sql_solver(args) -> Callable[[EvalCase], str | None]:
    if bool(args.answers) == bool(args.llm):
        raise Wrong("give either --answers or --llm")
    if args.llm:
        return PromptSolver(loaded(args.llm))
    known = answers_of(args.answers)
    return lambda case: known.get(case.id)


def read_data(path: str):
    """A JSON or YAML file."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8")) if file.suffix == ".json" else platforms.read_yaml(file)


def shown(title: str, reports, args, **more) -> int:
    """Accuracy, then by difficulty where cases have one; the same as JSON if asked for."""
    passed = sum(r.passed for r in reports)
    by: dict[str, list[bool]] = {}
    for r in reports:
        if level := r.case.metadata.get("difficulty"):
            by.setdefault(level, []).append(r.passed)
    print(f"{title}: {100 * passed / max(1, len(reports)):.1f} % ({passed}/{len(reports)})")
    if by:
        print(reporting.table([(k, f"{100 * sum(v) / len(v):.1f} %", f"{sum(v)}/{len(v)}") for k, v in sorted(by.items())], ("difficulty", "accuracy", "passed")))
    if args.json:
        levels = {k: {"total": len(v), "passed": sum(v), "accuracy": sum(v) / len(v)} for k, v in by.items()}
        out = more | {"total": len(reports), "accuracy": passed / max(1, len(reports)), "by_difficulty": levels} | json.loads(benchmark.report_json(reports))
        Path(args.json).write_text(json.dumps(out, indent=2), encoding="utf-8")
    return 0


def run(args, rest: list[str]) -> int:
    """The suite by pytest; further arguments go to it as they are."""
    command = [sys.executable, "-m", "pytest", "-p", "assayer.pytest_plugin", *([args.path] if args.path else []), *([f"--assayer-json={args.json}"] if args.json else []), *rest]
    return subprocess.run(command, check=False).returncode


def bench(args, spark: SparkSession) -> int:
    scorer = ExecutionAccuracy(SPIDER if args.dataset == "spider" else BIRD)
    if args.tables:  # a benchmark file over one folder of Parquet tables
        if not args.path or not args.names:
            raise Wrong("--tables needs a file of cases and --names")
        rows = (cases.spider_cases if args.dataset == "spider" else cases.bird_cases)(spark, args.path)
        todo, engine = cases.as_cases(rows), Engine.over(spark, args.tables, tuple(args.names))
    else:
        known = archive.KNOWN[args.dataset]
        root = Path(args.path) if args.path else archive.cached(known)
        if root is None:
            raise Wrong(f"the data set is not here; run: assayer fetch {args.dataset}")
        todo = list(cases.dataset_cases(str(root), args.split, known.databases, args.dataset))
        registry = platforms.Registry(spark)
        engine = lambda case: registry.engine(platforms.sqlite_platform(f"{args.dataset}:{case.metadata['db_id']}", case.metadata["db_path"]))
    reports = benchmark.run_benchmark(engine, todo, sql_solver(args), (scorer,), args.limit, args.threads)
    return shown(f"EX ({args.dataset})", reports, args, dataset=args.dataset, split=args.split)


def project_of(args) -> Project:
    try:
        return Project.read(str(args.target_dir or Path(args.project_dir) / "target"))
    except (OSError, ValueError) as e:
        raise Wrong(f"the project's artifacts can't be read: {e}") from e


def engine_of(args, spark: SparkSession) -> Engine:
    try:
        return platforms.connect(spark, platforms.platform_from_profile(args.project_dir, args.profiles_dir, args.target))
    except (platforms.ProfileError, platforms.PlatformUnavailable) as e:
        raise Wrong(str(e)) from e


def dbt_bench(args, spark: SparkSession) -> int:
    project = project_of(args)
    if args.mode == "authored" and not args.cases:
        raise Wrong("--mode authored needs --cases")
    todo = {"authored": lambda: project.authored_cases(read_data(args.cases)), "model": project.model_cases, "tests": project.test_cases}[args.mode]()
    scorer = Expectations() if args.mode == "tests" else ExecutionAccuracy(BIRD)
    reports = benchmark.run_benchmark(engine_of(args, spark), todo, sql_solver(args), (scorer,), args.limit, args.threads)
    return shown("EX (dbt)", reports, args, mode=args.mode)


def sl_bench(args, spark: SparkSession) -> int:
    project = project_of(args)
    if project.semantic is None:
        raise Wrong("the project has no semantic manifest")
    made = project.metric_cases(read_data(args.cases))[: args.limit]
    own, compiler = engine_of(args, spark).spark, Compiler(project.semantic)
    if args.answers:
        known = answers_of(args.answers)
        solve = lambda case: MetricQuery(**{k: tuple(v) if isinstance(v, list) else v for k, v in known[case.id].items()})
    elif args.llm:
        names = {case.id: n for case, n in made}
        solve = lambda case: MetricSolver(loaded(args.llm), names[case.id])(case)
    else:
        raise Wrong("give either --answers or --llm")
    grader = args.grader or args.llm
    scorers = strict(compiler) if args.no_judge or not grader else metric_layer_equivalence(compiler, loaded(grader))
    found = run_metric_benchmark(own, [case for case, _ in made], solve, scorers)
    passed = sum(s.verdict == "pass" for _, s in found)
    print(f"SL accuracy: {100 * passed / max(1, len(found)):.1f} % ({passed}/{len(found)})")
    if args.json:
        rows = [{"id": i, "scorer": s.scorer, "verdict": s.verdict, "basis": s.basis, "score": s.score, "explanation": s.explanation} for i, s in found]
        Path(args.json).write_text(json.dumps({"total": len(found), "passed": passed, "accuracy": passed / max(1, len(found)), "cases": rows}, indent=2), encoding="utf-8")
    return 0


def fetch(args) -> int:
    try:
        print(f"cached at: {archive.install(archive.KNOWN[args.dataset], args.archive, args.cache_dir, args.force, args.trust)}")
    except (OSError, RuntimeError) as e:
        raise Wrong(str(e)) from e
    return 0


def doctor(args, spark: SparkSession) -> int:
    """Spark itself, then each platform that is named; a platform that does not answer is said with its reason."""
    asked = [platforms.spark_platform("spark", args.catalog, args.schema)]
    asked += [platforms.sqlite_platform("sqlite", args.sqlite)] if args.sqlite else []
    asked += [platforms.duckdb_platform("duckdb", args.duckdb)] if args.duckdb else []
    asked += [platforms.postgres_platform("postgres", args.postgres)] if args.postgres else []
    good = True
    for platform in asked:
        try:
            ok, why = platforms.connect(spark, platform).healthy(), ""
        except platforms.PlatformUnavailable as e:
            ok, why = False, str(e)
        good &= ok
        print(f"{platform.name}: {'OK' if ok else 'FAIL'}" + (f" ({why})" if why else ""))
    return int(not good)


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="assayer", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, solved: bool = False, project: bool = False):
        c = commands.add_parser(name, help=help_)
        if project:
            c.add_argument("project_dir")
            for option in ("--target-dir", "--profiles-dir", "--target", "--cases"):
                c.add_argument(option)
        if solved:
            for option in ("--answers", "--llm", "--json"):
                c.add_argument(option)
            c.add_argument("--limit", type=int)
            c.add_argument("--threads", type=int, default=1)
        return c

    c = command("run", "run the cases of a test suite")
    c.add_argument("path", nargs="?")
    c.add_argument("--json")
    c = command("bench", "score answers to a benchmark", solved=True)
    c.add_argument("dataset", choices=sorted(archive.KNOWN))
    c.add_argument("path", nargs="?", help="the unpacked data set, or with --tables a file of cases")
    c.add_argument("--split", default="dev")
    c.add_argument("--tables", help="folder of Parquet tables instead of the data set's databases")
    c.add_argument("--names", nargs="+")
    c = command("dbt-bench", "score answers to a transformation project's questions", solved=True, project=True)
    c.add_argument("--mode", choices=["authored", "model", "tests"], default="authored")
    c = command("sl-bench", "score metric queries of a project's semantic layer", solved=True, project=True)
    c.add_argument("--grader")
    c.add_argument("--no-judge", action="store_true")
    c = command("fetch", "get a data set, check it and keep it")
    c.add_argument("dataset", choices=sorted(archive.KNOWN))
    c.add_argument("--archive", help="a file that is here already")
    c.add_argument("--cache-dir")
    c.add_argument("--force", action="store_true")
    c.add_argument("--trust", action="store_true")
    c = command("doctor", "ask each platform for a value")
    for option in ("--catalog", "--schema", "--sqlite", "--duckdb", "--postgres"):
        c.add_argument(option)
    return parser


def main(argv: list[str] | None = None) -> int:
    args, rest = arguments().parse_known_args(argv)
    if rest and args.command != "run":
        arguments().error(f"unknown arguments: {' '.join(rest)}")
    try:
        if args.command == "run":
            return run(args, rest)
        if args.command == "fetch":
            return fetch(args)
        spark = SparkSession.builder.getOrCreate()
        return {"bench": bench, "dbt-bench": dbt_bench, "sl-bench": sl_bench, "doctor": doctor}[args.command](args, spark)
    except (Wrong, platforms.ProfileError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
