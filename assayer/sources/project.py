"""A transformation project's artifacts: its tables and columns, its tests, its semantic models, and cases made from them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from assayer.model import EvalCase, Expectation, ExpectationSuite, GoldQuery
from assayer.semantic.compile import Compiler, MetricQuery
from assayer.semantic.manifest import Manifest
from assayer.semantic.score import MetricCase

OLDEST = 10  # schema version of the manifest


@dataclass(frozen=True)
class Table:
    uid: str
    name: str
    kind: str  # model or source
    relation: str
    columns: tuple[tuple[str, str | None], ...]
    description: str = ""
    sql: str | None = None
    notes: tuple[tuple[str, str], ...] = ()  # descriptions of columns

    def ddl(self) -> str:
        """A statement with a line for each column, and what is written about table and columns as comments."""
        notes, last = dict(self.notes), len(self.columns) - 1
        lines = [f"  {n}{f' {t}' if t else ''}{',' if k < last else ''}{f'  -- {notes[n]}' if notes.get(n) else ''}" for k, (n, t) in enumerate(self.columns)]
        return "\n".join([*([f"-- {self.description}"] if self.description else []), f"CREATE TABLE {self.relation} (", *lines, ");"])


class ProjectError(ValueError):
    """kind: target_not_found, artifact_invalid or unsupported_schema_version."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Check:
    table: str
    expectation: Expectation


@dataclass
class Project:
    tables: dict[str, Table] = field(default_factory=dict)
    checks: list[Check] = field(default_factory=list)
    semantic: Manifest | None = None

    @classmethod
    def read(cls, target: str) -> Project:
        """manifest.json of a folder, with catalog.json and semantic_manifest.json where they are there."""
        raw = _json(target, "manifest.json")
        said = (raw.get("metadata") or {}).get("dbt_schema_version")
        if not isinstance(said, str):
            raise ProjectError("artifact_invalid", "manifest.json does not say its schema version")
        version = re.search(r"v(\d+)(\.json)?$", said)
        if not version or int(version[1]) < OLDEST:
            raise ProjectError("unsupported_schema_version", f"manifest version {said} is older than {OLDEST} or none")
        catalog = _json(target, "catalog.json", {})
        known = {**catalog.get("nodes", {}), **catalog.get("sources", {})}
        project = cls()
        for uid, n in {**raw.get("nodes", {}), **raw.get("sources", {})}.items():
            kind = n.get("resource_type")
            if kind in ("model", "source", "seed", "snapshot"):
                project.tables[uid] = Table(uid, n["name"], "source" if kind == "source" else "model", n.get("relation_name") or n.get("alias") or n["name"], _columns(n, known.get(uid)), n.get("description") or "", n.get("compiled_code"), tuple((c["name"], c["description"]) for c in n.get("columns", {}).values() if c.get("description")))
            elif kind == "test" and (meta := n.get("test_metadata") or {}).get("name") in ("not_null", "unique"):
                owner = n.get("attached_node") or next(iter(n.get("depends_on", {}).get("nodes", [])), "")
                project.checks.append(Check(owner, Expectation(meta["name"], (meta.get("kwargs") or {}).get("column_name") or n.get("column_name"))))
        semantic = _json(target, "semantic_manifest.json", None)
        project.semantic = Manifest.parse(semantic) if semantic else None
        return project

    def table(self, name: str) -> Table:
        """By unique id, or by a name that one table has."""
        if name in self.tables:
            return self.tables[name]
        found = [t for t in self.tables.values() if t.name == name]
        if len(found) != 1:
            raise KeyError(f"{len(found)} tables are named {name}")
        return found[0]

    def context(self, select: list[str] | None = None, sources: bool = True, models: bool = True) -> str:
        """The tables as text for a prompt, sources first; `select`: only these, by name or unique id."""
        kinds = [k for k, wanted in (("source", sources), ("model", models)) if wanted]
        chosen = [self.table(n) for n in select] if select is not None else list(self.tables.values())
        return "\n\n".join(t.ddl() for kind in kinds for t in chosen if t.kind == kind)

    def semantic_context(self) -> str:
        """Metrics, and each semantic model's entities, dimensions and measures, as text for a prompt."""
        if self.semantic is None:
            return ""
        lines = ["metrics: " + ", ".join(f"{m.name} ({m.kind})" for m in self.semantic.metrics.values())]
        for model in self.semantic.models.values():
            lines += [f"model {model.name}", "  entities: " + ", ".join(f"{e.name} ({e.kind})" for e in model.entities)]
            lines += ["  dimensions: " + ", ".join(f"{d.name} ({d.kind}{f' by {d.grain}' if d.kind == 'time' else ''})" for d in model.dimensions)] if model.dimensions else []
            lines += ["  measures: " + ", ".join(f"{m.name} ({m.agg})" for m in model.measures)] if model.measures else []
        return "\n".join(lines)

    # Cases

    def authored_cases(self, cases: list[dict]) -> list[EvalCase]:
        """Of `question`, `gold_sql` and, if given, `select` and `id`."""
        return [EvalCase(c.get("id") or f"case-{k}", c["question"], GoldQuery(c["gold_sql"]), metadata={"context": self.context(c.get("select"))}) for k, c in enumerate(cases)]

    def model_cases(self) -> list[EvalCase]:
        """Models with a description and compiled SQL: the one asks and the other answers."""
        return [EvalCase(t.name, t.description, GoldQuery(t.sql), metadata={"context": self.context()}) for t in self.tables.values() if t.kind == "model" and t.description and t.sql]

    def test_cases(self) -> list[EvalCase]:
        """The tests of each table as a suite over it."""
        suites: dict[str, list[Expectation]] = {}
        for c in self.checks:
            suites.setdefault(c.table, []).append(c.expectation)
        return [EvalCase(f"{self.tables[t].name}-tests", f"SELECT * FROM {self.tables[t].relation}", ExpectationSuite(tuple(e)), metadata={"context": self.context()}) for t, e in suites.items() if t in self.tables]

    def metric_cases(self, cases: list[dict]) -> list[tuple[MetricCase, list[str]]]:
        """Of `question` and a metric query's parts, each with the names its metrics can all be grouped by."""
        compiler, out = Compiler(self.semantic), []
        for k, c in enumerate(cases):
            query = MetricQuery(tuple(c["metrics"]), tuple(c.get("group_by", ())), tuple(c.get("where", ())), tuple(c.get("order_by", ())), c.get("limit"))
            names = set.intersection(*[set(compiler.group_by_items(m)) for m in query.metrics])
            out.append((MetricCase(c.get("id") or f"case-{k}", c["question"], query), sorted(names)))
        return out


_REQUIRED = object()


def _json(folder: str, name: str, default=_REQUIRED):
    path = Path(folder) / name
    if not path.is_file():
        if default is _REQUIRED:
            raise ProjectError("target_not_found", f"no {name} in {folder}")
        return default
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ProjectError("artifact_invalid", f"{path} can't be read: {e}") from e
    if not isinstance(found, dict):
        raise ProjectError("artifact_invalid", f"{path} is no JSON object")
    return found


def _columns(node: dict, catalog: dict | None) -> tuple[tuple[str, str | None], ...]:
    """Of the catalog in its order, else of the manifest."""
    if catalog:
        return tuple((c["name"], c.get("type")) for c in sorted(catalog["columns"].values(), key=lambda c: c.get("index", 0)))
    return tuple((c["name"], c.get("data_type")) for c in node.get("columns", {}).values())
