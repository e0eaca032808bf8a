"""Semantic models and metrics, as parsed from a semantic manifest."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

#: Manifest settings that are read but not supported.
UNSUPPORTED = ("window", "grain_to_date", "offset_window", "offset_to_grain", "conversion_type_params", "non_additive_dimension", "join_to_timespine", "fill_nulls_with", "validity_params")


@dataclass(frozen=True)
class Entity:
    name: str
    kind: str  # primary, unique or foreign
    expr: str


@dataclass(frozen=True)
class Dimension:
    name: str
    kind: str  # categorical or time
    expr: str
    grain: str = "day"


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    expr: str
    time: str | None
    create_metric: bool = False


@dataclass(frozen=True)
class SemanticModel:
    name: str
    table: str
    entities: tuple[Entity, ...]
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...] = ()
    description: str = ""

    def dimension(self, name: str) -> Dimension | None:
        return next((d for d in self.dimensions if d.name == name), None)

    def entity(self, name: str) -> Entity | None:
        return next((e for e in self.entities if e.name == name), None)


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str  # simple, ratio, derived or cumulative
    measure: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    expr: str | None = None
    inputs: tuple[tuple[str, str], ...] = ()  # metric and the name it has in expr
    filters: tuple[str, ...] = ()
    period_agg: str | None = None


@dataclass
class Manifest:
    models: dict[str, SemanticModel] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)

    def __post_init__(self):
        for m in self.models.values():
            for x in m.measures:
                if x.create_metric:
                    self.metrics.setdefault(x.name, Metric(x.name, "simple", measure=x.name))

    def measure(self, name: str) -> tuple[SemanticModel, Measure]:
        for m in self.models.values():
            for x in m.measures:
                if x.name == name:
                    return m, x
        raise KeyError(f"no measure {name}")

    @classmethod
    def read(cls, path: str) -> Manifest:
        with open(path, encoding="utf-8") as f:
            return cls.parse(json.load(f))

    @classmethod
    def parse(cls, raw: dict) -> Manifest:
        models = {m["name"]: _model(m) for m in raw.get("semantic_models", [])}
        return cls(models, {m["name"]: _metric(m) for m in raw.get("metrics", [])})


def _refuse(node: dict, where: str) -> None:
    if used := [k for k in UNSUPPORTED if node.get(k)]:
        raise NotImplementedError(f"{where}: {', '.join(used)} not supported")


def _model(m: dict) -> SemanticModel:
    default = (m.get("defaults") or {}).get("agg_time_dimension")
    for x in [*m.get("measures", []), *m.get("dimensions", [])]:
        _refuse(x, f"{m['name']}.{x['name']}")
    grain = lambda d: ((d.get("type_params") or {}).get("time_granularity") or "day").lower()
    return SemanticModel(
        m["name"],
        (m.get("node_relation") or {}).get("alias") or m["name"],
        tuple(Entity(e["name"], e["type"].lower(), e.get("expr") or e["name"]) for e in m.get("entities", [])),
        tuple(Dimension(d["name"], d["type"].lower(), d.get("expr") or d["name"], grain(d)) for d in m.get("dimensions", [])),
        tuple(Measure(x["name"], x["agg"].lower(), x.get("expr") or x["name"], x.get("agg_time_dimension") or default, bool(x.get("create_metric"))) for x in m.get("measures", [])),
        m.get("description") or "",
    )


def _filters(node: dict | None) -> tuple[str, ...]:
    if not node:
        return ()
    if isinstance(node, str):
        return (node,)
    return tuple(w["where_sql_template"] for w in node.get("where_filters", []))


def _metric(m: dict) -> Metric:
    p = m.get("type_params") or {}
    name = lambda x: x if isinstance(x, str) or x is None else x["name"]
    _refuse(p, m["name"])
    cumulative = p.get("cumulative_type_params") or {}
    _refuse(cumulative, m["name"])
    for x in [p.get("measure"), p.get("numerator"), p.get("denominator"), *(p.get("metrics") or [])]:
        if isinstance(x, dict):
            _refuse(x, m["name"])
    inputs = tuple((name(x), (x.get("alias") if isinstance(x, dict) else None) or name(x)) for x in p.get("metrics") or [])
    own = _filters(m.get("filter")) + (_filters(p["measure"].get("filter")) if isinstance(p.get("measure"), dict) else ())
    return Metric(m["name"], m["type"].lower(), name(p.get("measure")), name(p.get("numerator")), name(p.get("denominator")), p.get("expr"), inputs, own, cumulative.get("period_agg"))


_REFERENCE = re.compile(r"\{\{\s*(Dimension|TimeDimension|Entity)\(\s*'([^']+)'\s*(?:,\s*'([^']+)'\s*)?\)(?:\.grain\('([^']+)'\))?\s*\}\}")


def references(template: str) -> list[tuple[str, str]]:
    """Each placeholder of a filter and the group-by name that it stands for."""
    return [(m[0], m[2] + (f"__{m[3] or m[4]}" if m[3] or m[4] else "")) for m in _REFERENCE.finditer(template)]
