import json

import pytest

from assayer.catalog_semantic import MANIFEST
from assayer.sources.project import Project, ProjectError

NODES = {
    "model.p.customers": {"resource_type": "model", "name": "customers", "relation_name": "main.customers", "description": "One row a customer", "compiled_code": "SELECT 1 AS id", "columns": {"id": {"name": "id", "data_type": "int", "description": "its key"}}},
    "test.p.a": {"resource_type": "test", "test_metadata": {"name": "not_null", "kwargs": {"column_name": "id"}}, "attached_node": "model.p.customers"},
    "test.p.b": {"resource_type": "test", "test_metadata": {"name": "unique"}, "column_name": "id", "depends_on": {"nodes": ["model.p.customers"]}},
    "test.p.c": {"resource_type": "test", "test_metadata": {"name": "relationships"}, "attached_node": "model.p.customers"},
}


@pytest.fixture
def target(tmp_path):
    sources = {"source.p.raw.orders": {"resource_type": "source", "name": "orders", "columns": {}}}
    (tmp_path / "manifest.json").write_text(json.dumps({"metadata": {"dbt_schema_version": "https://x/manifest/v12.json"}, "nodes": NODES, "sources": sources}))
    (tmp_path / "catalog.json").write_text(json.dumps({"sources": {"source.p.raw.orders": {"columns": {"b": {"name": "b", "type": "TEXT", "index": 2}, "a": {"name": "a", "type": "INT", "index": 1}}}}}))
    (tmp_path / "semantic_manifest.json").write_text(json.dumps(MANIFEST))
    return tmp_path


def test_project(target):
    project = Project.read(str(target))
    assert project.table("orders").columns == (("a", "INT"), ("b", "TEXT")) and project.table("model.p.customers").relation == "main.customers"
    assert project.context(["customers"]) == "-- One row a customer\nCREATE TABLE main.customers (\n  id int  -- its key\n);"
    assert [c.expected.sql for c in project.model_cases()] == ["SELECT 1 AS id"]
    (suite,) = project.test_cases()
    assert [(e.kind, e.column) for e in suite.expected.expectations] == [("not_null", "id"), ("unique", "id")]
    assert project.authored_cases([{"question": "q", "gold_sql": "SELECT 1", "select": ["orders"]}])[0].metadata["context"].startswith("CREATE TABLE orders")
    ((case, names),) = project.metric_cases([{"question": "q", "metrics": ["revenue"], "group_by": ["metric_time__month"]}])
    assert case.gold.metrics == ("revenue",) and "customer__segment" in names
    with pytest.raises(KeyError):
        project.table("nothing")
    assert project.context().startswith("CREATE TABLE orders (\n  a INT,\n  b TEXT\n);\n\n-- One row") and project.context(sources=False, models=False) == ""
    assert "model orders\n  entities: order (primary), customer (foreign)\n  dimensions: ordered_at (time by day)" in project.semantic_context()


def test_old_manifests_are_refused(target):
    (target / "manifest.json").write_text(json.dumps({"metadata": {"dbt_schema_version": "https://x/manifest/v9.json"}}))
    for text, kind in (("v9.json", "unsupported_schema_version"), (None, "artifact_invalid")):
        (target / "manifest.json").write_text(json.dumps({"metadata": {"dbt_schema_version": text}}))
        with pytest.raises(ProjectError) as e:
            Project.read(str(target))
        assert e.value.kind == kind
    (target / "manifest.json").write_text("[")
    with pytest.raises(ProjectError, match="can't be read"):
        Project.read(str(target))
    with pytest.raises(ProjectError) as e:
        Project.read(str(target / "nowhere"))
    assert e.value.kind == "target_not_found"
