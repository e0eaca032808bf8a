"""Databases as sources, platforms, profiles, archives, reports, the plugin and the command line."""

import hashlib
import json
import sqlite3
import subprocess
import sys
import zipfile

import duckdb
import pytest

from assayer import cli, reporting
from assayer.benchmark import CaseReport
from assayer.catalog_semantic import MANIFEST
from assayer.model import EvalCase, Expectation, GoldQuery, Outcome, ResultDiff, Rows, Score
from assayer.pydantic_evals import judge_sql
from assayer.sources import archive, cases, platforms
from assayer.sources.databases import sqlite_ddl
from assayer.sources.engine import Engine


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "shop.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, name TEXT, price REAL, mixed, raw BLOB, none DECIMAL)")
        con.executemany("INSERT INTO items VALUES (?, ?, ?, ?, ?, NULL)", [(k, None if k % 7 == 0 else f"n'{k}", k / 4 if k % 2 else k, k if k % 3 else f"t{k}", bytes([k % 256])) for k in range(1, 1001)])
        con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
        con.execute("INSERT INTO keyed VALUES ('a', 1), ('b', 2)")
        con.execute('CREATE TABLE "odd ""name" (x INT)')
        con.execute("CREATE VIEW cheap AS SELECT id FROM items WHERE price < 10")
    return path


def test_sqlite(spark, shop):
    engine = platforms.connect(spark, platforms.sqlite_platform("shop", shop))
    items = engine.spark.table("items")
    assert dict(items.dtypes) == {"id": "bigint", "name": "string", "price": "double", "mixed": "string", "raw": "binary", "none": "double"}
    assert items.rdd.getNumPartitions() == 8
    with sqlite3.connect(shop) as con:
        want = [(i, n, float(p), str(m), bytes(r), None) for i, n, p, m, r in con.execute("SELECT id, name, price, mixed, raw FROM items")]
    assert sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in items.collect()) == sorted(want)
    assert engine.scalar("SELECT sum(v) FROM keyed") == (3, None) and engine.scalar("SELECT count(*) FROM `odd \"name`") == (0, None)
    assert engine.scalar("SELECT count(*) FROM cheap JOIN items USING (id)")[0] == sum(1 for r in want if r[2] < 10)
    assert sqlite_ddl(shop).startswith("CREATE TABLE items") and "WITHOUT ROWID" in sqlite_ddl(shop)


def test_duckdb(spark, tmp_path):
    path = str(tmp_path / "d.duckdb")
    with duckdb.connect(path) as con:
        con.execute("CREATE TABLE t AS SELECT range AS id, range % 3 AS g, 'x' || range AS s, range::DECIMAL(10, 2) / 4 AS p, DATE '2024-01-01' + range::INT AS d FROM range(5000)")
        con.execute("CREATE VIEW v AS SELECT g, count(*) AS n FROM t GROUP BY g")
        want = con.execute("SELECT g, count(*), sum(p), max(d) FROM t GROUP BY g ORDER BY g").fetchall()
    engine = platforms.connect(spark, platforms.duckdb_platform("d", path))
    got = engine.execute("SELECT g, count(*) AS n, sum(p) AS p, max(d) AS d FROM t GROUP BY g ORDER BY g").df.collect()
    assert [(r["g"], r["n"], float(r["p"]), r["d"]) for r in got] == [(g, n, float(p), d) for g, n, p, d in want]
    assert engine.scalar("SELECT sum(n) FROM v")[0] == 5000


def test_unreachable_platforms_say_so(spark, tmp_path):
    for p in (platforms.sqlite_platform("a", str(tmp_path / "none.sqlite")), platforms.postgres_platform("b", "host=localhost dbname=x", ("t",)), platforms.snowflake_platform("c", "acc", ("t",)), platforms.bigquery_platform("d", "proj", ("t",)), platforms.spark_platform("e", schema="no_such_schema")):
        with pytest.raises(platforms.PlatformUnavailable, match=p.name):
            platforms.connect(spark, p)
    assert platforms.jdbc_options("postgresql://u:p@h:1/db?x=1") == {"url": "jdbc:postgresql://h:1/db", "user": "u", "driver": "org.postgresql.Driver", "password": "p"}
    assert platforms.jdbc_options("host=h port=7 dbname=d user=u")["url"] == "jdbc:postgresql://h:7/d"


def test_registry(spark, shop):
    registry = platforms.Registry(spark)
    one = platforms.sqlite_platform("shop", shop)
    assert registry.engine(one) is registry.engine(platforms.sqlite_platform("shop", shop))
    with pytest.raises(ValueError):
        registry.engine(platforms.sqlite_platform("shop", shop + "2"))
    registry.close_all()
    assert registry.engine(one).healthy()


def test_pools(spark, shop):
    opened = []

    def open_():
        opened.append(platforms.connect(spark, platforms.sqlite_platform("shop", shop)))
        return opened[-1]

    pool = platforms.Pool(open_, size=2, wait=0.2)
    one, two = pool.acquire(), pool.acquire()
    assert one is not two and one.spark is not two.spark
    with pytest.raises(platforms.PlatformUnavailable, match="came free"):
        pool.acquire()
    pool.release(one)
    with pool.lease() as again:
        assert again is one and len(opened) == 2
    one.healthy = lambda: False  # lost: replaced by another one
    with pool.lease() as fresh:
        assert fresh is not one and len(opened) == 3
    with pytest.raises(ValueError):
        pool.release(one)
    pool.close()
    pool.release(two)
    assert two.spark.catalog.listTables() == []
    with pytest.raises(platforms.PlatformUnavailable, match="closed"):
        pool.acquire()
    broken = platforms.Pool(lambda: 1 / 0, size=1, wait=0.2)
    for _ in range(2):  # a failure to open takes no place
        with pytest.raises(ZeroDivisionError):
            broken.acquire()
    aged = platforms.Pool(open_, size=1, max_age=0.0)
    first = aged.acquire()
    aged.release(first)
    assert aged.acquire() is not first
    registry = platforms.Registry(spark)
    at = platforms.sqlite_platform("shop", shop)
    assert registry.pool(at).size == 1 and registry.pool(at) is registry.pool(at)
    with registry.pool(at).lease() as engine:
        assert engine.healthy()
    with pytest.raises(ValueError):
        registry.engine(platforms.sqlite_platform("shop", "elsewhere"))


def project(tmp_path, kind="duckdb"):
    (tmp_path / "dbt_project.yml").write_text("name: p\nprofile: shop\n")
    (tmp_path / "profiles.yml").write_text(f"shop:\n  target: dev\n  outputs:\n    dev: {{type: {kind}, path: db.duckdb, host: h, dbname: d, user: u, password: secret}}\n    other: {{type: oracle}}\n")
    return tmp_path


def test_profiles(tmp_path):
    at = project(tmp_path)
    assert platforms.platform_from_profile(at) == platforms.duckdb_platform("dbt:shop:dev", str(at / "db.duckdb"))
    for target, kind in (("other", "unsupported_adapter"), ("nothing", "profile_not_found")):
        with pytest.raises(platforms.ProfileError) as e:
            platforms.platform_from_profile(at, target=target)
        assert e.value.kind == kind
    assert platforms.platform_from_profile(project(tmp_path, "postgres")).option("conninfo") == "host=h dbname=d user=u"
    with pytest.raises(platforms.ProfileError):
        platforms.platform_from_profile(tmp_path / "nowhere")


@pytest.fixture
def bundle(tmp_path):
    """An archive as the official ones are, with one case that is right and one that is wrong when answered by its first half."""
    inner = tmp_path / "inner"
    (inner / "dev_databases" / "d").mkdir(parents=True)
    with sqlite3.connect(inner / "dev_databases" / "d" / "d.sqlite") as con:
        con.execute("CREATE TABLE t (a INT, b TEXT)")
        con.execute("INSERT INTO t VALUES (1, 'x'), (2, 'y')")
    records = [{"db_id": "d", "question": "q?", "evidence": "e", "SQL": "SELECT a FROM t", "question_id": 7, "difficulty": "simple"}, {"db_id": "d", "question": "r?", "SQL": "SELECT b FROM t", "question_id": 8, "difficulty": "simple"}]
    nested = tmp_path / "dev_databases.zip"
    with zipfile.ZipFile(nested, "w") as z:
        z.write(inner / "dev_databases" / "d" / "d.sqlite", "dev_databases/d/d.sqlite")
    file = tmp_path / "dev.zip"
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("dev_1/dev.json", json.dumps(records))
        z.writestr("__MACOSX/dev.json", "[]")
        z.write(nested, "dev_1/dev_databases.zip")
    return file, archive.DataSet("bird", "https://nowhere", hashlib.sha256(file.read_bytes()).hexdigest(), 2, "dev_databases", True)


def test_archives(bundle, tmp_path):
    from dataclasses import replace

    file, known = bundle
    at = archive.install(known, file, tmp_path / "cache")
    assert archive.cached(known, tmp_path / "cache") == at == archive.install(known, None, tmp_path / "cache", get=None)
    first, second = cases.dataset_cases(str(at), "dev", "dev_databases", "bird")
    assert (first.id, first.input, first.metadata["difficulty"]) == ("bird/d/7", "q?\nEvidence: e", "simple") and second.metadata["context"].startswith("CREATE TABLE t")
    for wrong in (replace(known, sha256="0"), replace(known, cases=3), replace(known, sha256=None), replace(known, databases="x", nested=False)):
        with pytest.raises(RuntimeError):
            archive.install(wrong, file, tmp_path / "other")
    assert archive.cached(known, tmp_path / "other") is None
    (tmp_path / "page.zip").write_text("<html>")
    with pytest.raises(RuntimeError, match="no zip"):
        archive.install(replace(known, sha256=None), tmp_path / "page.zip", tmp_path / "other", trust=True)


def test_bench_command(spark, bundle, tmp_path, monkeypatch, capsys):
    file, known = bundle
    monkeypatch.setitem(archive.KNOWN, "bird", known)
    monkeypatch.setenv("ASSAYER_CACHE_DIR", str(tmp_path / "cache"))
    (tmp_path / "answers.json").write_text(json.dumps([{"case_id": "bird/d/7", "sql": "SELECT a FROM t ORDER BY a"}, {"case_id": "bird/d/8", "sql": "SELECT a FROM t"}]))
    asked = ["bench", "bird", "--answers", str(tmp_path / "answers.json"), "--json", str(tmp_path / "out.json")]
    assert cli.main(asked) == 1 and "assayer fetch bird" in capsys.readouterr().err
    assert cli.main(["fetch", "bird", "--archive", str(file)]) == 0
    assert cli.main(asked) == 0
    assert "EX (bird): 50.0 % (1/2)" in capsys.readouterr().out
    out = json.loads((tmp_path / "out.json").read_text())
    assert out["by_difficulty"] == {"simple": {"total": 2, "passed": 1, "accuracy": 0.5}} and [c["outcome"] for c in out["cases"]] == ["passed", "scored_failure"]


class Llm:
    def complete(self, prompt):
        if "metric query" in prompt and "Reference" not in prompt:
            return '{"metrics": ["orders"], "group_by": ["order_status"]}'
        return '{"score": 0.9, "reason": "near"}' if "score" in prompt else "SELECT count(*) AS n FROM orders"


def test_project_commands(spark, tmp_path, capsys):
    at = project(tmp_path)
    with duckdb.connect(str(at / "db.duckdb")) as con:
        for t in ("orders", "customer", "nation", "lineitem"):
            con.execute(f"CREATE TABLE {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    (at / "target").mkdir()
    nodes = {"model.p.n": {"resource_type": "model", "name": "n", "description": "How many orders?", "compiled_code": "SELECT count(o_orderkey) AS n FROM orders"}}
    (at / "target" / "manifest.json").write_text(json.dumps({"metadata": {"dbt_schema_version": "https://x/manifest/v12.json"}, "nodes": nodes}))
    (at / "target" / "semantic_manifest.json").write_text(json.dumps(MANIFEST))
    llm = f"{__name__}:Llm"
    assert cli.main(["dbt-bench", str(at), "--mode", "model", "--llm", llm, "--json", str(at / "out.json")]) == 0
    assert "EX (dbt): 100.0 % (1/1)" in capsys.readouterr().out, (at / "out.json").read_text()
    (at / "cases.yml").write_text("- question: how many?\n  gold_sql: SELECT 1 AS n\n")
    assert cli.main(["dbt-bench", str(at), "--cases", str(at / "cases.yml"), "--llm", llm]) == 0
    assert "(0/1)" in capsys.readouterr().out
    (at / "metrics.yml").write_text("- {question: orders by status, metrics: [orders], group_by: [order__order_status]}\n- {question: revenue, metrics: [revenue]}\n")
    assert cli.main(["sl-bench", str(at), "--cases", str(at / "metrics.yml"), "--llm", llm, "--no-judge", "--json", str(at / "out.json")]) == 0
    assert "SL accuracy: 50.0 % (1/2)" in capsys.readouterr().out
    assert [c["basis"] for c in json.loads((at / "out.json").read_text())["cases"]] == ["proven", "observed"]
    assert cli.main(["dbt-bench", str(at), "--llm", llm]) == 1 and cli.main(["dbt-bench", str(at / "none"), "--mode", "model", "--llm", llm]) == 1


def test_doctor(spark, shop, capsys):
    assert cli.main(["doctor", "--sqlite", shop]) == 0
    assert cli.main(["doctor", "--postgres", "host=localhost dbname=x"]) == 1
    out = capsys.readouterr().out
    assert "sqlite: OK" in out and "postgres: FAIL (" in out


def test_reports():
    case = EvalCase("c", "q?", GoldQuery("SELECT 1"))
    diff = ResultDiff(2, 1, ({"a": 1, "b": "x"},), (), ("m",), ("u",), (("a", "int", "bigint"),), (("b", 3),), True)
    bad = Score("s", "fail", 0.0, "observed", "differs", diff, (Outcome(Expectation("unique", "a"), False, "0", "2", 2),))
    report = CaseReport(case, "scored_failure", "SELECT 2", (bad,))
    text = reporting.failure_text(report)
    for part in ("case c: scored_failure", "SELECT 2", "s: fail (observed): differs", "missing columns: m", "unexpected columns: u", "another order", "missing rows: 2, first 1:", "unexpected rows: 1", "unique a: expected 0, found 2", "rows that differ"):
        assert part in text
    assert reporting.summary([report, CaseReport(case, "solver_failure", error="no idea")]).endswith("0 passed, 2 failed")
    for wrong in (("passed", None, (bad,), None), ("scored_failure", None, (), None), ("solver_failure", None, (), None), ("execution_failure", "x", (), ""), ("solver_failure", "x", (), "e"), ("other", None, (), "e")):
        with pytest.raises(ValueError):
            CaseReport(case, *wrong)


def test_plugin(tmp_path):
    (tmp_path / "test_cases.py").write_text(
        "from assayer.model import GoldQuery\nfrom assayer.sources.cases import eval_case\nfrom assayer import benchmark\nfrom assayer.sources.engine import Engine\nfrom pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "@eval_case(input='one?', expected=GoldQuery('SELECT 1 AS n'))\ndef test_one(case):\n    benchmark.assert_eval(Engine(spark), case, lambda c: 'SELECT 1 AS n')\n"
        "@eval_case(input='two?', expected=GoldQuery('SELECT 2 AS n'))\ndef test_two(case):\n    benchmark.assert_eval(Engine(spark), case, lambda c: 'SELECT 1 AS n')\n"
        "def test_three(case):\n    pass\n"
    )
    done = subprocess.run([sys.executable, "-m", "assayer.cli", "run", str(tmp_path), "--json", str(tmp_path / "out.json"), "-q", "-p", "no:cacheprovider"], capture_output=True, text=True, timeout=120)
    assert done.returncode == 1 and "1 passed, 1 failed" in done.stdout and "has no @eval_case" in done.stdout
    out = json.loads((tmp_path / "out.json").read_text())
    assert [(c["id"], c["outcome"]) for c in out["cases"]] == [("test_one", "passed"), ("test_two", "scored_failure")]


def test_verdicts_for_frameworks(spark):
    engine = Engine(spark)
    assert judge_sql(engine, "SELECT 2 AS n", "SELECT 1 + 1 AS n") == (True, "proven")
    assert judge_sql(engine, "SELECT 2 AS n", Rows(({"n": 2},))) == (True, "observed")
    good, why = judge_sql(engine, "SELECT 3 AS n", "SELECT 1 + 1 AS n", "c")
    assert not good and "case c: scored_failure" in why
    for sql, expected in (("", "SELECT 1"), ("SELECT 1", 5)):
        with pytest.raises(ValueError):
            judge_sql(engine, sql, expected)
