import pytest

from assayer import benchmark
from assayer.model import EvalCase, ExecutionError, Expectation, ExpectationSuite, GoldQuery, canonical_type
from assayer.operators import expect
from assayer.plans.equivalence import equivalent
from assayer.score import Expectations, FirstDecisive, Judge, ResultSetEquivalence, SemanticEquivalence, judged_equivalence, observed_equivalence
from assayer.sources import cases
from assayer.sources.engine import Budget, Engine, ddl, disconnected, run_many
from assayer.streaming.expectations import windowed_checks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.over(spark, SF, ("nation", "orders"))


def test_errors_are_values(engine):
    lost = engine.execute("SELECT * FROM nowhere").error
    assert (lost.kind, lost.sqlstate, lost.condition) == ("query_failed", "42P01", "TABLE_OR_VIEW_NOT_FOUND") and "nowhere" in lost.message
    assert engine.execute("SELECT 1 AS x, 2 AS x").error.kind == "duplicate_columns"
    assert engine.scalar("SELECT NULL AS x") == (None, None)
    assert engine.scalar("SELECT 1 AS a, 2 AS b")[1].kind == engine.scalar("SELECT 1 AS a WHERE false")[1].kind == "query_failed"
    assert engine.healthy() and not disconnected(lost)
    assert disconnected(ExecutionError("query_failed", "gone", "08006")) and disconnected(ExecutionError("query_failed", "Cannot call methods on a stopped SparkContext"))


def test_budgets(engine):
    assert engine.execute("SELECT 1 AS a", Budget(0)).error.kind == "budget_exceeded"
    budget = Budget(0.5)
    _, error = engine.action(lambda: engine.spark.range(3_000_000_000).selectExpr("sum(sqrt(id))").collect(), budget)
    assert error.kind == "budget_exceeded" and budget.gone
    assert engine.action(lambda: 5, Budget(30)) == (5, None)
    _, error = engine.action(lambda: engine.spark.sql("SELECT raise_error('no')").collect(), Budget(30))
    assert error.kind == "query_failed"


def test_expectations(engine):
    suite = ExpectationSuite((Expectation("row_count", value=25), Expectation("unique", "n_regionkey"), Expectation("not_null", "nothing"), Expectation("column_type", "n_name", type="VARCHAR(10)")))
    found = Expectations().score(engine, EvalCase("c", "?", suite), "SELECT * FROM nation", Budget(None))
    assert [o.passed for o in found.outcomes] == [True, False, False, True] and found.verdict == "fail"
    assert found.outcomes[1].failing_count == 5 and found.outcomes[1].sample[0]["n"] >= 1
    df = engine.spark.sql("SELECT * FROM VALUES (1, NULL), (1, 2), (NULL, NULL) AS t(a, `order`)")
    got = expect.evaluate(df, ExpectationSuite((Expectation("not_null", "order"), Expectation("unique", "a"), Expectation("column_presence", columns=("a", "b")))))
    assert [(o.passed, o.failing_count) for o in got] == [(False, 2), (False, 1), (False, 1)]
    assert canonical_type("NUMERIC(5,2)", engine.spark) == "decimal(5,2)" and canonical_type("no such type", engine.spark) == "no such type"


SAME = [
    ("a + 1 > 2", "1 + a > 2"), ("a = 1 AND b = 2", "b = 2 AND a = 1"), ("NOT (a > 5)", "a <= 5"), ("a IN (1, 2)", "a IN (2, 1)"), ("nvl(a, 0) = 1", "coalesce(a, 0) = 1"),
    ("a > 5 AND a > 3 AND b < 2", "b < 2 AND a > 5"), ("a >= 5 AND a > 5", "a > 5"), ("NOT (a > 1 OR b > 2)", "a <= 1 AND b <= 2"), ("(a & b) = 1", "(b & a) = 1"), ("NOT (a = 1 AND b = 2)", "NOT a = 1 OR NOT b = 2"),
    ("a = 1 OR b = 2 OR a = 3", "a = 3 OR b = 2 OR a = 1"), ("(a & b & h) = 1", "(h & a & b) = 1"), ("(a | b | h) = 1", "(h | a | b) = 1"), ("(a ^ b ^ h) = 1", "(h ^ a ^ b) = 1"), ("5 < a", "a > 5"),
    # Whole numbers too small to overflow are solved for.
    ("3 - h > 1", "h < 2"), ("h + 2 >= 7", "h >= 5"), ("h - 2 = 7", "h = 9"), ("3L - a > 1L", "a < 2"),
    # Doubles and decimals keep their own bounds.
    ("d > 0.5D AND d > 0.25D", "d > 0.5D"), ("m > 0.10 AND m > 0.01", "m > 0.1"),
]
DIFFERENT = [
    ("a > 5", "a >= 5"), ("a - b > 0", "b - a > 0"), ("a = b", "a <=> b"), ("a > 5 OR a > 3", "a > 5"), ("a = 1", "a = 2"), ("a > 5 AND b > 3", "a > 3 AND b > 5"), ("a < 5 AND a > 3", "a > 3"), ("s = '5'", "s = '6'"),
    # An overflow is an error on one side only; NaN and rounding on the other.
    ("3 - a > 1", "a < 2"), ("0 - a = 1", "a = -1"), ("3 - d > 1", "d < 2"), ("0.3D - d = 0.2D", "d = 0.1D"), ("0.3D - d > 0.1D", "d < 0.2D"), ("d > 0.1D", "d > 0.10000000000000002D"),
    ("l > 9007199254740992", "l > 9007199254740993"), ("m > 0.1", "m > 0.11"), ("NOT (d > 1)", "d < 1"), ("d = d", "d IS NOT NULL AND d <> 'NaN'"), ("3 - h > 40000", "h < 0"),
    # Texts that look like conditions.
    ("s = 'x AND b = 1'", "s = 'x' AND b = 1"), ("s = 'x' AND b > 1", "s = 'x AND (b#1 > 1)'"), ("s = '1'", "s = 1"), ("NOT (a = b)", "a = b"),
]
#: Statements, as the rows they give need not be filtered.
SAME_STATEMENTS = [
    ("SELECT a + b + h AS n FROM t", "SELECT h + b + a AS n FROM t"), ("SELECT a * b * h AS n FROM t", "SELECT h * b * a AS n FROM t"), ("SELECT 1 + 1 AS n", "SELECT 2 AS n"), ("SELECT a AS N FROM T", "select   a as n from t"),
    ("SELECT count(*) AS n FROM t WHERE a > 5 AND a > 3 GROUP BY b", "SELECT count(*) AS n FROM t WHERE a > 5 GROUP BY b"), ("SELECT x.a FROM t x JOIN t y ON x.a = y.a WHERE y.b > 1 AND y.b > 0", "SELECT x.a FROM t x JOIN t y ON x.a = y.a WHERE y.b > 1"),
]


@pytest.fixture(scope="module")
def plans(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("t") / "t")
    spark.sql("SELECT CAST(1 AS INT) AS a, CAST(2 AS INT) AS b, 'x' AS s, CAST(3 AS SMALLINT) AS h, 0.1D AS d, CAST(1 AS BIGINT) AS l, CAST(0.1 AS DECIMAL(10, 2)) AS m").write.parquet(at)
    own = spark.newSession()
    own.read.parquet(at).createOrReplaceTempView("t")
    own.read.parquet(at).selectExpr("b AS a", "a AS b", "s").createOrReplaceTempView("u")
    return own


@pytest.mark.parametrize(("left", "right"), SAME)
def test_same_plans(plans, left, right):
    assert equivalent(plans, f"SELECT a, b FROM t WHERE {left}", f"SELECT a, b FROM t WHERE {right}") == "equivalent"


@pytest.mark.parametrize(("left", "right"), DIFFERENT)
def test_different_plans(plans, left, right):
    assert equivalent(plans, f"SELECT a, b FROM t WHERE {left}", f"SELECT a, b FROM t WHERE {right}") == "unknown"


@pytest.mark.parametrize(
    ("left", "right"),
    [
        ("SELECT a AS x FROM t", "SELECT a AS y FROM t"), ("SELECT a FROM t", "SELECT a FROM u"), ("SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY b"), ("SELECT DISTINCT a FROM t", "SELECT a FROM t"),
        ("SELECT rand(1) AS r FROM t", "SELECT rand(1) AS r FROM t"), ("SELECT current_date AS d", "SELECT current_date AS d"), ("SELEC", "SELEC"), ("SELECT a FROM t UNION ALL SELECT b FROM t", "SELECT b AS a FROM t UNION ALL SELECT a FROM t"),
    ],
)
def test_guards(plans, left, right):
    assert equivalent(plans, left, right) == "unknown"


@pytest.mark.parametrize(("left", "right"), SAME_STATEMENTS)
def test_same_statements(plans, left, right):
    assert equivalent(plans, left, right) == "equivalent"


def test_confirmed_statements_give_equal_rows(plans):
    """What is confirmed is held against rows with nulls, extremes, NaN and infinities, in both forms."""
    values = ["(CAST(NULL AS INT), 1, 'x', CAST(1 AS SMALLINT), CAST('NaN' AS DOUBLE), 1L, CAST(0.1 AS DECIMAL(10, 2)))"]
    values += [f"({a}, {b}, '{s}', {h}S, {d}, {l}L, {m}BD)" for a, b, s, h, d, l, m in (
        (5, 2, "x", 3, "0.1D", 7, 0.1), (2, 1, "5", -32768, "double('Infinity')", 9007199254740992, 0.11), (1000, 7, "y", 32767, "double('-Infinity')", 9007199254740993, -0.01), (1, 0, "x AND b = 1", 9, "-0.0D", -1, 0), (6, 1, "x", 1, "0.5D", 0, 5),
    )]
    plans.sql(f"SELECT a, b, s, h, d, l, CAST(m AS DECIMAL(10, 2)) AS m FROM VALUES {', '.join(values)} AS v(a, b, s, h, d, l, m)").createOrReplaceTempView("v")
    for left, right in [*SAME, *DIFFERENT]:
        one, other = (f"SELECT * FROM v WHERE {c}" for c in (left, right))
        if equivalent(plans, one, other) == "equivalent":
            assert sorted(map(str, plans.sql(one).collect())) == sorted(map(str, plans.sql(other).collect())), (left, right)


def case(name, gold, **more):
    return EvalCase(name, name, GoldQuery(gold), **more)


def test_cascades(engine):
    right, wrong = case("right", "SELECT n_name FROM nation WHERE n_regionkey = 1"), case("wrong", "SELECT n_name FROM nation")
    sql = "SELECT n_name FROM nation WHERE 1 = n_regionkey"
    assert observed_equivalence().score(engine, right, sql, Budget(None)).basis == "proven"
    found = observed_equivalence().score(engine, wrong, sql, Budget(None))
    assert (found.verdict, found.basis, found.metadata["trail"]) == ("fail", "observed", [("semantic_equivalence", "inconclusive"), ("result_set_equivalence", "fail")])
    assert judged_equivalence(lambda c, s: 0.5).score(engine, wrong, sql, Budget(None)).basis == "judged"
    assert Judge(lambda c, s: 1 / 0).score(engine, wrong, sql, Budget(None)).verdict == "inconclusive"
    assert FirstDecisive((SemanticEquivalence(), SemanticEquivalence())).score(engine, wrong, sql, Budget(None)).verdict == "inconclusive"
    with pytest.raises(ValueError):
        FirstDecisive(())


def test_benchmark(spark, engine):
    todo = [case("good", "SELECT 1 AS a", metadata={"difficulty": "simple"}), case("bad", "SELECT 2 AS a", metadata={"difficulty": "simple"}), case("broken", "SELECT 1 AS a"), case("raises", "SELECT 1 AS a")]
    answers = {"good": "SELECT 1 AS a", "bad": "SELECT 1 AS a", "broken": "SELEC"}
    reports = benchmark.run_benchmark(engine, todo, lambda c: answers[c.id], threads=3)
    assert [r.outcome for r in reports] == ["passed", "scored_failure", "execution_failure", "solver_failure"]
    rows = benchmark.report_rows(spark, reports)
    assert tuple(benchmark.accuracy(rows).first()) == (4, 1, 0.25)
    assert [tuple(r) for r in benchmark.by_difficulty(rows).collect()] == [("simple", 2, 1, 0.5)]
    assert tuple(benchmark.accuracy(rows.limit(0)).first()) == (0, 0, 0.0)
    assert "1/4 passed" in benchmark.summary_text(reports) and '"failed": 3' in benchmark.report_json(reports)
    with pytest.raises(AssertionError):
        benchmark.assert_eval(engine, todo[1], lambda c: answers[c.id], (ResultSetEquivalence(),))
    assert len(benchmark.run_benchmark(engine, todo, lambda c: answers[c.id], limit=1)) == 1
    assert run_many([lambda k=k: k for k in range(9)], 4) == list(range(9))


def test_case_files(spark, tmp_path):
    path = tmp_path / "dev.json"
    path.write_text('[{"db_id": "d", "question": "q?", "evidence": "hint", "SQL": "SELECT 1", "question_id": 7, "difficulty": "simple"}, {"db_id": "d", "question": "r?", "evidence": "", "SQL": "SELECT 2"}]')
    first, second = cases.as_cases(cases.bird_cases(spark, str(path)).orderBy("question"))
    assert (first.id, first.input, first.expected.sql, first.metadata["difficulty"]) == ("d-7", "q?\nEvidence: hint", "SELECT 1", "simple") and second.input == "r?"
    path.write_text('[{"db_id": "d", "question": "q?", "query": "SELECT 1"}]')
    assert cases.as_cases(cases.spider_cases(spark, str(path)))[0].expected.sql == "SELECT 1"
    assert cases.extract_sql("see\n```sql\nSELECT 1\n```") == "SELECT 1" and cases.extract_sql("  ") is None
    assert ddl(spark.range(1), "t") == "CREATE TABLE t (\n  id bigint\n)"


def test_windowed_checks(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = windowed_checks(events, "ts", ("value",), "1 day")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = windowed_checks(stream, "ts", ("value",), "1 day").writeStream.format("memory").queryName("checks").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(spark.table("checks").collect()) == sorted(batch.collect())


def random_predicate(r, depth=2):
    """A predicate and a rewriting of it: often the same condition, at times another one."""
    if depth and r.random() < 0.6:
        (a, x), (b, y) = random_predicate(r, depth - 1), random_predicate(r, depth - 1)
        word = r.choice(["AND", "AND", "OR"])
        return f"({a} {word} {b})", (f"({y} {word} {x})" if r.random() < 0.9 else f"({y} {r.choice(['AND', 'OR'])} {x})")
    column, op = r.choice(["a", "b", "h", "d", "m"]), r.choice(["<", "<=", ">", ">=", "="])
    flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
    n = {"d": lambda: r.choice(["0.1D", "0.5D", "0.3D", "-1.0D", "2.0D"]), "m": lambda: r.choice(["0.1", "0.25", "1.00"])}.get(column, lambda: str(r.randrange(-3, 5)))
    value, other = n(), n()
    kind = r.randrange(7)
    if kind == 0:
        return f"{column} {op} {value}", f"{value} {flip[op]} {column}"
    if kind == 1:
        return f"{column} {op} {value}", f"{column} {r.choice([op, '<', '>='])} {value}"
    if kind == 2:
        return f"NOT ({column} {op} {value})", f"{column} { {'<': '>=', '<=': '>', '>': '<=', '>=': '<', '=': '<>'}[op]} {value}"
    if kind == 3:
        return f"({column} {op} {value} AND {column} {op} {other})", f"{column} {op} {r.choice([value, other])}"
    if kind == 4 and column not in "dm":
        return f"{value} - {column} {op} {other}", f"{column} {flip[op]} {int(value) - int(other)}"
    if kind == 4:
        return f"{value} - {column} {op} {other}", f"{column} {flip[op]} {value} - {other}"
    if kind == 5:
        return f"{column} + {value} {op} {other}", f"{column} {op} {other} - {value}"
    return f"{column} IS NULL", f"NOT ({column} IS NOT NULL)"


def test_nothing_is_confirmed_that_differs(plans):
    """Random pairs of conditions; those that are confirmed hold on the same rows, with nulls, NaN, infinities and values at the edge."""
    import random

    r = random.Random(17)
    doubles = ["double('NaN')", "double('Infinity')", "-0.0D", "0.1D", "0.2D", "0.09999999999999998D", "0.5D", "-1.0D", "CAST(NULL AS DOUBLE)"]
    rows = [f"({r.choice(['NULL', *map(str, range(-3, 6))])}, {r.choice(['NULL', *map(str, range(-3, 6))])}, CAST({r.choice(['NULL', '-32768', '32767', *map(str, range(-3, 6))])} AS SMALLINT), {r.choice(doubles)}, CAST({r.choice(['NULL', '0.1', '0.15', '0.25', '1', '-1'])} AS DECIMAL(10, 2)))" for _ in range(150)]
    plans.sql(f"SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, h, d, m FROM VALUES {', '.join(rows)} AS x(a, b, h, d, m)").createOrReplaceTempView("x")
    pairs = [random_predicate(r) for _ in range(220)]
    confirmed = [(p, q) for p, q in pairs if equivalent(plans, f"SELECT a FROM x WHERE {p}", f"SELECT a FROM x WHERE {q}") == "equivalent"]
    assert 40 <= len(confirmed) < len(pairs)
    for first in range(0, len(confirmed), 20):
        some = confirmed[first : first + 20]
        found = plans.sql("SELECT " + ", ".join(f"count_if(coalesce({p}, false) <> coalesce({q}, false)) AS c{k}" for k, (p, q) in enumerate(some)) + " FROM x").first()
        assert [pair for k, pair in enumerate(some) if found[k]] == []
