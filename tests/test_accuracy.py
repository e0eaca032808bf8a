"""Execution accuracy against a brute-force comparison of lists, bags, sets and column orders."""

import random
from collections import Counter
from itertools import permutations

import pytest

from assayer.operators.accuracy import BIRD, SPIDER, ExecutionAccuracy, by_position, equal_by_value, equal_lists, ordered, with_index

DOMAIN = [0, 1, 2, None]


def frame(spark, rows, width):
    return spark.createDataFrame(rows, ", ".join(f"c{k} int" for k in range(width)))


def by_brute_force(gold, model, multiplicity):
    same = (lambda a, b: set(a) == set(b)) if multiplicity == "set" else (lambda a, b: Counter(a) == Counter(b))
    if not gold or not model:
        return not gold and not model
    if len(gold[0]) != len(model[0]):
        return False
    return any(same(gold, [tuple(r[k] for k in order) for r in model]) for order in permutations(range(len(gold[0]))))


@pytest.mark.parametrize("seed", range(14))
def test_by_value_fuzz(spark, seed):
    r = random.Random(seed)
    width, n = r.randrange(1, 4), r.randrange(1, 5)
    gold = [tuple(r.choice(DOMAIN) for _ in range(width)) for _ in range(n)]
    order = r.sample(range(width), width)
    model = [tuple(row[k] for k in order) for row in gold]
    if seed % 2:
        model[r.randrange(n)] = tuple(r.choice(DOMAIN) for _ in range(width))
    if seed % 3 == 0:
        model.append(model[0])
    for multiplicity in ("multiset", "set"):
        got = ExecutionAccuracy("ignore", multiplicity, "by_value").agrees(frame(spark, gold, width), frame(spark, model, width))
        assert got == by_brute_force(gold, model, multiplicity)


def test_presets(spark):
    gold, sql = spark.sql("SELECT * FROM VALUES (1, 'x'), (2, 'y') AS t(a, b) ORDER BY a"), "SELECT * FROM t ORDER BY a"
    swapped = spark.sql("SELECT * FROM VALUES ('x', 1.0D), ('y', 2.0D) AS t(b, a)")
    assert SPIDER.agrees(gold, swapped, sql) and not BIRD.agrees(gold, swapped, sql)
    backwards = spark.sql("SELECT * FROM VALUES (1, 'x'), (2, 'y') AS t(a, b) ORDER BY a DESC")
    assert not SPIDER.agrees(gold, backwards, sql) and BIRD.agrees(gold, backwards, sql)
    assert ExecutionAccuracy().agrees(spark.sql("SELECT true AS a"), spark.sql("SELECT 1 AS b"))
    assert not ExecutionAccuracy().agrees(spark.sql("SELECT '1' AS a"), spark.sql("SELECT 1 AS b"))


def test_sets_are_not_made_distinct_first(spark, monkeypatch):
    """Sets are compared in the one pass that finds the difference: each side made distinct would be kept twice more in a task."""
    gold, model, other = (spark.sql(f"SELECT * FROM VALUES {v} AS t(a, b)") for v in ("(1, 'x'), (1, 'x'), (2, NULL)", "(2, NULL), (1, 'x'), (2, NULL)", "(1, 'x'), (3, NULL), (3, NULL)"))
    monkeypatch.setattr(type(gold), "distinct", lambda df: pytest.fail("a side is made distinct"))
    assert BIRD.agrees(gold, model) and not BIRD.agrees(gold, other) and not ExecutionAccuracy("ignore").agrees(gold, model)


def test_sets_by_value_and_samples(spark, monkeypatch):
    gold, model, other = (spark.sql(f"SELECT * FROM VALUES {v} AS t(a, b)") for v in ("(1, 'x'), (1, 'x'), (2, NULL)", "('x', 1), (NULL, 2), (NULL, 2)", "(1, 'x'), (3, NULL), (3, NULL)"))
    kept = []
    assert equal_by_value(by_position(gold), by_position(model), lambda a, b: not kept.extend((a, b)), distinct=True)
    assert not any("Aggregate" in df._jdf.queryExecution().optimizedPlan().toString() for df in kept)
    assert ExecutionAccuracy("ignore", "set", "by_value").agrees(gold, model)
    monkeypatch.setattr(type(gold), "distinct", lambda df: pytest.fail("a side is made distinct"))
    assert [[tuple(r) for r in side] for side in BIRD.samples(gold, other)] == [[("n2", None)], [("n3", None)]]


def test_numbers_are_exact(spark):
    one = lambda x: spark.sql(f"SELECT {x} AS a")
    same = [("1", "1.0D"), ("CAST(2.50 AS DECIMAL(10, 2))", "2.5D"), ("CAST(2.50 AS DECIMAL(10, 2))", "CAST(2.5 AS DECIMAL(38, 18))"), ("9007199254740993L", "CAST(9007199254740993 AS DECIMAL(38, 0))"), ("0.0D", "-0.0D"), ("double('NaN')", "double('NaN')"), ("1e300D", "1e300D"), ("100", "CAST(100 AS DECIMAL(10, 1))")]
    other = [("9007199254740993L", "9007199254740992L"), ("CAST(12345678901234567890.1 AS DECIMAL(38, 1))", "CAST(12345678901234567890.2 AS DECIMAL(38, 1))"), ("1", "1.5D"), ("10", "1"), ("double('NaN')", "0.0D"), ("1e300D", "1e301D")]
    for columns in ("positional", "by_value"):
        agrees = ExecutionAccuracy(columns=columns).agrees
        assert all(agrees(one(a), one(b)) for a, b in same), columns
        assert not any(agrees(one(a), one(b)) for a, b in other), columns


def test_empty_results(spark):
    none, one = spark.range(0), spark.range(1)
    value = ExecutionAccuracy("ignore", columns="by_value")
    assert value.agrees(none, none.selectExpr("id", "id AS b")) and not value.agrees(none, one)


def test_order(spark):
    many = by_position(spark.range(5000).orderBy("id"))
    held = []
    assert [r["__at"] for r in with_index(many, held).orderBy("__at").collect()] == list(range(5000))
    held[0].unpersist()
    assert equal_lists(many, by_position(spark.range(5000).repartition(7).orderBy("id")))
    assert not equal_lists(many, by_position(spark.range(5000).orderBy("id", ascending=False)))


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 1 AS a ORDER BY a", True),
        ("WITH x AS (SELECT 1 AS a) SELECT a FROM x ORDER BY a LIMIT 3 OFFSET 1", True),
        ("SELECT * FROM (SELECT 1 AS a ORDER BY a)", False),
        ("SELECT row_number() OVER (ORDER BY a) FROM (SELECT 1 AS a)", False),
        ("SELECT 1 AS a SORT BY a", False),
        ("SELECT 1 UNION ALL SELECT 2", False),
        ("SELEC 1", False),
    ],
)
def test_ordered(spark, sql, want):
    assert ordered(spark, sql) is want
