"""Bag and keyed differences against brute force in Python."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql.types import DecimalType, DoubleType, LongType, StringType, StructField, StructType

from assayer.functions.tolerance import scale_of
from assayer.model import Comparison, EvalCase, ExpectationSuite, GoldQuery, ResultDiff, Rows, Score
from assayer.operators import diff
from assayer.operators.align import reconcile, relation, type_mismatches
from assayer.score import ResultSetEquivalence
from assayer.sources.engine import Budget, Engine

SCHEMA = StructType([StructField("a", LongType()), StructField("b", StringType())])


def bag(random_, n):
    return [(random_.choice([0, 1, 2, None]), random_.choice(["x", "y", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_bags(spark, seed):
    r = random.Random(seed)
    e, a = bag(r, r.randrange(25)), bag(r, r.randrange(25))
    left, right = spark.createDataFrame(e, SCHEMA), spark.createDataFrame(a, SCHEMA)
    missing, extra = Counter(e) - Counter(a), Counter(a) - Counter(e)
    row = diff.bag_counts(left, right, ["a", "b"]).first()
    assert (row["missing"], row["extra"]) == (missing.total(), extra.total())
    assert Counter(map(tuple, diff.bag_sample(left, right, ["a", "b"], 50).collect())) == missing


@pytest.mark.parametrize("seed", range(4))
def test_sets(spark, seed):
    r = random.Random(100 + seed)
    e, a = bag(r, r.randrange(25)), bag(r, r.randrange(9))
    left, right = spark.createDataFrame(e, SCHEMA), spark.createDataFrame(a, SCHEMA)
    row = diff.bag_counts(left, right, ["a", "b"], distinct=True).first()
    assert (row["missing"], row["extra"]) == (len(set(e) - set(a)), len(set(a) - set(e)))
    assert Counter(map(tuple, diff.bag_sample(left, right, ["a", "b"], 50, distinct=True).collect())) == Counter(set(e) - set(a))


@pytest.mark.parametrize("distinct", [False, True])
def test_one_table_of_rows_in_a_task(spark, distinct):
    """Rows are dealt once and kept once in each stage, and orders that don't count aren't made."""
    frames = [spark.sql(f"SELECT id AS a, CAST(id AS STRING) AS b FROM range(100) ORDER BY id {way}, {other}") for way, other in (("ASC", "b"), ("DESC", "a + 1"))]
    found = diff.bag_counts(*frames, ["a", "b"], distinct)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("HashAggregate(keys=[c0") == 2 and "Sort" not in plan and "rangepartitioning" not in plan
    assert tuple(found.first()) == (0, 0)
    limited = diff.bag_counts(frames[0], frames[1].limit(30), ["a", "b"], distinct)  # an order below a limit counts
    assert tuple(limited.first()) == (70, 0) and "70" in {r["b"] for r in diff.bag_sample(frames[1].limit(30), frames[0].limit(30), ["a", "b"], 40, distinct).collect()}


def test_no_shared_columns(spark):
    df = spark.range(3)
    assert tuple(diff.bag_counts(df, df, []).first()) == (0, 0)


def score(spark, expected, sql, **comparison):
    return ResultSetEquivalence().score(Engine(spark), EvalCase("c", "?", expected, Comparison(**comparison)), sql, Budget(None))


def test_rounding_splits_at_edges_and_bands_do_not(spark):
    gold = GoldQuery("SELECT 1 AS k, 0.014D AS v")
    assert score(spark, gold, "SELECT 1 AS k, 0.0149D AS v", float_tolerance=0.01).verdict == "pass"
    assert score(spark, gold, "SELECT 1 AS k, 0.0151D AS v", float_tolerance=0.01).verdict == "fail"
    assert score(spark, gold, "SELECT 1 AS k, 0.0151D AS v", float_tolerance=0.01, match_key=("k",)).verdict == "pass"
    assert score(spark, gold, "SELECT 1 AS k, 0.0251D AS v", float_tolerance=0.01, match_key=("k",)).verdict == "fail"
    assert [scale_of(t) for t in (1e-9, 0.01, 1, 50)] == [9, 2, 0, 0]


@pytest.mark.parametrize("value", ["double('NaN')", "double('Infinity')", "1e30D", "-1e25D"])
def test_numbers_beyond_decimals(spark, value):
    for key in ((), ("k",)):
        assert score(spark, GoldQuery(f"SELECT 1 AS k, {value} AS v"), f"SELECT 1 AS k, {value} AS v", match_key=key).verdict == "pass"
        assert score(spark, GoldQuery(f"SELECT 1 AS k, {value} AS v"), "SELECT 1 AS k, 5D AS v", match_key=key).verdict == "fail"


def test_authored_rows(spark):
    typed = Rows(({"id": 1, "v": Decimal("42.75")},), StructType([StructField("id", LongType()), StructField("v", DecimalType(10, 2))]))
    sql = "SELECT CAST(1 AS BIGINT) AS id, CAST(42.75 AS DECIMAL(10,2)) AS v"
    assert score(spark, typed, sql).verdict == "pass"
    assert score(spark, typed, "SELECT 1 AS id, CAST(42.75 AS DECIMAL(10,2)) AS v").diff == ResultDiff(type_mismatches=(("id", "bigint", "int"),))
    assert score(spark, Rows(({"id": 1},)), "SELECT 1 AS id").verdict == "pass"  # without a schema types say nothing
    assert score(spark, Rows(({"v": 0.1},)), "SELECT 0.1000000000001D AS v").verdict == "fail"  # nor is there a tolerance
    assert relation(spark, Rows((), SCHEMA)).count() == 0


def test_keyed_nulls(spark):
    gold = GoldQuery("SELECT * FROM VALUES (1, 'a'), (NULL, 'b'), (2, NULL), (3, 'c') AS t(k, v)")
    found = score(spark, gold, "SELECT * FROM VALUES (1, NULL), (NULL, 'b'), (2, NULL), (4, 'd') AS t(k, v)", match_key=("k",)).diff
    assert (found.missing_count, found.unexpected_count, found.column_mismatches) == (2, 2, (("v", 1),))
    found = score(spark, gold, gold.sql, match_key=("k",), null_equality="distinct").diff
    assert (found.missing_count, found.unexpected_count, found.column_mismatches) == (1, 1, (("v", 1),))
    assert score(spark, GoldQuery("SELECT * FROM VALUES (NULL), (NULL) AS t(k)"), "SELECT * FROM VALUES (NULL), (NULL) AS t(k)", match_key=("k",)).diff.missing_count == 2


def test_keyed_guards(spark):
    twice = "SELECT * FROM VALUES (1, 'a'), (1, 'b') AS t(k, v)"
    assert "not unique" in score(spark, GoldQuery(twice), twice, match_key=("k",)).explanation
    assert "not shared" in score(spark, GoldQuery(twice), twice, match_key=("z",)).explanation
    assert score(spark, GoldQuery(twice), twice, null_equality="distinct").verdict == "fail"
    assert score(spark, GoldQuery("SELECT * FROM nowhere"), twice).metadata == {"gold_query_failed": True}
    assert score(spark, ExpectationSuite(()), twice).metadata == {"scorer_misconfigured": True}


def test_maps_are_compared_as_text(spark):
    sql = "SELECT map('a', 1) AS m"
    assert score(spark, GoldQuery(sql), sql).verdict == "pass"
    assert score(spark, GoldQuery(sql), "SELECT map('a', 2) AS m").verdict == "fail"


def test_columns():
    c = reconcile(["b", "A", "x"], ["a", "x", "b"], "strict")
    assert (c.shared, c.missing, c.unexpected, c.order_differs) == (["x", "b"], ["a"], ["A"], True)
    assert reconcile(["a", "b"], ["a", "b", "c"], "strict").order_differs and reconcile(["a", "b"], ["a"], "strict").order_differs
    assert not reconcile(["a", "b"], ["a", "b"], "strict").order_differs and not reconcile(["b"], ["a", "b"]).order_differs
    assert type_mismatches(None, SCHEMA, ["a"]) == []
    other = StructType([StructField("a", DoubleType())])
    assert type_mismatches(other, SCHEMA, ["a"]) == [("a", "bigint", "double")]


def test_odd_names(spark):
    sql = "SELECT 1 AS `order`, 2 AS `a``b`, 3 AS `x.y`, 4 AS __s, 5 AS c0"
    assert score(spark, GoldQuery(sql), sql).verdict == "pass"
    assert score(spark, GoldQuery(sql), sql, match_key=("x.y",)).verdict == "pass"


def test_records_refuse_contradictions():
    with pytest.raises(ValueError):
        Score("s", "inconclusive", 1.0)
    with pytest.raises(ValueError):
        Comparison(float_tolerance=-1)
