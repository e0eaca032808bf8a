"""Metric queries on a small shop whose totals were worked out by hand."""

import datetime

import pytest

from assayer.catalog_semantic import MANIFEST
from assayer.semantic.compile import Compiler, MetricQuery, ResolutionError
from assayer.semantic.manifest import Manifest, references
from assayer.semantic.score import MetricCase, MetricJudge, ResultEquivalence, SpecEquivalence, first_decisive, metric_layer_equivalence, results_agree, run_metric_benchmark, strict
from assayer.solvers import ScriptedLlm


@pytest.fixture(scope="module")
def shop(spark):
    own = spark.newSession()
    own.sql("SELECT * FROM VALUES (1, 'BUILDING', 10), (2, 'AUTO', 20), (3, 'AUTO', 99) AS t(c_custkey, c_mktsegment, c_nationkey)").createOrReplaceTempView("customer")
    own.sql("SELECT * FROM VALUES (10, 'A', 0), (20, 'B', 0) AS t(n_nationkey, n_name, n_regionkey)").createOrReplaceTempView("nation")
    own.sql(
        "SELECT * FROM VALUES (1, 1, 'F', 100.0D, TIMESTAMP '2024-01-05 00:00:00'), (2, 1, 'O', 300000.0D, TIMESTAMP '2024-01-20 10:00:00'), (3, 2, 'F', 50.0D, TIMESTAMP '2024-02-01 00:00:00'), (4, 3, 'P', 7.0D, TIMESTAMP '2024-03-09 00:00:00'), (5, NULL, 'F', 3.0D, TIMESTAMP '2024-03-10 00:00:00') AS t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate)"
    ).createOrReplaceTempView("orders")
    own.sql("SELECT * FROM VALUES (1, 2.0D, 'R', TIMESTAMP '2024-01-06 00:00:00'), (1, 3.0D, 'N', TIMESTAMP '2024-01-07 00:00:00'), (9, 4.0D, 'N', TIMESTAMP '2024-02-07 00:00:00') AS t(l_orderkey, l_quantity, l_returnflag, l_shipdate)").createOrReplaceTempView("lineitem")
    return own


def ask(shop, *metrics, by=(), **more):
    return sorted((tuple(r) for r in Compiler(Manifest.parse(MANIFEST)).compile(shop, MetricQuery(metrics, by, **more)).collect()), key=repr)


def test_metrics(shop):
    assert ask(shop, "revenue", "orders", "buyers", "mean_price") == [(300160.0, 5, 3, 60032.0)]
    assert ask(shop, "average_order_value", by=("order_status",)) == [("F", 51.0), ("O", 300000.0), ("P", 7.0)]
    assert ask(shop, "large_revenue", by=("order_status",)) == [("O", 300000.0)]
    assert ask(shop, "large_revenue", "orders", by=("order_status",)) == [("F", None, 3), ("O", 300000.0, 1), ("P", None, 1)]
    assert ask(shop, "large_percent", by=("order_status",), where=("{{ Dimension('order__order_status') }} = 'O'",)) == [("O", 100.0)]
    assert ask(shop, "orders", where=("{{ Dimension('order__is_large') }}",)) == [(1,)]


def test_joins_keep_unmatched_rows(shop):
    assert ask(shop, "revenue", by=("nation__nation_name",)) == [("A", 300100.0), ("B", 50.0), (None, 10.0)]
    assert ask(shop, "building_revenue", by=("customer__segment",)) == [("BUILDING", 300100.0)]
    assert ask(shop, "quantity", "orders", by=("order__order_status",)) == [("F", 5.0, 3), ("O", None, 1), ("P", None, 1), (None, 4.0, None)]
    assert ask(shop, "customers", by=("nation__nation_name",)) == [("A", 1), ("B", 1), (None, 1)]


def test_time(shop):
    assert ask(shop, "running_revenue", by=("metric_time__month",)) == [(datetime.date(2024, m, 1), v) for m, v in ((1, 300100.0), (2, 300150.0), (3, 300160.0))]
    assert ask(shop, "running_revenue") == [(300160.0,)]
    assert ask(shop, "orders", by=("metric_time__quarter",)) == [(datetime.date(2024, 1, 1), 5)]
    assert ask(shop, "orders", "quantity", by=("metric_time__month",))[1] == (datetime.date(2024, 2, 1), 1, 4.0)


def test_ties_are_broken(shop):
    top = Compiler(Manifest.parse(MANIFEST)).compile(shop, MetricQuery(("customers",), ("nation__nation_name",), order_by=("-customers", ), limit=2)).collect()
    assert [r[0] for r in top] == [None, "A"]


def test_names_that_mean_nothing(shop):
    for q in (MetricQuery(("nothing",)), MetricQuery(("revenue",), ("return_flag",)), MetricQuery(("revenue",), order_by=("orders",)), MetricQuery(("revenue",), ("order_status__month",))):
        with pytest.raises(ResolutionError):
            Compiler(Manifest.parse(MANIFEST)).canonical(q)
    with pytest.raises(ValueError):
        MetricQuery(())
    bad = {"semantic_models": [], "metrics": [{"name": "m", "type": "cumulative", "type_params": {"measure": {"name": "x"}, "cumulative_type_params": {"window": "7 days"}}}]}
    with pytest.raises(NotImplementedError):
        Manifest.parse(bad)
    assert references("{{ TimeDimension('metric_time', 'month') }} > 1 and {{Dimension('a__b')}} = 2") == [("{{ TimeDimension('metric_time', 'month') }}", "metric_time__month"), ("{{Dimension('a__b')}}", "a__b")]


def test_names_to_group_by():
    """Every entity on the way is named; a further join to a dimension of the same name is left out."""
    manifest = {
        "semantic_models": [
            {"name": "premiums", "node_relation": {"alias": "p"}, "entities": [{"name": "premium", "type": "primary"}, {"name": "policy", "type": "foreign"}], "dimensions": [{"name": "kind", "type": "categorical"}], "measures": [{"name": "total", "agg": "sum", "expr": "x", "create_metric": True}]},
            {"name": "policies", "node_relation": {"alias": "q"}, "entities": [{"name": "policy", "type": "primary"}, {"name": "party", "type": "foreign"}], "dimensions": [{"name": "party_name", "type": "categorical"}], "measures": []},
            {"name": "parties", "node_relation": {"alias": "r"}, "entities": [{"name": "party", "type": "primary"}], "dimensions": [{"name": "party_name", "type": "categorical"}, {"name": "country", "type": "categorical"}], "measures": []},
        ],
        "metrics": [],
    }
    compiler = Compiler(Manifest.parse(manifest))
    assert compiler.group_by_items("total") == ["policy__party__country", "policy__party_name", "premium__kind"]
    assert compiler.canonical(MetricQuery(("total",), ("policy__party__country",))) == compiler.canonical(MetricQuery(("total",), ("policy__party__country",)))


def test_verdicts(shop):
    compiler = Compiler(Manifest.parse(MANIFEST))
    case = MetricCase("c", "?", MetricQuery(("revenue",), ("order_status",)))
    scorers = strict(compiler)
    assert first_decisive(scorers, shop, case, MetricQuery(("revenue",), ("order__order_status",))).basis == "proven"
    assert first_decisive(scorers, shop, case, MetricQuery(("revenue", "orders"), ("order_status",))).basis == "observed"
    assert first_decisive(scorers, shop, case, MetricQuery(("orders",), ("order_status",))).verdict == "fail"
    assert SpecEquivalence(compiler).score(shop, case, MetricQuery(("revenue",), ("nothing",))).basis == "proven"
    assert ResultEquivalence(compiler, "inconclusive").score(shop, case, MetricQuery(("nothing",))).verdict == "inconclusive"
    # A candidate that can't run leaves it open by default, and fails it where the caller says so; a gold query that can't leaves it open.
    assert ResultEquivalence(compiler).score(shop, case, MetricQuery(("nothing",))).verdict == "inconclusive"
    found = ResultEquivalence(compiler, "fail").score(shop, case, MetricQuery(("nothing",)))
    assert (found.verdict, found.basis) == ("fail", "observed")
    lost = MetricCase("c", "?", MetricQuery(("nothing",)))
    assert ResultEquivalence(compiler, "fail").score(shop, lost, case.gold).verdict == "inconclusive"
    judge = metric_layer_equivalence(compiler, ScriptedLlm(['{"score": 0.7, "reason": "near"}', "no idea"]))[-1]
    assert (judge.score(shop, case, case.gold).score, judge.score(shop, case, case.gold).verdict) == (0.7, "inconclusive")
    assert "Reference:\nmetrics: revenue\ngroup by: order_status" in judge.ask.prompts[0]
    assert MetricJudge(lambda c, q: 2.0).score(shop, case, case.gold).score == 1.0
    found = run_metric_benchmark(shop, [case, case], lambda c: c.gold, scorers)
    assert [s.verdict for _, s in found] == ["pass", "pass"]


def test_results_agree(spark):
    rows = lambda *r: spark.sql(f"SELECT * FROM VALUES {', '.join(r)}")
    gold = rows("(1, 'x')", "(1, 'x')", "(2, 'y')")
    assert results_agree(gold, rows("('x', 1.0000000001D)", "('x', 1)", "('y', 2)"))
    # Extra columns may be there if they part no rows; rows may repeat.
    assert results_agree(gold, rows("(1, 'x', 9)", "(1, 'x', 9)", "(2, 'y', 9)"))
    assert not results_agree(gold, rows("(1, 'x', 8)", "(1, 'x', 9)", "(2, 'y', 9)"))
    assert not results_agree(gold, rows("(1)", "(1)", "(2)"))
    # Empty results are equal at any width.
    assert results_agree(gold.limit(0), rows("(1)").limit(0)) and results_agree(gold.limit(0), rows("(1, 2, 3)").limit(0))
    assert not results_agree(gold, rows("(1, 2, 3)").limit(0)) and not results_agree(gold.limit(0), gold)
