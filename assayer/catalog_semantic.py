"""Metric queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.semantic.compile import Compiler, MetricQuery
from assayer.semantic.manifest import Manifest
from assayer.semantic.score import MetricCase, ResultEquivalence, SpecEquivalence

MANIFEST = {
    "semantic_models": [
        {
            "name": "orders", "node_relation": {"alias": "orders"}, "defaults": {"agg_time_dimension": "ordered_at"},
            "entities": [{"name": "order", "type": "primary", "expr": "o_orderkey"}, {"name": "customer", "type": "foreign", "expr": "o_custkey"}],
            "dimensions": [
                {"name": "ordered_at", "type": "time", "expr": "o_orderdate", "type_params": {"time_granularity": "day"}},
                {"name": "order_status", "type": "categorical", "expr": "o_orderstatus"},
                {"name": "is_large", "type": "categorical", "expr": "o_totalprice >= 200000"},
            ],
            "measures": [
                {"name": "order_total", "agg": "sum", "expr": "o_totalprice"},
                {"name": "orders", "agg": "sum", "expr": "1", "create_metric": True},
                {"name": "mean_price", "agg": "average", "expr": "o_totalprice", "create_metric": True},
                {"name": "buyers", "agg": "count_distinct", "expr": "o_custkey", "create_metric": True},
                {"name": "order_keys", "agg": "count", "expr": "o_orderkey", "create_metric": True},
            ],
        },
        {
            "name": "customers", "node_relation": {"alias": "customer"},
            "entities": [{"name": "customer", "type": "primary", "expr": "c_custkey"}, {"name": "nation", "type": "foreign", "expr": "c_nationkey"}],
            "dimensions": [{"name": "segment", "type": "categorical", "expr": "c_mktsegment"}],
            "measures": [{"name": "customers", "agg": "count", "expr": "c_custkey", "create_metric": True}],
        },
        {
            "name": "nations", "node_relation": {"alias": "nation"},
            "entities": [{"name": "nation", "type": "primary", "expr": "n_nationkey"}],
            "dimensions": [{"name": "nation_name", "type": "categorical", "expr": "n_name"}],
            "measures": [],
        },
        {
            "name": "items", "node_relation": {"alias": "lineitem"}, "defaults": {"agg_time_dimension": "shipped_at"},
            "entities": [{"name": "order", "type": "foreign", "expr": "l_orderkey"}],
            "dimensions": [{"name": "shipped_at", "type": "time", "expr": "l_shipdate", "type_params": {"time_granularity": "day"}}, {"name": "return_flag", "type": "categorical", "expr": "l_returnflag"}],
            "measures": [{"name": "quantity", "agg": "sum", "expr": "l_quantity", "create_metric": True}],
        },
    ],
    "metrics": [
        {"name": "revenue", "type": "simple", "type_params": {"measure": {"name": "order_total"}}},
        {"name": "average_order_value", "type": "ratio", "type_params": {"numerator": {"name": "revenue"}, "denominator": {"name": "orders"}}},
        {"name": "large_revenue", "type": "simple", "type_params": {"measure": {"name": "order_total"}}, "filter": {"where_filters": [{"where_sql_template": "{{ Dimension('order__is_large') }} = true"}]}},
        {"name": "building_revenue", "type": "simple", "type_params": {"measure": {"name": "order_total"}}, "filter": {"where_filters": [{"where_sql_template": "{{ Dimension('customer__segment') }} = 'BUILDING'"}]}},
        {"name": "running_revenue", "type": "cumulative", "type_params": {"measure": {"name": "order_total"}}},
        {"name": "large_percent", "type": "derived", "type_params": {"expr": "large / revenue * 100", "metrics": [{"name": "large_revenue", "alias": "large"}, {"name": "revenue"}]}},
    ],
}
TABLES = ("orders", "customer", "nation", "lineitem")


def compiler() -> Compiler:
    return Compiler(Manifest.parse(MANIFEST))


def session(spark: SparkSession, d: str) -> SparkSession:
    from assayer.sources.engine import Engine

    return Engine.over(spark, d, TABLES).spark


def ask(*metrics: str, by: tuple[str, ...] = (), **more):
    """The query's result, doubles to two places, columns renamed as SQL names them."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = compiler().compile(session(spark, d), MetricQuery(metrics, by, **more))
        return out.select(*[(F.round(F.col(f"`{c}`"), 2) if k == "double" else F.col(f"`{c}`")).alias(c) for c, k in out.dtypes])

    return run


def _grain(grain: str):
    return ask("revenue", by=(f"metric_time__{grain}",)), f"SELECT CAST(date_trunc('{grain}', o_orderdate) AS DATE) AS metric_time__{grain}, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1"


_ORDERS = "FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
_BOTH = {
    "sl_simple": (ask("revenue", "orders"), "SELECT round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders"),
    "sl_measure_sum": (ask("quantity", by=("return_flag",)), "SELECT l_returnflag AS return_flag, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1"),
    "sl_measure_count": (ask("order_keys", by=("order_status",)), "SELECT o_orderstatus AS order_status, count(o_orderkey) AS order_keys FROM orders GROUP BY 1"),
    "sl_measure_count_distinct": (ask("buyers", by=("order__order_status",)), "SELECT o_orderstatus AS order__order_status, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1"),
    "sl_measure_average": (ask("mean_price"), "SELECT round(avg(o_totalprice), 2) AS mean_price FROM orders"),
    "sl_ratio": (ask("average_order_value", by=("customer__segment",)), f"SELECT c_mktsegment AS customer__segment, round(sum(o_totalprice) / count(*), 2) AS average_order_value {_ORDERS} GROUP BY 1"),
    "sl_derived": (ask("large_percent", by=("order_status",)), "SELECT o_orderstatus AS order_status, round(sum(o_totalprice) FILTER (WHERE o_totalprice >= 200000) / sum(o_totalprice) * 100, 2) AS large_percent FROM orders GROUP BY 1"),
    "sl_filtered_metric": (ask("building_revenue", "revenue", by=("order_status",)), f"SELECT o_orderstatus AS order_status, round(sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING'), 2) AS building_revenue, round(sum(o_totalprice), 2) AS revenue {_ORDERS} GROUP BY 1"),
    "sl_cumulative": (ask("running_revenue", by=("metric_time__month",)), "SELECT m AS metric_time__month, round(sum(s) OVER (ORDER BY m), 2) AS running_revenue FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, sum(o_totalprice) AS s FROM orders GROUP BY 1)"),
    **{f"sl_grain_{g}": _grain(g) for g in ("day", "week", "month", "quarter", "year")},
    "sl_group_by_entity": (ask("revenue", by=("nation__nation_name",)), f"SELECT n_name AS nation__nation_name, round(sum(o_totalprice), 2) AS revenue {_ORDERS} GROUP BY 1"),
    "sl_where": (ask("revenue", by=("customer__segment",), where=("{{ Dimension('order__order_status') }} = 'F'", "{{ TimeDimension('metric_time', 'year') }} >= '1995-01-01'")), f"SELECT c_mktsegment AS customer__segment, round(sum(o_totalprice), 2) AS revenue {_ORDERS} WHERE o_orderstatus = 'F' AND date_trunc('year', o_orderdate) >= DATE '1995-01-01' GROUP BY 1"),
    "sl_where_expr_dim": (ask("orders", where=("{{ Dimension('order__is_large') }}",)), "SELECT count(*) AS orders FROM orders WHERE o_totalprice >= 200000"),
    "sl_two_dims": (ask("orders", by=("customer__segment", "order_status")), f"SELECT c_mktsegment AS customer__segment, o_orderstatus AS order_status, count(*) AS orders {_ORDERS} GROUP BY 1, 2"),
    "sl_multi_metric": (ask("revenue", "quantity", "average_order_value", by=("order__order_status",)), "SELECT o_orderstatus AS order__order_status, round(revenue, 2) AS revenue, round(quantity, 2) AS quantity, round(revenue / n, 2) AS average_order_value FROM (SELECT o_orderstatus, sum(o_totalprice) AS revenue, count(*) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT o_orderstatus, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) USING (o_orderstatus)"),
    "sl_top_k": (ask("revenue", by=("nation__nation_name",), order_by=("-revenue",), limit=3), f"SELECT n_name AS nation__nation_name, round(sum(o_totalprice), 2) AS revenue {_ORDERS} GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 3"),
}


def sl_group_by_items(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in compiler().group_by_items("quantity")], "name string")


SPECS = (
    ("same", MetricQuery(("revenue", "orders"), ("order_status",))),
    ("other_order", MetricQuery(("orders", "revenue"), ("order__order_status",))),
    ("other_dimension", MetricQuery(("revenue", "orders"), ("customer__segment",))),
    ("means_nothing", MetricQuery(("revenue", "orders"), ("nothing",))),
)


def sl_spec_equivalence(spark: SparkSession, d: str) -> DataFrame:
    case = MetricCase("c", "?", SPECS[0][1])
    found = [(n, s.verdict, s.basis) for n, q in SPECS for s in [SpecEquivalence(compiler()).score(spark, case, q)]]
    return spark.createDataFrame(found, "spec string, verdict string, basis string")


def sl_result_equivalence(spark: SparkSession, d: str) -> DataFrame:
    own = session(spark, d)
    case = MetricCase("c", "?", MetricQuery(("revenue",), ("order_status",)))
    nobody = "{{ Dimension('order__order_status') }} = 'nothing'"
    empty = MetricCase("e", "?", MetricQuery(("revenue",), ("order_status",), (nobody,)))
    asked = (
        ("renamed", case, MetricQuery(("revenue",), ("order__order_status",))),
        ("wider", case, MetricQuery(("revenue", "orders"), ("order_status",))),
        ("finer", case, MetricQuery(("revenue",), ("order_status", "metric_time__year"))),
        ("other", case, MetricQuery(("orders",), ("order_status",))),
        ("both_empty", empty, MetricQuery(("revenue", "orders"), ("order_status",), (nobody,))),
        ("one_empty", empty, MetricQuery(("revenue",), ("order_status",))),
        ("means_nothing", case, MetricQuery(("nothing",))),
    )
    found = [(n, ResultEquivalence(compiler()).score(own, c, q).verdict) for n, c, q in asked]
    return spark.createDataFrame(found, "spec string, verdict string")


QUERIES = {k: v[0] for k, v in _BOTH.items()} | {f.__name__: f for f in (sl_group_by_items, sl_spec_equivalence, sl_result_equivalence)}
ORACLES = {k: v[1] for k, v in _BOTH.items()} | {
    "sl_group_by_items": "SELECT unnest(['metric_time', 'order__customer__segment', 'order__is_large', 'order__order_status', 'order__ordered_at', 'return_flag', 'shipped_at']) AS name",
    "sl_spec_equivalence": "SELECT * FROM (VALUES ('same', 'pass', 'proven'), ('other_order', 'pass', 'proven'), ('other_dimension', 'inconclusive', NULL), ('means_nothing', 'fail', 'proven')) v(spec, verdict, basis)",
    "sl_result_equivalence": "SELECT * FROM (VALUES ('renamed', 'pass'), ('wider', 'pass'), ('finer', 'fail'), ('other', 'fail'), ('both_empty', 'pass'), ('one_empty', 'fail'), ('means_nothing', 'inconclusive')) v(spec, verdict)",
}
