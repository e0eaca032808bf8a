"""SQL that passes through the engine unchanged: constructs that users' statements hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.sources.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")

#: Name, Spark SQL, and DuckDB SQL where it is written otherwise.
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "semi_anti": (
        "SELECT c_mktsegment, count(*) AS n FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey GROUP BY 1 UNION ALL SELECT concat('no ', c_mktsegment), count(*) FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey GROUP BY 1",
        "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1 UNION ALL SELECT concat('no ', c_mktsegment), count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1",
    ),
    "joins": ("SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey RIGHT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", None),
    "self_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "window": ("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS r, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", None),
    "cube_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "setops": ("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)", None),
    "cte": ("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), by_customer AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT n AS orders, count(*) AS customers FROM by_customer GROUP BY 1", None),
    "recursive_cte": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t", None),
    "values": ("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(id, name)", None),
    "distinct_arithmetic": ("SELECT c_mktsegment, count(o_orderkey) / count(DISTINCT c_custkey) AS per_customer FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", "SELECT c_mktsegment, count(o_orderkey) / CAST(count(DISTINCT c_custkey) AS DOUBLE) AS per_customer FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "coalesce_group": ("SELECT c_custkey, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 DESC, 1", None),
    "date": ("SELECT o_orderkey, datediff(DAY, o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS days, year(o_orderdate) AS y, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders", "SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS days, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders"),
    "date_spine": ("SELECT d FROM (SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 DAY)) AS d)", "SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 DAY) t(d)"),
    "array": ("SELECT o_custkey, array_join(array_sort(collect_set(o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1"),
    "map": ("SELECT n_name, map('key', n_nationkey, 'region', n_regionkey)['region'] AS region FROM nation", "SELECT n_name, n_regionkey AS region FROM nation"),
    "json": ("SELECT get_json_object(concat('{\"a\":', n_nationkey, ',\"b\":[', n_regionkey, ']}'), '$.b[0]') AS b, count(*) AS n FROM nation GROUP BY 1", "SELECT CAST(n_regionkey AS VARCHAR) AS b, count(*) AS n FROM nation GROUP BY 1"),
    "string": ("SELECT n_name, upper(substr(n_name, 1, 3)) AS head, length(n_name) AS size, replace(lower(n_name), 'a', '_') AS r FROM nation WHERE n_name LIKE '%A%'", "SELECT n_name, upper(substr(n_name, 1, 3)) AS head, CAST(length(n_name) AS INTEGER) AS size, replace(lower(n_name), 'a', '_') AS r FROM nation WHERE n_name LIKE '%A%'"),
    "bitwise_nulls": ("SELECT n_nationkey & 3 AS a, n_nationkey | 4 AS o, n_nationkey ^ 1 AS x, nvl(nullif(n_regionkey, 0), -1) AS v, n_regionkey <=> NULL AS e FROM nation", "SELECT n_nationkey & 3 AS a, n_nationkey | 4 AS o, xor(n_nationkey, 1) AS x, coalesce(nullif(n_regionkey, 0), -1) AS v, n_regionkey IS NOT DISTINCT FROM NULL AS e FROM nation"),
}


def passthrough(sql: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Engine.over(spark, d, TABLES).execute(sql).df

    return run


QUERIES = {f"sql_passthrough_{k}": passthrough(sql) for k, (sql, _) in STATEMENTS.items()}
ORACLES = {f"sql_passthrough_{k}": duck or sql for k, (sql, duck) in STATEMENTS.items()}
