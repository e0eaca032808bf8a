"""The queries of the verification engine on the driver's tables, and DuckDB SQL that says the same."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

from assayer import benchmark
from assayer.catalog_semantic import ORACLES as SEMANTIC_ORACLES
from assayer.catalog_semantic import QUERIES as SEMANTIC
from assayer.catalog_sql import ORACLES as SQL_ORACLES
from assayer.catalog_sql import QUERIES as SQL
from assayer.functions.tolerance import rounded, scale_of
from assayer.model import Comparison, EvalCase, Expectation, ExpectationSuite, GoldQuery, Rows
from assayer.operators import diff, expect
from assayer.operators.accuracy import BIRD, SPIDER, ExecutionAccuracy, by_position, fingerprints
from assayer.operators.align import aligned, reconcile, relation, type_mismatches
from assayer.plans.equivalence import equivalent, unstable
from assayer.score import FirstDecisive, ResultSetEquivalence, SemanticEquivalence, observed_equivalence
from assayer.score import ExecutionAccuracy as AccuracyScorer
from assayer.sources import cases
from assayer.sources.engine import Budget, Engine, ddl

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "labels", "documents")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# Bags: lineitem against itself with rows taken out and doubled.

BAG = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]
BAG_SQL = f"""WITH e AS (SELECT {', '.join(BAG)} FROM lineitem), a AS (SELECT {', '.join(BAG)} FROM lineitem WHERE l_orderkey % 17 <> 0 UNION ALL SELECT {', '.join(BAG)} FROM lineitem WHERE l_orderkey % 19 = 0)"""


def bags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "lineitem").select(*BAG)
    return e, e.where("l_orderkey % 17 <> 0").unionAll(e.where("l_orderkey % 19 = 0"))


@query(f"{BAG_SQL} SELECT count(*) AS missing FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a)")
def bag_missing_count(spark, d):
    return diff.bag_counts(*bags(spark, d), BAG).select("missing")


@query(f"{BAG_SQL} SELECT count(*) AS extra FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e)")
def bag_extra_count(spark, d):
    return diff.bag_counts(*bags(spark, d), BAG).select("extra")


@query(f"{BAG_SQL} SELECT * FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a) ORDER BY ALL LIMIT 20")
def bag_diff_sample(spark, d):
    return diff.bag_sample(*bags(spark, d), BAG)


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def bag_multiplicity(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(38,18)), 2) AS DOUBLE) AS p FROM orders),
a AS (SELECT o_orderkey, CAST(round(CAST(o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 0.001 WHEN o_orderkey % 5 = 0 THEN 0.02 ELSE 0 END AS DECIMAL(38,18)), 2) AS DOUBLE) AS p FROM orders)
SELECT (SELECT count(*) FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a)) AS missing, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e)) AS extra""")
def bag_diff_tolerance(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    a = e.withColumn("o_totalprice", F.col("o_totalprice") + F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 0.001D WHEN o_orderkey % 5 = 0 THEN 0.02D ELSE 0D END"))
    return diff.bag_counts(*diff.prepared(e, a, e.columns, e.schema, 0.01), e.columns)


@query("""WITH e AS (SELECT o_orderstatus AS cnt, o_orderpriority AS rn, o_custkey AS __n FROM orders), a AS (SELECT * FROM e WHERE __n % 2 = 0)
SELECT (SELECT count(*) FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a)) AS missing, CAST(0 AS BIGINT) AS extra""")
def marker_collision(spark, d):
    e = table(spark, d, "orders").selectExpr("o_orderstatus AS cnt", "o_orderpriority AS rn", "o_custkey AS __n")
    return diff.bag_counts(e, e.where("__n % 2 = 0"), e.columns)


NULLS_SQL = "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def with_nulls(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query(f"SELECT count(*) AS n FROM ({NULLS_SQL}) a JOIN ({NULLS_SQL}) b ON a.doc_id = b.doc_id AND a.quality IS NOT DISTINCT FROM b.quality")
def null_safe_eq(spark, d):
    a, b = with_nulls(spark, d).alias("a"), with_nulls(spark, d).alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & F.col("a.quality").eqNullSafe(F.col("b.quality"))).agg(F.count("*").alias("n"))


# Keyed rows: orders with changed, lost and new rows.

KEYED = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
KEYED_SQL = f"""WITH e AS (SELECT {', '.join(KEYED)} FROM orders), a AS (
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 11 = 0 THEN 0.5 WHEN o_orderkey % 5 = 0 THEN 0.005 ELSE 0 END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 23 = 0)"""


def keyed(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "orders").select(*KEYED)
    status = F.expr("CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END")
    price = F.expr("o_totalprice + CASE WHEN o_orderkey % 11 = 0 THEN 0.5D WHEN o_orderkey % 5 = 0 THEN 0.005D ELSE 0D END")
    a = e.where("o_orderkey % 7 <> 0").select("o_orderkey", status.alias("o_orderstatus"), price.alias("o_totalprice"), "o_orderpriority")
    return e, a.unionAll(e.where("o_orderkey % 23 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))


KEYED_STATS_SQL = KEYED_SQL + """ SELECT count(*) FILTER (WHERE a.o_orderkey IS NULL) AS missing, count(*) FILTER (WHERE e.o_orderkey IS NULL) AS extra,
count(*) FILTER (WHERE e.o_orderkey = a.o_orderkey AND e.o_orderstatus IS DISTINCT FROM a.o_orderstatus) AS m_o_orderstatus,
count(*) FILTER (WHERE e.o_orderkey = a.o_orderkey AND abs(e.o_totalprice - a.o_totalprice) > 0.01) AS m_o_totalprice,
count(*) FILTER (WHERE e.o_orderkey = a.o_orderkey AND e.o_orderpriority IS DISTINCT FROM a.o_orderpriority) AS m_o_orderpriority
FROM e FULL JOIN a ON e.o_orderkey = a.o_orderkey"""


@query(KEYED_STATS_SQL)
def keyed_diff_stats(spark, d):
    e, a = keyed(spark, d)
    return diff.keyed_stats(e, a, ["o_orderkey"], KEYED, e.schema, tolerance=0.01)


@query(f"SELECT c AS column_name, n FROM (UNPIVOT ({KEYED_STATS_SQL}) ON m_o_orderstatus, m_o_totalprice, m_o_orderpriority INTO NAME c VALUE n) WHERE n > 0".replace("SELECT c AS column_name, n", "SELECT replace(c, 'm_', '') AS column_name, n"))
def keyed_column_mismatches(spark, d):
    stats = keyed_diff_stats(spark, d)
    names = [c for c in stats.columns if c.startswith("m_")]
    return stats.select(F.explode(F.array(*[F.struct(F.lit(c[2:]).alias("column_name"), F.col(c).alias("n")) for c in names])).alias("x")).select("x.*").where("n > 0")


@query(KEYED_SQL + " SELECT e.* FROM e LEFT JOIN a USING (o_orderkey) WHERE a.o_orderkey IS NULL ORDER BY ALL LIMIT 20")
def keyed_missing_sample(spark, d):
    return diff.keyed_sample(*keyed(spark, d), ["o_orderkey"], KEYED, "missing")


@query(KEYED_SQL + " SELECT a.* FROM a LEFT JOIN e USING (o_orderkey) WHERE e.o_orderkey IS NULL ORDER BY ALL LIMIT 20")
def keyed_extra_sample(spark, d):
    return diff.keyed_sample(*keyed(spark, d), ["o_orderkey"], KEYED, "extra")


@query("SELECT count(*) AS duplicates FROM (SELECT 1 FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def keyed_dupes_count(spark, d):
    return diff.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH e AS (SELECT conv_id, turn, role, text FROM conversations), a AS (SELECT conv_id, turn, CASE WHEN turn = 1 AND conv_id % 4 = 0 THEN 'x' ELSE role END AS role, text FROM conversations WHERE (conv_id + turn) % 9 <> 0)
SELECT count(*) FILTER (WHERE a.conv_id IS NULL) AS missing, count(*) FILTER (WHERE e.conv_id IS NULL) AS extra, count(*) FILTER (WHERE a.conv_id = e.conv_id AND a.role <> e.role) AS m_role, count(*) FILTER (WHERE a.conv_id = e.conv_id AND a.text <> e.text) AS m_text
FROM e FULL JOIN a ON e.conv_id = a.conv_id AND e.turn = a.turn""")
def keyed_composite_key(spark, d):
    e = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    a = e.where("(conv_id + turn) % 9 <> 0").withColumn("role", F.expr("CASE WHEN turn = 1 AND conv_id % 4 = 0 THEN 'x' ELSE role END"))
    return diff.keyed_stats(e, a, ["conv_id", "turn"], e.columns, e.schema)


# Alignment, types, authored rows, execution.


@query("SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def aligned_projection(spark, d):
    actual = table(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return aligned(actual, reconcile(actual.columns, ["o_totalprice", "o_orderkey", "other"]).shared)


@query("SELECT o_custkey * 2 + 1 AS v FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') t")
def wrap_projection(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey * 2 + 1 AS v")


@query("SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(38,18)), 4) AS DOUBLE) AS v FROM lineitem")
def tolerance_round(spark, d):
    v = F.expr("l_extendedprice * (1 - l_discount)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded(v, DoubleType(), scale_of(1e-4))["v"].cast("double").alias("v"))


INLINE = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("price", DecimalType(10, 2)), StructField("ok", BooleanType())])


@query("SELECT CAST(id AS BIGINT) AS id, name, CAST(price AS DOUBLE) AS price, ok FROM (VALUES (1, 'Ada', 10.00, true), (2, NULL, 5.50, false), (3, 'Cy''s \"x\"', NULL, NULL)) v(id, name, price, ok)")
def inline_relation(spark, d):
    from decimal import Decimal

    data = ({"id": 1, "name": "Ada", "price": Decimal("10.00"), "ok": True}, {"id": 2, "name": None, "price": Decimal("5.50"), "ok": False}, {"id": 3, "name": "Cy's \"x\"", "price": None, "ok": None})
    return relation(spark, Rows(data, INLINE)).withColumn("price", F.col("price").cast("double"))


@query("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS name WHERE false")
def inline_relation_empty(spark, d):
    return relation(spark, Rows((), StructType(INLINE.fields[:2])))


@query("SELECT * FROM (VALUES (0, 'o_orderstatus', 'string'), (1, 'n', 'bigint'), (2, 'total', 'double')) v(position, column_name, type)")
def schema_probe(spark, d):
    df = Engine.over(spark, d, ("orders",)).execute("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1").df
    return rows(spark, [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema)], "position int, column_name string, type string")


@query("SELECT * FROM (VALUES ('shared', 'o_totalprice,o_orderkey'), ('missing', 'O_CUSTKEY'), ('unexpected', 'o_orderstatus,o_custkey'), ('order_differs', 'True')) v(fact, columns)")
def column_reconciliation(spark, d):
    actual = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    c = reconcile(actual.columns, ["o_totalprice", "O_CUSTKEY", "o_orderkey"], "strict")
    return rows(spark, [("shared", ",".join(c.shared)), ("missing", ",".join(c.missing)), ("unexpected", ",".join(c.unexpected)), ("order_differs", str(c.order_differs))], "fact string, columns string")


@query("SELECT 'n_nationkey' AS column_name, 'bigint' AS expected, 'int' AS actual")
def type_mismatches_(spark, d):
    actual = table(spark, d, "nation")
    expected = actual.withColumn("n_nationkey", F.col("n_nationkey").cast("bigint"))
    return rows(spark, type_mismatches(actual.schema, expected.schema, actual.columns), "column_name string, expected string, actual string")


@query("SELECT 'duplicate_columns' AS error_kind")
def duplicate_column_guard(spark, d):
    run = Engine.over(spark, d, ("nation",)).execute("SELECT n_nationkey AS x, n_regionkey AS x FROM nation")
    return rows(spark, [(run.error.kind,)], "error_kind string")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def scan_execute(spark, d):
    return Engine.over(spark, d, ("nation", "region")).execute("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'").df


@query("SELECT count(*) AS value, CAST(2 AS BIGINT) AS errors FROM orders")
def scalar_read(spark, d):
    engine = Engine.over(spark, d, ("orders",))
    value, _ = engine.scalar("SELECT count(*) FROM orders")
    errors = sum(engine.scalar(s)[1] is not None for s in ("SELECT 1 AS a, 2 AS b", "SELECT o_orderkey FROM orders", "SELECT NULL AS x"))
    return rows(spark, [(value, errors)], "value bigint, errors bigint")


@query("SELECT * FROM (VALUES ('query_failed', '42P01', 'TABLE_OR_VIEW_NOT_FOUND'), ('query_failed', '42601', 'PARSE_SYNTAX_ERROR'), ('query_failed', '42703', 'UNRESOLVED_COLUMN.WITH_SUGGESTION')) v(kind, sqlstate, condition)")
def error_condition(spark, d):
    engine = Engine.over(spark, d, ("orders",))
    found = [engine.execute(s).error for s in ("SELECT * FROM nowhere", "SELEC 1", "SELECT nothing FROM orders")]
    return rows(spark, [(e.kind, e.sqlstate, e.condition) for e in found], "kind string, sqlstate string, condition string")


@query("SELECT * FROM (VALUES ('cancelled', 'budget_exceeded'), ('not started', 'budget_exceeded')) v(step, result)")
def budget_pool(spark, d):
    engine, gone = Engine.over(spark, d, ("orders",)), Budget(0)
    short = Budget(0.3)
    _, late = engine.action(lambda: engine.spark.range(0, 400_000_000).selectExpr("sum(id % 7 * sqrt(id)) AS s").collect(), short)
    after = engine.execute("SELECT 1", gone).error
    return rows(spark, [("cancelled", late.kind if late else "finished"), ("not started", after.kind)], "step string, result string")


DDL_TYPE = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(column_type) END"


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, 'CREATE TABLE {t} (' || chr(10) || string_agg('  ' || column_name || ' ' || {DDL_TYPE}, ',' || chr(10)) || chr(10) || ')' AS ddl FROM (DESCRIBE {t})" for t in TABLES))
def catalog_ddl(spark, d):
    return rows(spark, [(t, ddl(table(spark, d, t), t)) for t in TABLES], "table_name string, ddl string")


# Expectations.


@query("SELECT count(*) AS n FROM orders")
def row_count(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM ({NULLS_SQL}) WHERE quality IS NULL")
def not_null_count(spark, d):
    return with_nulls(spark, d).agg(F.count_if(F.col("quality").isNull()).alias("n"))


@query(f"SELECT * FROM ({NULLS_SQL}) WHERE quality IS NULL ORDER BY ALL LIMIT 20")
def not_null_sample(spark, d):
    return expect.null_sample(with_nulls(spark, d), "quality")


@query("SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1)")
def unique_count(spark, d):
    return expect.repeated_values(table(spark, d, "orders"), "o_custkey").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, o_custkey LIMIT 20")
def unique_sample(spark, d):
    return expect.unique_sample(table(spark, d, "orders"), "o_custkey")


def outcomes(spark, found) -> DataFrame:
    return rows(spark, [(k, o.expectation.kind, o.passed, o.failing_count) for k, o in enumerate(found)], "position int, kind string, passed boolean, failing bigint")


@query("SELECT 0 AS position, 'column_presence' AS kind, false AS passed, CAST(1 AS BIGINT) AS failing UNION ALL SELECT 1, 'column_presence', true, 0")
def column_presence(spark, d):
    wanted = (Expectation("column_presence", columns=("o_orderkey", "nothing")), Expectation("column_presence", columns=("o_orderkey",)))
    return outcomes(spark, expect.evaluate(table(spark, d, "orders"), ExpectationSuite(wanted)))


@query("SELECT * FROM (VALUES (0, 'column_type', true, CAST(NULL AS BIGINT)), (1, 'column_type', false, NULL), (2, 'column_type', false, NULL)) v(position, kind, passed, failing)")
def column_type(spark, d):
    wanted = (Expectation("column_type", "o_orderkey", type="BIGINT"), Expectation("column_type", "o_totalprice", type="DECIMAL(10,2)"), Expectation("column_type", "nothing", type="INT"))
    return outcomes(spark, expect.evaluate(table(spark, d, "orders"), ExpectationSuite(wanted)))


@query(f"""WITH t AS ({NULLS_SQL}) SELECT 0 AS position, 'row_count' AS kind, (SELECT count(*) FROM t) = 1000 AS passed, CAST(NULL AS BIGINT) AS failing
UNION ALL SELECT 1, 'not_null', count(*) FILTER (WHERE doc_id IS NULL) = 0, count(*) FILTER (WHERE doc_id IS NULL) FROM t
UNION ALL SELECT 2, 'not_null', count(*) FILTER (WHERE quality IS NULL) = 0, count(*) FILTER (WHERE quality IS NULL) FROM t
UNION ALL SELECT 3, 'unique', count(*) = 0, count(*) FROM (SELECT 1 FROM t WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 4, 'unique', count(*) = 0, count(*) FROM (SELECT 1 FROM t WHERE quality IS NOT NULL GROUP BY quality HAVING count(*) > 1)""")
def expectation_suite(spark, d):
    wanted = (Expectation("row_count", value=1000), Expectation("not_null", "doc_id"), Expectation("not_null", "quality"), Expectation("unique", "doc_id"), Expectation("unique", "quality"))
    return outcomes(spark, expect.evaluate(with_nulls(spark, d), ExpectationSuite(wanted)))


# Execution accuracy.

GOLD = (["o_orderkey", "o_custkey", "o_orderstatus"], "FROM orders ORDER BY o_orderkey")
PAIRS = (
    ("identity", GOLD, GOLD),
    ("reversed", GOLD, (GOLD[0], "FROM orders ORDER BY o_orderkey DESC")),
    ("permuted", GOLD, (["o_orderstatus", "o_orderkey", "o_custkey"], GOLD[1])),
    ("limited", GOLD, (GOLD[0], "FROM orders ORDER BY o_orderkey LIMIT 30")),
    ("changed", GOLD, (["o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 1000 = 7 THEN 'X' ELSE o_orderstatus END"], GOLD[1])),
    ("repeated", (["o_orderstatus"], "FROM orders"), (["DISTINCT o_orderstatus"], "FROM orders")),
    ("wider", (["o_orderkey"], "FROM orders"), (["o_orderkey", "o_custkey"], "FROM orders")),
)


def statement(columns: list[str], rest: str) -> str:
    return "SELECT " + ", ".join(f"{c} AS c{k}" for k, c in enumerate(columns)) + f" {rest}"


def verdicts(spark, d, agree) -> DataFrame:
    engine = Engine.over(spark, d, ("orders",))
    return rows(spark, [(name, agree(engine.execute(statement(*g)).df, engine.execute(statement(*m)).df, statement(*g))) for name, g, m in PAIRS], "pair string, agrees boolean")


def verdict_sql(order: str = "ignore", distinct: bool = False, by_value: bool = False) -> str:
    """Whether the pairs agree, by set operations on their rows; order counts by numbering them."""

    def agrees(g, m) -> str:
        width, strict = len(g[0]), order == "strict" or order == "auto" and "ORDER BY" in g[1]
        if width != len(m[0]):
            return "false"
        place, minus = (", row_number() OVER () AS rn" if strict else ""), "EXCEPT" if distinct and not strict else "EXCEPT ALL"
        side = lambda q, columns: "SELECT " + ", ".join(f"CAST(c{k} AS VARCHAR) AS v{i}" for i, k in enumerate(columns)) + f"{place} FROM ({statement(*q)})"
        one = side(g, range(width))
        return " OR ".join(f"(NOT EXISTS ({one} {minus} {other}) AND NOT EXISTS ({other} {minus} {one}))" for columns in (permutations(range(width)) if by_value else [range(width)]) for other in [side(m, columns)])

    return " UNION ALL ".join(f"SELECT '{name}' AS pair, {agrees(g, m)} AS agrees" for name, g, m in PAIRS)


@query(verdict_sql("strict"))
def ex_ordered(spark, d):
    return verdicts(spark, d, lambda g, m, s: ExecutionAccuracy(row_order="strict").agrees(g, m, s))


@query(verdict_sql(distinct=True))
def ex_set(spark, d):
    return verdicts(spark, d, lambda g, m, s: ExecutionAccuracy("ignore", "set").agrees(g, m, s))


@query(verdict_sql())
def ex_multiset(spark, d):
    return verdicts(spark, d, lambda g, m, s: ExecutionAccuracy("ignore").agrees(g, m, s))


@query(verdict_sql(by_value=True))
def ex_by_value(spark, d):
    return verdicts(spark, d, lambda g, m, s: ExecutionAccuracy("ignore", columns="by_value").agrees(g, m, s))


@query(verdict_sql("auto", by_value=True))
def ex_spider_preset(spark, d):
    return verdicts(spark, d, SPIDER.agrees)


@query(verdict_sql(distinct=True))
def ex_bird_preset(spark, d):
    return verdicts(spark, d, BIRD.agrees)


@query("""SELECT 'multiset' AS mode, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)) AS missing, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders)) AS extra
UNION ALL SELECT 'set', (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)), (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))""")
def ex_diff_counts(spark, d):
    g, m = by_position(table(spark, d, "orders").select("o_custkey")), by_position(table(spark, d, "customer").select("c_custkey"))
    multiset = diff.bag_counts(g, m, g.columns).withColumn("mode", F.lit("multiset"))
    return multiset.unionByName(diff.bag_counts(g, m, g.columns, distinct=True).withColumn("mode", F.lit("set"))).select("mode", "missing", "extra")


def _same_columns_sql() -> str:
    """Which columns hold the same bags of values, by set operations on each pair."""
    gold, model = ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_custkey", "o_orderpriority", "o_orderkey"]
    column = lambda c: f"SELECT CAST({c} AS VARCHAR) FROM orders"
    pairs = [f"SELECT {i} AS gold, {j} AS model WHERE NOT EXISTS ({column(a)} EXCEPT ALL {column(b)}) AND NOT EXISTS ({column(b)} EXCEPT ALL {column(a)})" for i, a in enumerate(gold) for j, b in enumerate(model)]
    return " UNION ALL ".join(pairs)


@query(_same_columns_sql())
def column_fingerprint(spark, d):
    o = by_position(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    m = by_position(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"))
    return fingerprints(o).withColumnRenamed("k", "gold").join(fingerprints(m).withColumnRenamed("k", "model"), "fingerprint").select("gold", "model")


# Plans and verdicts.

PLANS = (
    ("commuted", "SELECT n_name FROM nation WHERE n_nationkey = 1 AND n_regionkey > 2", "SELECT n_name FROM nation WHERE 2 < n_regionkey AND 1 = n_nationkey", True),
    ("folded", "SELECT n_name FROM nation WHERE n_nationkey = 2", "SELECT n_name FROM nation WHERE n_nationkey = 1 + 1", True),
    ("cte", "SELECT n_name FROM nation WHERE n_regionkey = 1", "WITH x AS (SELECT * FROM nation WHERE n_regionkey = 1) SELECT n_name FROM x", True),
    ("in_order", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2, 3)", "SELECT n_name FROM nation WHERE n_regionkey IN (3, 1, 2)", True),
    ("implied_bound", "SELECT n_name FROM nation WHERE n_regionkey > 3 AND n_regionkey > 1", "SELECT n_name FROM nation WHERE n_regionkey > 3", True),
    ("solved", "SELECT n_name FROM nation WHERE 3L - CAST(n_regionkey AS SMALLINT) > 1L", "SELECT n_name FROM nation WHERE CAST(n_regionkey AS SMALLINT) < 2", True),
    ("may_overflow", "SELECT n_name FROM nation WHERE 0 - n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = -1", False),
    ("rounded", "SELECT c_name FROM customer WHERE 0.3D - c_acctbal = 0.2D", "SELECT c_name FROM customer WHERE c_acctbal = 0.1D", False),
    ("like_a_condition", "SELECT n_name FROM nation WHERE n_name = 'x AND n_regionkey = 1'", "SELECT n_name FROM nation WHERE n_name = 'x' AND n_regionkey = 1", False),
    ("other_name", "SELECT n_name AS a FROM nation", "SELECT n_name AS b FROM nation", False),
    ("other_order", "SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name DESC", False),
    ("distinct", "SELECT n_regionkey FROM nation", "SELECT DISTINCT n_regionkey FROM nation", False),
    ("bound", "SELECT n_name FROM nation WHERE n_regionkey > 3", "SELECT n_name FROM nation WHERE n_regionkey >= 3", False),
    ("null_safe", "SELECT n_name FROM nation WHERE n_regionkey = n_nationkey", "SELECT n_name FROM nation WHERE n_regionkey <=> n_nationkey", False),
    ("unstable", "SELECT rand() AS r FROM nation", "SELECT rand() AS r FROM nation", False),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{'equivalent' if same else 'unknown'}')" for n, _, _, same in PLANS) + ") v(pair, verdict)")
def plan_equivalence(spark, d):
    own = Engine.over(spark, d, ("nation", "customer")).spark
    return rows(spark, [(name, equivalent(own, a, b)) for name, a, b, _ in PLANS], "pair string, verdict string")


@query("SELECT * FROM (VALUES ('rand()', true), ('current_date', true), ('now()', true), ('uuid()', true), ('abs(1)', false), ('upper(''x'')', false)) v(expression, flagged)")
def nondeterminism_flags(spark, d):
    return rows(spark, [(e, unstable(spark, f"SELECT {e} AS x")) for e in ("rand()", "current_date", "now()", "uuid()", "abs(1)", "upper('x')")], "expression string, flagged boolean")


def case(name: str, gold: str, **comparison) -> EvalCase:
    return EvalCase(name, name, GoldQuery(gold), Comparison(**comparison))


def scored(spark, d, scorer, todo) -> DataFrame:
    engine = Engine.over(spark, d, ("nation", "orders"))
    found = [(c.id, s.verdict, s.basis) for c, sql in todo for s in [scorer.score(engine, c, sql, Budget(None))]]
    return rows(spark, found, "case_id string, verdict string, basis string")


VERDICTS = (
    (case("proven", "SELECT n_name FROM nation WHERE n_regionkey > 2"), "SELECT n_name FROM nation WHERE 2 < n_regionkey"),
    (case("observed", "SELECT n_name FROM nation WHERE n_regionkey > 2"), "SELECT n_name FROM nation WHERE n_regionkey IN (3, 4)"),
    (case("wrong", "SELECT n_name FROM nation WHERE n_regionkey > 2"), "SELECT n_name FROM nation WHERE n_regionkey > 3"),
)


@query("SELECT * FROM (VALUES ('proven', 'pass', 'proven'), ('observed', 'pass', 'observed'), ('wrong', 'fail', 'observed')) v(case_id, verdict, basis)")
def observed_equivalence_(spark, d):
    return scored(spark, d, observed_equivalence(), VERDICTS)


@query("SELECT * FROM (VALUES ('proven', 'pass', 'proven'), ('observed', 'pass', 'observed'), ('wrong', 'fail', 'observed')) v(case_id, verdict, basis)")
def first_decisive(spark, d):
    return scored(spark, d, FirstDecisive((SemanticEquivalence(), AccuracyScorer(), ResultSetEquivalence())), VERDICTS)


@query("SELECT * FROM (VALUES ('same', 'pass', 'observed'), ('type', 'fail', 'observed'), ('rows', 'fail', 'observed'), ('column', 'fail', 'observed')) v(case_id, verdict, basis)")
def rse_keyless_verdict(spark, d):
    gold = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"
    todo = (
        (case("same", gold), "SELECT count(o_orderkey) AS n, o_orderstatus FROM orders GROUP BY o_orderstatus"),
        (case("type", gold), "SELECT o_orderstatus, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1"),
        (case("rows", gold), gold + " HAVING count(*) > 1000000"),
        (case("column", gold), "SELECT o_orderstatus FROM orders GROUP BY 1"),
    )
    return scored(spark, d, ResultSetEquivalence(), todo)


@query("SELECT * FROM (VALUES ('no_key', 'fail', CAST(NULL AS VARCHAR)), ('lost_key', 'fail', NULL), ('repeated_key', 'fail', NULL), ('gold_fails', 'fail', NULL), ('suite', 'inconclusive', NULL)) v(case_id, verdict, basis)")
def rse_guards(spark, d):
    sql = "SELECT n_nationkey, n_regionkey FROM nation"
    todo = (
        (case("no_key", sql, null_equality="distinct"), sql),
        (case("lost_key", sql, match_key=("x",)), sql),
        (case("repeated_key", sql, match_key=("n_regionkey",)), sql),
        (case("gold_fails", "SELECT * FROM nowhere"), sql),
        (EvalCase("suite", "suite", ExpectationSuite(())), sql),
    )
    return scored(spark, d, ResultSetEquivalence(), todo)


# Benchmarks.

CASES_SQL = "WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' WHEN 2 THEN 'challenging' END AS difficulty, o_orderstatus = 'F' AS passed FROM orders)"


def case_rows(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' WHEN 2 THEN 'challenging' END AS difficulty", "o_orderstatus = 'F' AS passed")


@query(f"{CASES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE passed) / CAST(count(*) AS DOUBLE) AS accuracy FROM c")
def bench_accuracy(spark, d):
    return benchmark.accuracy(case_rows(spark, d))


@query(f"{CASES_SQL} SELECT difficulty, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE passed) / CAST(count(*) AS DOUBLE) AS accuracy FROM c WHERE difficulty IS NOT NULL GROUP BY 1")
def bench_by_difficulty(spark, d):
    return benchmark.by_difficulty(case_rows(spark, d))


@query("SELECT * FROM (VALUES ('proven', 'passed', true), ('observed', 'passed', true), ('wrong', 'scored_failure', false), ('silent', 'solver_failure', false), ('broken', 'execution_failure', false)) v(case_id, outcome, passed)")
def eval_case_reports(spark, d):
    answers = {c.id: sql for c, sql in VERDICTS} | {"broken": "SELEC 1"}
    todo = [c for c, _ in VERDICTS] + [case("silent", "SELECT 1 AS x"), case("broken", "SELECT 1 AS x")]
    reports = benchmark.run_benchmark(Engine.over(spark, d, ("nation",)), todo, lambda c: answers.get(c.id))
    return benchmark.report_rows(spark, reports).select("case_id", "outcome", "passed")


@query("SELECT n_name || '-' || substr(md5(n_comment || chr(10) || q), 1, 8) AS case_id, n_name AS db_id, n_comment AS question, q AS gold_sql, CAST(NULL AS VARCHAR) AS difficulty FROM (SELECT n_name, 'How many of ' || n_nationkey AS n_comment, 'SELECT ' || n_regionkey AS q FROM nation)")
def load_cases_spider(spark, d):
    return cases.spider_rows(table(spark, d, "nation").selectExpr("n_name AS db_id", "'How many of ' || n_nationkey AS question", "'SELECT ' || n_regionkey AS query"))


@query("SELECT n_name || '-' || n_nationkey AS case_id, n_name AS db_id, 'How many?' || CASE WHEN n_regionkey > 1 THEN chr(10) || 'Evidence: region ' || n_regionkey ELSE '' END AS question, 'SELECT 1' AS gold_sql, 'simple' AS difficulty FROM nation")
def load_cases_bird(spark, d):
    raw = table(spark, d, "nation").selectExpr("n_name AS db_id", "'How many?' AS question", "CASE WHEN n_regionkey > 1 THEN 'region ' || n_regionkey ELSE ' ' END AS evidence", "'SELECT 1' AS SQL", "CAST(n_nationkey AS STRING) AS question_id", "'simple' AS difficulty")
    return cases.bird_rows(raw)


for own in (QUERIES, ORACLES):
    for name in [n for n in own if n.endswith("_")]:
        own[name.rstrip("_")] = own.pop(name)
QUERIES |= SEMANTIC | SQL
ORACLES |= SEMANTIC_ORACLES | SQL_ORACLES


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Order totals by segment: a candidate against the gold statement, as counts of missing and extra rows."""
    engine = Engine.over(spark, d, ("orders", "customer"))
    gold = engine.execute("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1").df
    model = engine.execute("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1").df
    return diff.bag_counts(*diff.prepared(gold, model, gold.columns, gold.schema, 1e-2), gold.columns)
