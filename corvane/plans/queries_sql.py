"""Queries in the dialect's own SQL text, where it differs from Spark's."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corvane.functions.types import DialectError
from corvane.operators import relational as R
from corvane.operators.dml import Table
from corvane.sources.tables import table
from corvane.streaming.results import batches

from .database import Database
from .registry import dialect, query

dialect(
    "sql_distinct_on",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS FIRST, o_orderkey",
    "orders",
)
dialect(
    "sql_integers_and_arrays",
    "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, -l_orderkey % 7 AS r, ARRAY[l_orderkey, l_partkey][2] AS second, 3 = ANY(ARRAY[l_linenumber, 3]) AS any3, round(l_quantity / 2.0) AS half FROM lineitem WHERE l_quantity > 45.0",
    "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, (-l_orderkey) % 7 AS r, l_partkey AS second, true AS any3, round_even(l_quantity / 2, 0) AS half FROM lineitem WHERE l_quantity > 45",
    "lineitem",
)
dialect(
    "sql_aggregates",
    "SELECT o_orderstatus AS status, avg(l_linenumber) AS mean, sum(l_linenumber) AS total, count(DISTINCT l_suppkey) AS suppliers, max(extract(year FROM o_orderdate)) AS year FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus HAVING count(*) > 10 ORDER BY 1 DESC",
    "SELECT o_orderstatus AS status, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS mean, CAST(sum(l_linenumber) AS BIGINT) AS total, count(DISTINCT l_suppkey) AS suppliers, CAST(max(extract(year FROM o_orderdate)) AS DOUBLE) AS year FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus HAVING count(*) > 10",
    "orders", "lineitem",
)
dialect(
    "sql_lateral_series",
    "SELECT n.n_nationkey, g FROM nation AS n, generate_series(n.n_regionkey, 3) AS g WHERE n.n_name LIKE 'N%' OR n.n_nationkey BETWEEN 3 AND 9",
    "SELECT n_nationkey, g FROM nation, LATERAL (SELECT unnest(generate_series(n_regionkey, 3)) AS g) WHERE n_name LIKE 'N%' OR n_nationkey BETWEEN 3 AND 9",
    "nation",
)
dialect(
    "sql_dates",
    "SELECT o_orderkey, o_orderdate + INTERVAL '1 month 12 hours' AS later, substring(o_orderpriority FROM 0 FOR 3) AS p, left(o_orderpriority, -2) AS l, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL 12 HOUR AS later, substring(o_orderpriority, 1, 2) AS p, \"left\"(o_orderpriority, -2) AS l, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'",
    "orders",
)
dialect(
    "sql_correlated",
    "SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000.0) ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 25",
    "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000.0) ORDER BY c.c_acctbal DESC NULLS FIRST, c.c_custkey LIMIT 25",
    "customer", "orders",
)
dialect(
    "sql_update_returning",
    "UPDATE orders SET o_totalprice = o_totalprice + 1.5 WHERE o_orderstatus = 'P' RETURNING o_orderkey, o_totalprice AS raised",
    "SELECT o_orderkey, o_totalprice + 1.5::DOUBLE AS raised FROM orders WHERE o_orderstatus = 'P'",
    "orders",
)
dialect(
    "sql_in_value_nulls",
    "SELECT n_nationkey, n_regionkey IN (SELECT CASE WHEN r_regionkey < 3 THEN r_regionkey END FROM region) AS among, n_regionkey NOT IN (SELECT CASE WHEN r_regionkey < 3 THEN r_regionkey END FROM region) AS not_among, nullif(n_nationkey, 3) IN (SELECT r_regionkey FROM region) AS nulled, n_nationkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS empty, n_regionkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < n_nationkey) AS correlated FROM nation WHERE n_nationkey < 3 OR n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 3)",
    "SELECT n_nationkey, n_regionkey IN (SELECT CASE WHEN r_regionkey < 3 THEN r_regionkey END FROM region) AS among, n_regionkey NOT IN (SELECT CASE WHEN r_regionkey < 3 THEN r_regionkey END FROM region) AS not_among, nullif(n_nationkey, 3) IN (SELECT r_regionkey FROM region) AS nulled, n_nationkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS empty, n_regionkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < n_nationkey) AS correlated FROM nation WHERE n_nationkey < 3 OR n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 3)",
    "nation", "region", "supplier",
)
dialect(
    "sql_update_from_first_match",
    "UPDATE nation SET n_name = v.name FROM (VALUES (1, 'first'), (1, NULL), (2, NULL), (2, 'late'), (7, 'x')) AS v(k, name) WHERE n_regionkey = v.k RETURNING n_nationkey, n_name",
    "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'first' END AS n_name FROM nation WHERE n_regionkey IN (1, 2)",
    "nation",
)
dialect(
    "sql_exists_depth2",
    "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 10.0 AND l.l_suppkey <> c.c_nationkey))",
    "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 10.0 AND l.l_suppkey <> c.c_nationkey))",
    "customer", "orders", "lineitem",
)
dialect(
    "sql_exists_depth3",
    "SELECT r.r_regionkey FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_suppkey > r.r_regionkey + 1 AND s.s_acctbal > CAST(n.n_nationkey AS double precision) * 300.0)))",
    "SELECT r.r_regionkey FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_suppkey > r.r_regionkey + 1 AND s.s_acctbal > CAST(n.n_nationkey AS double precision) * 300.0)))",
    "region", "nation", "customer", "supplier",
)
dialect(
    "sql_catalog_join",
    "SELECT c.relname, a.attname, a.attnum, format_type(a.atttypid, a.atttypmod) AS type, format_type(23, -1) AS int4, t.typname FROM pg_catalog.pg_class c JOIN pg_catalog.pg_namespace s ON s.oid = c.relnamespace JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid WHERE c.relkind = 'r' AND s.nspname = 'public' ORDER BY 1, 3",
    "SELECT * FROM (VALUES ('nation', 'n_nationkey', 1, 'bigint', 'integer', 'int8'), ('nation', 'n_name', 2, 'text', 'integer', 'text'), ('nation', 'n_regionkey', 3, 'bigint', 'integer', 'int8'), ('region', 'r_regionkey', 1, 'bigint', 'integer', 'int8'), ('region', 'r_name', 2, 'text', 'integer', 'text')) AS v(relname, attname, attnum, type, int4, typname)",
    "nation", "region",
)
dialect(
    "sql_information_schema",
    "SELECT t.table_name, count(*) AS n FROM information_schema.tables t JOIN information_schema.columns c ON c.table_name = t.table_name WHERE t.table_schema = 'public' GROUP BY t.table_name ORDER BY 2 DESC, 1",
    "SELECT * FROM (VALUES ('nation', 3), ('region', 2)) AS v(table_name, n)",
    "nation", "region",
)
dialect(
    "sql_interval_text",
    "SELECT o_orderkey, CAST(CAST(concat(CAST(o_orderkey % 30 AS text), ' months ', CAST(o_custkey % 40 AS text), ' days 0', CAST(o_custkey % 10 AS text), ':05:06.5') AS interval) AS text) AS shown, o_orderdate + CAST(concat(CAST(o_custkey % 9 AS text), ' weeks') AS interval) AS later FROM orders",
    "SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey % 30 >= 24 THEN '2 years' WHEN o_orderkey % 30 >= 12 THEN '1 year' END, CASE o_orderkey % 30 % 12 WHEN 0 THEN NULL WHEN 1 THEN '1 mon' ELSE (o_orderkey % 30 % 12) || ' mons' END, CASE o_custkey % 40 WHEN 0 THEN NULL WHEN 1 THEN '1 day' ELSE (o_custkey % 40) || ' days' END, '0' || (o_custkey % 10) || ':05:06.5') AS shown, o_orderdate + to_days(CAST(o_custkey % 9 * 7 AS INTEGER)) AS later FROM orders",
    "orders",
)


def _rows(spark, folder, *statements: str, tables: tuple[str, ...] = ()):
    """The rows of the last statement, after the others, over the folder's tables."""
    database = Database(spark)
    for t in tables:
        rows = table(spark, folder, t)
        kinds = {f.name: {"string": "text", "int": "bigint", "timestamp_ntz": "timestamp"}.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in rows.schema}
        database.tables["public", t] = Table(t, kinds, rows)
    for statement in statements[:-1]:
        database.sql(statement)
    return database.sql(statements[-1])


@query("SELECT 5 AS first, 7 AS second, 7 AS current, 11 AS moved, 13 AS after")
def sql_sequence_functions(spark, folder):
    return _rows(spark, folder, "CREATE SEQUENCE s START WITH 5 INCREMENT BY 2", "SELECT nextval('s') AS first, nextval('s') AS second, currval('s') AS current, setval('s', 11) AS moved, nextval('s') AS after")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS title, CAST(2 AS BIGINT) AS rank FROM nation")
def sql_alter_table(spark, folder):
    changes = ["ADD COLUMN rank double precision DEFAULT 2.5", "ALTER COLUMN rank TYPE int", "RENAME COLUMN n_name TO title", "DROP COLUMN n_regionkey", "ADD PRIMARY KEY (n_nationkey)"]
    return _rows(spark, folder, *(f"ALTER TABLE nation {c}" for c in changes), "SELECT n_nationkey, title, rank FROM nation", tables=("nation",))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def sql_cursor_fetch(spark, folder):
    database = Database(spark)
    database.tables["public", "orders"] = Table("orders", {"o_orderkey": "bigint", "o_totalprice": "double precision"}, table(spark, folder, "orders").select("o_orderkey", "o_totalprice"))
    database.sql("DECLARE top CURSOR FOR SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
    return database.sql("FETCH 5 FROM top").unionAll(database.sql("FETCH 2 FROM top"))


@query("SELECT '8MB' AS set, '4MB' AS reset")
def sql_settings(spark, folder):
    database = Database(spark)
    database.sql("SET work_mem = '8MB'")
    changed = database.sql("SHOW work_mem").toDF("set")
    database.sql("RESET work_mem")
    return changed.crossJoin(F.broadcast(database.sql("SHOW work_mem").toDF("reset")))  # one row each


@query("SELECT 'public' AS space, 'corvane' AS base, true AS allowed, 0 AS size, 'integer' AS kind")
def sql_session_functions(spark, folder):
    return _rows(spark, folder, "SELECT current_schema() AS space, current_database() AS base, has_table_privilege('nation', 'select') AS allowed, pg_table_size('nation') AS size, format_type(23, -1) AS kind", tables=("nation",))


#: Statements that are refused, and how.
_REFUSED = (
    ("INSERT INTO nation VALUES (99, 'x', -1)", "23514"), ("INSERT INTO nation VALUES (1, 'x', 1)", "23505"), ("INSERT INTO nation VALUES (NULL, 'x', 1)", "23502"),
    ("SELECT DATE '2024-01-02' - DATE '2024-01-01'", "42804"), ("SELECT TIMESTAMP '2024-01-02 00:00:00' - TIMESTAMP '2024-01-01 00:00:00'", "42804"), ("SELECT true::double precision", "0A000"), ("SELECT DATE '2024-01-02'::int", "0A000"),
    ("SELECT n_name, count(*) FROM nation", "42803"), ("SELECT 1 FROM nation a JOIN nation b ON EXISTS (SELECT 1 FROM nation)", "0A000"), ("SELECT 1 FROM nation ORDER BY (SELECT 1)", "0A000"), ("SELECT * FROM nowhere", "42P01"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{state}')" for i, (_, state) in enumerate(_REFUSED)) + ") AS v(statement, state)")
def sql_refused(spark, folder):
    database, found = Database(spark), []
    rows = table(spark, folder, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS n_nationkey", "n_name", "CAST(n_regionkey AS BIGINT) AS n_regionkey")
    database.tables["public", "nation"] = Table("nation", {"n_nationkey": "bigint", "n_name": "text", "n_regionkey": "bigint"}, rows, primary_key=("n_nationkey",), checks={"positive": F.col("n_regionkey") >= 0})
    for i, (statement, _) in enumerate(_REFUSED):
        try:
            database.sql(statement)
            found.append((i, "accepted"))
        except DialectError as error:
            found.append((i, error.state))
        except AnalysisException as error:
            found.append((i, error.getSqlState()))
    return spark.createDataFrame(found, "statement int, state string")


@query("SELECT batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 4096 AS batch FROM orders) GROUP BY batch")
def result_batches(spark, folder):
    """Rows come in batches, one partition after another."""
    sizes = [(i, len(b)) for i, b in enumerate(batches(table(spark, folder, "orders").select("o_orderkey"), 4096))]
    return spark.createDataFrame(sizes, "batch bigint, n bigint")


@query("SELECT head, row_number() OVER (ORDER BY head DESC) AS place FROM (SELECT DISTINCT substring(text, 1, 3) AS head FROM documents WHERE text IS NOT NULL)")
def text_order_by_code_point(spark, folder):
    heads = table(spark, folder, "documents").filter("text IS NOT NULL").select(F.substring("text", 1, 3).alias("head")).distinct()
    ordered = heads.orderBy(R.ordered("head", descending=True)).collect()  # a few hundred
    return spark.createDataFrame([(r.head, i + 1) for i, r in enumerate(ordered)], "head string, place bigint")


@query("SELECT true AS plan, true AS counted, count(*) AS n FROM nation WHERE n_regionkey > 1")
def sql_explain_analyze(spark, folder):
    """The plan of a query that ran, with the rows of its last node."""
    lines = [r[0] for r in _rows(spark, folder, "EXPLAIN ANALYZE SELECT n_name FROM nation WHERE n_regionkey > 1", tables=("nation",)).collect()]
    counts = [int(x.split("actual rows=")[1].split()[0]) for x in lines if "actual rows=" in x]
    return spark.createDataFrame([(any("Scan" in x for x in lines), bool(counts), counts[0] if counts else -1)], "plan boolean, counted boolean, n bigint")
