"""Statements in the dialect's SQL, on literal rows."""

import math
import re

import pytest

from corvane.functions.types import DialectError
from corvane.plans.database import Database


class Session:
    def __init__(self, spark):
        self.db = Database(spark)

    def __call__(self, text, *params):
        got = self.db.sql(text, *params)
        return None if got is None else [tuple(r) for r in got.collect()]

    def state(self, text, *params):
        with pytest.raises(Exception) as raised:
            self(text, *params)
        found = re.search(r"SQLSTATE:? (\w{5})", str(raised.value)) or re.search("(TOO_MANY_ROWS)", str(raised.value))
        return {"TOO_MANY_ROWS": "21000"}.get(found[1], found[1]) if found else None


@pytest.fixture
def run(spark):
    return Session(spark)


FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def tables(run):
    """The dialect and DuckDB over the same tables; called with a query, both run it."""
    import duckdb

    from corvane.operators.dml import Table

    other = duckdb.connect()
    for name in ("region", "nation", "customer", "orders"):
        rows = run.db.spark.read.parquet(f"{FOLDER}/{name}.parquet")
        kinds = {f.name: {"string": "text", "int": "bigint", "double": "double precision", "timestamp_ntz": "timestamp"}.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in rows.schema}
        run.db.tables["public", name] = Table(name, kinds, rows)
        other.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")

    def both(text, oracle=None, ordered=False):
        mine, theirs = run(text), other.execute(oracle or text).fetchall()
        assert (mine if ordered else sorted(mine, key=repr)) == (theirs if ordered else sorted(theirs, key=repr)), text
        assert mine, text

    both.run = run
    return both


def test_joins(tables):
    tables("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey > 2")
    tables("SELECT c.c_custkey, count(o.o_orderkey) FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000.0 GROUP BY c.c_custkey")
    tables("SELECT count(*) FROM nation, region")
    tables("SELECT a.n_nationkey, b.n_nationkey FROM nation a FULL JOIN nation b ON a.n_nationkey = b.n_nationkey + 20")


def test_subqueries(tables):
    tables("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
    tables("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000.0)")
    tables("SELECT r_regionkey, (SELECT max(n_name) FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey < 4) FROM region r")
    tables("SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
    tables("SELECT n_name FROM nation WHERE n_nationkey NOT IN (VALUES (1), (2), (7))")
    assert tables.run("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region)") == []
    tables("SELECT c_nationkey, count(*) FROM customer c GROUP BY c_nationkey HAVING EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c_nationkey AND n.n_regionkey = 1)")
    assert tables.run.state("SELECT (SELECT n_name FROM nation)") == "21000"


def test_in_as_a_value(tables):
    some = "(SELECT nullif(r_regionkey, 2) FROM region)"
    for text in (f"n_nationkey IN {some}", f"n_nationkey NOT IN {some}", f"NOT (n_nationkey IN {some})", f"(n_nationkey IN {some}) IS NULL", "nullif(n_nationkey, 5) IN (SELECT r_regionkey FROM region WHERE r_regionkey > 90)", f"n_regionkey = 1 OR n_nationkey IN {some}"):
        tables(f"SELECT n_nationkey, {text} AS found FROM nation")
        tables(f"SELECT n_nationkey FROM nation WHERE {text} OR n_nationkey = 9")
    tables("SELECT n_nationkey, CASE WHEN n_regionkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey < n_nationkey) THEN 'out' ELSE 'in' END FROM nation")


def test_queries_two_and_three_levels_out(tables):
    tables("SELECT r_name FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey IN (SELECT c_nationkey FROM customer c WHERE c.c_custkey % 10 = r.r_regionkey + n.n_nationkey % 2))")
    tables("SELECT r_name FROM region r WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey > r.r_regionkey * 9))")
    tables("SELECT r_regionkey, (SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) FROM region r")
    assert tables.run.state("SELECT r_name FROM region r WHERE 3 < (SELECT count(*) FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = r.r_regionkey))") == "0A000"
    assert tables.run.state("SELECT 1 FROM region a JOIN region b ON a.r_regionkey IN (SELECT 1)") == "0A000" and tables.run.state("SELECT 1 FROM region ORDER BY (SELECT 1)") == "0A000"


def test_lateral_and_ctes(tables):
    q = "SELECT c.c_custkey, x.m FROM customer c {} JOIN LATERAL (SELECT max(o_totalprice) AS m FROM orders o WHERE o.o_custkey = c.c_custkey) x ON x.m > 350000.0"
    tables(q.format("INNER"))
    tables(q.format("LEFT"))
    tables("WITH large(k) AS (SELECT o_custkey FROM orders WHERE o_totalprice > 400000.0), again AS (SELECT k FROM large) SELECT DISTINCT k FROM again ORDER BY k DESC", ordered=True)
    tables("SELECT r.r_regionkey, g FROM region r, generate_series(2, r.r_regionkey) AS g", "SELECT r_regionkey, g FROM region, LATERAL (SELECT unnest(generate_series(2, r_regionkey)) AS g)")


def test_distinct_and_order(tables):
    tables("SELECT DISTINCT ON (n_regionkey) n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name DESC", "SELECT DISTINCT ON (n_regionkey) n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name DESC NULLS FIRST", ordered=True)
    tables("SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation ORDER BY k, 2", "SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation ORDER BY k NULLS LAST, 2", ordered=True)
    tables("SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation ORDER BY k DESC, n_name LIMIT 7 OFFSET 2", "SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation ORDER BY k DESC NULLS FIRST, n_name LIMIT 7 OFFSET 2", ordered=True)
    tables("SELECT count(*) FROM nation GROUP BY 1", "SELECT count(*) FROM nation")
    tables("SELECT n_regionkey, avg(n_nationkey), sum(DISTINCT n_nationkey % 3) FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, sum(n_nationkey)::BIGINT // count(*), sum(DISTINCT n_nationkey % 3)::BIGINT FROM nation GROUP BY n_regionkey")
    assert tables.run.state("SELECT DISTINCT n_name FROM nation ORDER BY n_regionkey") == "42P10"
    assert tables.run.state("SELECT DISTINCT ON (n_name) n_name FROM nation ORDER BY n_regionkey") == "42P10"
    assert tables.run.state("SELECT count(DISTINCT *) FROM nation") == "42601"


def test_intervals_and_text(run):
    run("CREATE TABLE spans (i int, t text)")
    run("INSERT INTO spans VALUES (1, '14 months 3 days 25:00:01.25'), (2, '-2 days'), (3, '00:00:00'), (4, NULL), (5, '1 week -00:30:00')")
    assert run("SELECT CAST(CAST(t AS interval) AS text) FROM spans ORDER BY i") == [("1 year 2 mons 3 days 25:00:01.25",), ("-2 days",), ("00:00:00",), (None,), ("7 days -00:30:00",)]
    assert run("SELECT i FROM spans WHERE CAST(t AS interval) > INTERVAL '6 days' ORDER BY i") == [(1,), (5,)]
    assert run("SELECT INTERVAL '90 minutes'::text") == [("01:30:00",)]
    assert "invalid interval" in str(pytest.raises(Exception, run, "SELECT CAST(t AS interval) FROM (VALUES ('soon')) AS v(t)").value)


def test_catalogs_by_name_and_oid(run):
    run("CREATE TABLE shelf (id int PRIMARY KEY, label varchar(7) UNIQUE, price numeric(8, 2) NOT NULL)")
    run("CREATE TABLE book (id int PRIMARY KEY, shelf int REFERENCES shelf (id), CHECK (id > 0))")
    run("CREATE UNIQUE INDEX shelf_price ON shelf (price)")
    columns = "SELECT a.attname, format_type(a.atttypid, a.atttypmod), a.attnotnull FROM pg_catalog.pg_class c JOIN pg_catalog.pg_attribute a ON a.attrelid = c.oid WHERE c.relname = 'shelf' ORDER BY a.attnum"
    assert run(columns) == [("id", "integer", True), ("label", "character varying", False), ("price", "numeric", True)]
    found = run("SELECT c.relname, pg_get_constraintdef(k.oid) FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid WHERE k.contype IN ('p', 'u', 'f')")
    assert sorted(found) == [("book", "FOREIGN KEY (shelf) REFERENCES shelf(id)"), ("book", "PRIMARY KEY (id)"), ("shelf", "PRIMARY KEY (id)"), ("shelf", "UNIQUE (label)")]
    assert run("SELECT pg_get_indexdef(i.indexrelid) FROM pg_index i") == [("CREATE UNIQUE INDEX shelf_price ON shelf USING btree (price)",)]
    assert run("SELECT format_type(23, -1), format_type(1043, 11), format_type(1700, 524294), format_type(99, -1)") == [("integer", "character varying(7)", "numeric(8,2)", None)]
    assert run("SELECT count(*) FROM pg_depend d JOIN pg_class c ON c.oid = d.refobjid WHERE c.relname = 'shelf'") == [(3,)]
    assert run("SELECT table_name FROM information_schema.tables WHERE table_schema = 'public' ORDER BY 1") == [("book",), ("shelf",)]


def test_the_first_match_is_the_first_in_order(run):
    run("CREATE TABLE tank (k int PRIMARY KEY, level int)")
    run("INSERT INTO tank VALUES (1, 0), (2, 0), (3, 0)")
    run("CREATE TABLE reading (tank int, level int)")
    for values in ("(2, 71), (1, NULL)", "(1, 72), (2, NULL)", "(2, 3)"):
        run(f"INSERT INTO reading VALUES {values}")
    run("UPDATE tank SET level = reading.level FROM reading WHERE reading.tank = k")
    assert run("SELECT k, level FROM tank ORDER BY k") == [(1, None), (2, 71), (3, 0)]
    assert run.state("UPDATE tank SET k = 2 WHERE k = 1") == "23505"
    run("UPDATE tank SET k = k + 10")
    assert run("SELECT k FROM tank ORDER BY k") == [(11,), (12,), (13,)]


def test_set_operations(run):
    a, b = "VALUES (1), (2), (3)", "VALUES (2), (3), (4)"
    assert run(f"{a} UNION {b} ORDER BY 1") == [(1,), (2,), (3,), (4,)]
    assert run(f"{a} INTERSECT {b} ORDER BY column1") == [(2,), (3,)] and run(f"{a} EXCEPT {b}") == [(1,)]
    assert run("(SELECT 1 AS x UNION ALL SELECT NULL) ORDER BY x DESC") == [(None,), (1,)]
    assert run.state("SELECT 1 UNION SELECT 1.5") == "42804"


def test_expressions(run):
    assert run("SELECT 7 / 2, -7 / 2, -7 % 2, 1.5 * 2, 2.5::int, 3.5::int, round(2.5), floor(2.5), ceil(2.5), sqrt(9), power(2, 10), mod(7, 3), abs(-5)") == [(3, -3, -1, 3.0, 2, 4, 2.0, 2.0, 3.0, 3.0, 1024.0, 1, 5)]
    assert run("SELECT concat('maple', NULL, '?'), replace('banana', 'an', 'AN'), position('na' IN 'banana'), left('maple', -2), right('maple', 2), substring('maple' FROM 0 FOR 2), substring('maple', -2, 3), trim('  x '), length('é'), upper('a') || 'b'") == [("maple?", "bANANa", 3, "map", "le", "m", "", "x", 1, "Ab")]
    assert run("SELECT ARRAY[10, 20, NULL][2], ARRAY[[1,2],[3,4]][2][1], ARRAY[1][5], 20 = ANY(ARRAY[10, 20, NULL]), 9 = ANY(ARRAY[1, NULL])") == [(20, 3, None, True, None)]
    assert run("SELECT CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END, CASE WHEN false THEN 1 END, coalesce(NULL, 5), nullif(5, 5), 1 IS DISTINCT FROM NULL, NULL IS NULL, 5 BETWEEN 1 AND 5, 3 NOT IN (1, 2)") == [("b", None, 5, None, True, True, True, True)]
    assert run("SELECT 'a_b%c' LIKE 'a#_b#%c' ESCAPE '#', 'Quince' ILIKE 'q%E', 'a\\x' LIKE 'a\\x', 'x' NOT LIKE 'y%'") == [(True, True, True, True)]
    assert run("SELECT $1 + 1, $2 || 'b', $3", 41, "a", None) == [(42, "ab", None)]
    nan, *rest = run("SELECT 'NaN'::double precision, 'true'::boolean, true::text, '12.345'::numeric(6, 2)::text")[0]
    assert math.isnan(nan) and rest == [True, "true", "12.35"]


def test_time(run):
    assert str(run("SELECT DATE '2024-01-31' + INTERVAL '1 month'")[0][0]) == "2024-02-29 00:00:00"
    assert str(run("SELECT TIMESTAMP '2024-01-01 10:00:00' - INTERVAL '1 day 02:30:00'")[0][0]) == "2023-12-31 07:30:00"
    assert run("SELECT extract(year FROM DATE '2024-05-06'), extract(second FROM TIMESTAMP '2024-01-01 00:00:01.5')") == [(2024.0, 1.5)]
    assert run("SELECT INTERVAL '1 mon' = INTERVAL '30 days', INTERVAL '1 mon' < INTERVAL '31 days', INTERVAL '2 days' > INTERVAL '1 day'") == [(True, True, True)]


@pytest.mark.parametrize("text, state", [
    ("SELECT 1 + 1.5 + '2'::text", "42804"), ("SELECT 1::int + 1.5::double precision", "42804"), ("SELECT coalesce('a'::text, 1::int)", "42804"), ("SELECT nothing", "42703"), ("SELECT * FROM nothing", "42P01"),
    ("SELECT sum(x) OVER () FROM (VALUES (1)) v(x)", "0A000"), ("WITH RECURSIVE a AS (SELECT 1) SELECT 1", "0A000"), ("SELECT FROM", "42601"), ("SELECT 1 / 0", "22012"), ("SELECT 9223372036854775807 + 1", "22003"),
    ("SELECT nosuch(1)", "42883"), ("SELECT 1 FROM (SELECT 1)", "42601"), ("SELECT 1 WHERE 1", "42804"), ("SELECT $1", "42P02"), ("SELECT 40000::smallint", None),
])
def test_errors(run, text, state):
    found = run.state(text)
    assert state is None or found == state


def test_changes(run):
    run("CREATE TABLE kv (k int PRIMARY KEY, v int CHECK (v >= 0), note varchar(5) DEFAULT 'none')")
    assert run("INSERT INTO kv (k, v) VALUES (1, 10) RETURNING *") == [(1, 10, "none")]
    up = "INSERT INTO kv VALUES ({}) ON CONFLICT (k) DO UPDATE SET v = kv.v + excluded.v, note = excluded.note {} RETURNING k, v"
    assert run(up.format("1, 5, 'new'", "")) == [(1, 15)] and run(up.format("2, 20, 'two'", "")) == [(2, 20)] and run(up.format("2, 1, 'no'", "WHERE false")) == []
    assert run("INSERT INTO kv VALUES (2, 0, 'x'), (3, 0, 'y') ON CONFLICT DO NOTHING RETURNING k") == [(3,)]
    assert run("UPDATE kv SET v = v * 2 WHERE k < 3 RETURNING k, v AS twice") in ([(1, 30), (2, 40)], [(2, 40), (1, 30)])
    run("CREATE TABLE w (id int, by int)")
    run("INSERT INTO w VALUES (1, 7), (3, 9)")
    run("UPDATE kv AS t SET v = w.by, note = DEFAULT FROM w WHERE w.id = t.k")
    assert run("SELECT k, v, note FROM kv ORDER BY k") == [(1, 7, "none"), (2, 40, "two"), (3, 9, "none")]
    assert run("DELETE FROM kv USING w WHERE w.id = kv.k AND w.by > 8 RETURNING k") == [(3,)]
    assert [run.state(t) for t in ("INSERT INTO kv VALUES (1, 1, 'x')", "INSERT INTO kv VALUES (9, -1, 'x')", "INSERT INTO kv VALUES (9, 1, 'toolong')", "INSERT INTO kv VALUES (NULL, 1, 'x')", "INSERT INTO kv VALUES ('a', 1, 'x')")] == ["23505", "23514", "22001", "23502", "42804"]
    run("TRUNCATE kv")
    assert run("SELECT count(*) FROM kv") == [(0,)]


def test_definitions(run):
    run("CREATE SEQUENCE s START WITH 5 INCREMENT BY 2")
    assert run("SELECT nextval('s'), nextval('s')") == [(5, 7)]
    run("CREATE TABLE p (id serial PRIMARY KEY, name text NOT NULL UNIQUE)")
    run("INSERT INTO p (name) VALUES ('a'), ('b')")
    assert run("SELECT id, name FROM p ORDER BY id") in ([(1, "a"), (2, "b")], [(1, "b"), (2, "a")])
    run("CREATE VIEW v (n) AS SELECT name FROM p")
    assert run("SELECT n FROM v ORDER BY n") == [("a",), ("b",)]
    run("CREATE TABLE c (id int PRIMARY KEY, parent int REFERENCES p (id))")
    assert run.state("INSERT INTO c VALUES (1, 99)") == "23503" and run.state("DROP TABLE p") == "2BP01"
    run("DROP TABLE c")
    run("SET work_mem = '8MB'")
    assert run("SHOW work_mem") == [("8MB",)]
    run("RESET ALL")
    run("ANALYZE p")
    assert any("Scan" in line or "LocalTable" in line or "Project" in line for (line,) in run("EXPLAIN SELECT * FROM p"))
    assert run("SELECT current_schema(), current_database(), has_table_privilege('p', 'select')") == [("public", "corvane", True)]
    run("DROP VIEW v")
    run("DROP SEQUENCE IF EXISTS nothing")


def test_aggregates(run):
    run("CREATE TABLE a (id int, label text, flag boolean, d double precision)")
    run("INSERT INTO a VALUES (1, 'a', true, 1.0), (5, NULL, false, 5.0), (NULL, 'b', NULL, NULL)")
    got = run("SELECT array_agg(id), string_agg(label, ','), var_pop(d), stddev_pop(d), bool_and(flag), bool_or(flag), min(label), count(id), variance(d) FROM a")[0]
    assert sorted(got[0], key=lambda x: (x is None, x)) == [1, 5, None] and got[1] in ("a,b", "b,a") and got[2:] == (4.0, 2.0, False, True, "a", 2, 8.0)
    assert run("SELECT array_agg(id), string_agg(label, ','), avg(id), sum(id) FROM a WHERE false") == [(None, None, None, None)]
    assert run("SELECT v FROM unnest(ARRAY[1, NULL, 3]) AS v") == [(1,), (None,), (3,)] and run("SELECT g FROM generate_series(3, 1, -1) AS g") == [(3,), (2,), (1,)] and run("SELECT g FROM generate_series(1, 0) AS g") == []


def test_alter_table(run):
    run("CREATE TABLE t (id int, a text)")
    run("INSERT INTO t VALUES (1, '5'), (2, '6')")
    run("ALTER TABLE t ADD COLUMN b double precision DEFAULT 2.5")
    run("ALTER TABLE t ALTER COLUMN b TYPE int")
    run("ALTER TABLE t RENAME COLUMN a TO c")
    run("ALTER TABLE t ADD PRIMARY KEY (id)")
    assert run.state("INSERT INTO t VALUES (1, 'x', 1)") == "23505"
    run("ALTER TABLE t DROP CONSTRAINT t_pkey")
    run("INSERT INTO t VALUES (1, 'x', 1)")
    assert run.state("ALTER TABLE t ADD PRIMARY KEY (id)") == "23505" and run.state("ALTER TABLE t DROP CONSTRAINT nope") == "42704"
    run("ALTER TABLE t DROP COLUMN b")
    run("ALTER TABLE t RENAME TO u")
    assert run("SELECT * FROM u ORDER BY id, c") == [(1, "5"), (1, "x"), (2, "6")] and run.state("SELECT * FROM t") == "42P01"


def test_cursors_in_sql(run):
    run("DECLARE c CURSOR FOR SELECT g FROM generate_series(1, 5) AS g ORDER BY 1")
    assert run("FETCH 2 FROM c") == [(1,), (2,)] and run("FETCH NEXT FROM c") == [(3,)] and run("FETCH ALL FROM c") == [(4,), (5,)] and run("FETCH c") == []
    run("CLOSE c")
    assert run.state("FETCH c") == "34000"


def test_time_of_day(run):
    assert str(run("SELECT TIME '23:00:00' + INTERVAL '02:30:00', TIME '01:00:00' - INTERVAL '1 day 02:00:00'")[0]) == "(datetime.time(1, 30), datetime.time(23, 0))"
