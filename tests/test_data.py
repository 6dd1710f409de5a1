"""Statements that change tables, COPY, catalog and cursors."""

import pytest
from pyspark.sql import functions as F

from corvane.functions.types import DialectError
from corvane.operators import relational as R
from corvane.operators.dml import ForeignKey, Table
from corvane.plans.database import Database, Sequence64
from corvane.sources.copyio import CopyOptions, copy_from, copy_to
from corvane.streaming.results import Cursor, batches

KV = {"k": "int", "v": "int", "note": "text"}


def kv(spark, *rows, **options):
    return Table.create(spark, "kv", KV, spark.createDataFrame(list(rows), "k bigint, v bigint, note string"), primary_key=("k",), **options)


def rows_of(table):
    return sorted(map(tuple, table.rows.collect()))


def new(spark, *rows):
    return spark.createDataFrame(list(rows), "k bigint, v bigint, note string")


def test_upsert(spark):
    t = kv(spark, (1, 10, "old"))
    change = {"v": F.col("v") + F.col("excluded_v"), "note": F.col("excluded_note")}
    t.insert(new(spark, (1, 5, "new")), conflict="update", update=change)
    t.insert(new(spark, (2, 20, "two")), conflict="update", update=change)
    t.insert(new(spark, (2, 1, "no")), conflict="update", update=change, where=F.lit(False))
    assert rows_of(t) == [(1, 15, "new"), (2, 20, "two")]
    got = t.insert(new(spark, (2, 0, "x"), (3, 0, "y"), (3, 1, "z")), conflict="nothing", order=F.col("v"), returning=["k", "note"])
    assert [tuple(r) for r in got.collect()] == [(3, "y")]
    with pytest.raises(DialectError, match="21000"):
        t.insert(new(spark, (9, 0, "x"), (9, 1, "y")), conflict="update", update=change)


@pytest.mark.parametrize("row, state", [((1, 1, "dup"), "23505"), ((None, 1, "x"), "23502"), ((5, -1, "x"), "23514"), ((5, 2**40, "x"), "22003")])
def test_constraints(spark, row, state):
    t = kv(spark, (1, 10, "old"), checks={"positive": F.col("v") > 0})
    with pytest.raises(DialectError) as raised:
        t.insert(new(spark, row))
    assert raised.value.state == state and rows_of(t) == [(1, 10, "old")]


def test_check_passes_null_and_lengths_are_kept(spark):
    t = Table.create(spark, "t", {"id": "int", "name": "varchar(5)"}, primary_key=("id",), checks={"c": F.col("name") != "bad"})
    t.insert(spark.createDataFrame([(1, None), (2, "ok")], "id bigint, name string"))
    with pytest.raises(DialectError, match="22001"):
        t.insert(spark.createDataFrame([(3, "toolong")], "id bigint, name string"))
    assert t.rows.count() == 2


def test_foreign_keys(spark):
    users = Table.create(spark, "users", {"id": "int"}, spark.createDataFrame([(1,), (2,)], "id bigint"), primary_key=("id",))
    posts = Table.create(spark, "posts", {"id": "int", "owner": "int"}, spark.createDataFrame([(1, 1)], "id bigint, owner bigint"), primary_key=("id",), foreign_keys=[ForeignKey(("owner",), users, ("id",))])
    posts.insert(spark.createDataFrame([(2, None)], "id bigint, owner bigint"))
    with pytest.raises(DialectError, match="23503"):
        posts.insert(spark.createDataFrame([(3, 7)], "id bigint, owner bigint"))
    with pytest.raises(DialectError, match="23503"):
        users.delete(F.col("id") == 1)
    users.delete(F.col("id") == 2)
    assert users.rows.count() == 1


def test_update_and_delete_take_the_first_match(spark):
    t = kv(spark, (1, 10, "a"), (2, 20, "b"))
    other = spark.createDataFrame([(1, 7), (1, 3)], "id bigint, w bigint")
    got = t.update({"v": F.col("w")}, F.col("k") == F.col("id"), other, [R.ordered("w")], returning=["k", "v"])
    assert [tuple(r) for r in got.collect()] == [(1, 3)] and rows_of(t) == [(1, 3, "a"), (2, 20, "b")]
    gone = t.delete(F.col("k") == F.col("id"), other, [R.ordered("w")], returning=["k", "note"])
    assert [tuple(r) for r in gone.collect()] == [(1, "a")] and rows_of(t) == [(2, 20, "b")]


def test_alter(spark):
    t = kv(spark, (1, 10, "a"))
    t.add_column("w", "double", F.lit(2.5))
    t.rename_column("note", "text")
    t.alter_type("w", "int")
    t.drop_column("v")
    assert t.rows.columns == ["k", "text", "w"] and rows_of(t) == [(1, "a", 2)]
    with pytest.raises(DialectError):
        t.drop_column("k")
    t.truncate()
    assert t.rows.count() == 0


def test_sequences(spark):
    s = Sequence64("s", maximum=3, cycle=True)
    assert [s.nextval() for _ in range(4)] == [1, 2, 3, 1] and s.currval() == 1
    assert s.setval(2, False) == 2 and s.nextval() == 2
    with pytest.raises(DialectError):
        Sequence64("t").currval()
    big = Sequence64("u", increment=10)
    got = sorted(r.n for r in big.fill(spark.range(0, 100, 1, 7), "n").collect())
    assert got == list(range(1, 1001, 10)) and big.nextval() == 1001


def test_catalog(spark):
    db = Database(spark)
    t = db.create_table("people", {"id": "serial", "name": "text"}, primary_key=("id",))
    t.insert(spark.createDataFrame([("fern",), ("moss",)], "name string"), ["name"])
    assert sorted(r.id for r in t.rows.collect()) == [1, 2]
    db.create_view("names", t.rows.select("name"))
    t.rename_column("name", "label")
    assert sorted(r.name for r in db.read("names").collect()) == ["fern", "moss"]
    assert [r.column_name for r in db.system("information_schema.columns").filter("table_name = 'people'").orderBy("ordinal_position").collect()] == ["id", "label"]
    db.create_index("people_label", "people", ["label"], unique=True)
    with pytest.raises(DialectError, match="23505"):
        t.insert(spark.createDataFrame([("fern",)], "label string"), ["label"])
    assert db.call("current_schema") == "public" and db.call("has_table_privilege", "people", "select") is True and db.call("pg_table_size", "people") == 0
    assert db.call("pg_get_serial_sequence", "people", "id") == "public.people_id_seq"
    for view in ("pg_namespace", "pg_class", "pg_attribute", "pg_type", "pg_index", "pg_constraint", "pg_attrdef", "pg_settings", "pg_database", "pg_roles", "pg_stat_activity", "pg_proc", "information_schema.tables", "information_schema.schemata"):
        assert db.system(view).count() > 0
    assert db.system("pg_depend").count() == 2  # a primary key and an index
    assert db.analyze("people").count() == 2
    db.set("work_mem", "8MB")
    assert db.show("work_mem") == "8MB"
    db.reset("work_mem")
    assert db.show("work_mem") == "4MB"
    with pytest.raises(DialectError, match="42P01"):
        db.table("nobody")
    assert "Physical Plan" in db.explain(t.rows)


def test_copy_text_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\tb\\n\n", True, [1, None]), (2, None, None, None), (3, "", False, [])], "id bigint, t string, f boolean, v array<bigint>")
    kinds = {"id": "bigint", "t": "text", "f": "boolean", "v": "bigint[]"}
    for i, options in enumerate((CopyOptions(), CopyOptions("text", "|", "NULL"), CopyOptions("csv"), CopyOptions("csv", ";", header=True))):
        copy_to(rows, path := str(tmp_path / f"c{i}"), options)
        assert sorted(map(tuple, copy_from(spark, path, kinds, options).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "bad.txt").write_text("1\t2\n3\n")
    with pytest.raises(Exception, match="malformed COPY row"):
        copy_from(spark, str(tmp_path / "bad.txt"), {"a": "int", "b": "int"}).collect()


def test_cursors_and_batches(spark):
    cursor = Cursor(spark.range(10).orderBy("id"))
    assert [r.id for r in cursor.fetch(3)] == [0, 1, 2] and len(cursor.fetch(None)) == 7
    cursor.close()
    with pytest.raises(DialectError):
        cursor.fetch()
    assert [len(b) for b in batches(spark.range(150))] == [64, 64, 22]
