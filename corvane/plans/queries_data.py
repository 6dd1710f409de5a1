"""Statements that change tables, COPY, and the catalog; each query gives the table after, or what RETURNING gave."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.operators import relational as R
from corvane.operators.dml import Table
from corvane.plans.database import Database
from corvane.session import shared_folder
from corvane.sources.copyio import CopyOptions, copy_from, copy_to
from corvane.sources.tables import table

from .registry import query

col, lit = F.col, F.lit
_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "text", "o_totalprice": "double"}


def _orders(spark, folder, keep: str = "true", **options) -> Table:
    rows = table(spark, folder, "orders").select(*_ORDERS).filter(keep)
    return Table.create(spark, "orders", _ORDERS, rows, primary_key=("o_orderkey",), **options)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_totalprice > 200000")
def insert_select(spark, folder):
    even = _orders(spark, folder, "o_orderkey % 2 = 0")
    even.insert(table(spark, folder, "orders").select(*_ORDERS).filter("o_orderkey % 2 <> 0 AND o_totalprice > 200000"))
    return even.rows


@query("SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderkey % 2 <> 0 AND o_totalprice > 200000")
def insert_returning(spark, folder):
    even = _orders(spark, folder, "o_orderkey % 2 = 0")
    return even.insert(table(spark, folder, "orders").select(*_ORDERS).filter("o_orderkey % 2 <> 0 AND o_totalprice > 200000"), returning=["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'new' END AS o_orderstatus, o_totalprice FROM orders")
def upsert_do_nothing(spark, folder):
    even = _orders(spark, folder, "o_orderkey % 2 = 0")
    everything = table(spark, folder, "orders").select("o_orderkey", "o_custkey", lit("new").alias("o_orderstatus"), "o_totalprice")
    even.insert(everything, conflict="nothing")
    return even.rows


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 <> 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'O' THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0""")
def upsert_do_update_where(spark, folder):
    even = _orders(spark, folder, "o_orderkey % 2 = 0")
    source = table(spark, folder, "orders").filter("o_orderkey % 2 = 0 OR o_orderkey % 5 = 0")
    proposed = source.select("o_orderkey", "o_custkey", lit("new").alias("o_orderstatus"), F.when(col("o_orderkey") % 2 == 0, lit(10.0)).otherwise(col("o_totalprice")).alias("o_totalprice"))
    even.insert(proposed, conflict="update", update={"o_totalprice": col("o_totalprice") + col("excluded_o_totalprice")}, where=col("o_orderstatus") == "O")
    return even.rows


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(q, o_totalprice) AS o_totalprice FROM orders
LEFT JOIN (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_quantity AS q FROM lineitem WHERE l_quantity > 45 ORDER BY l_orderkey, l_linenumber, l_quantity) ON l_orderkey = o_orderkey""")
def update_from_first_match(spark, folder):
    orders = _orders(spark, folder)
    lines = table(spark, folder, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")
    orders.update({"o_totalprice": col("l_quantity")}, col("o_orderkey") == col("l_orderkey"), lines, [R.ordered("l_linenumber"), R.ordered("l_quantity")])
    return orders.rows


@query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def update_returning(spark, folder):
    return _orders(spark, folder).update({"o_totalprice": col("o_totalprice") * 2}, col("o_orderstatus") == "P", returning=["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_orderstatus, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def delete_using_returning(spark, folder):
    owing = table(spark, folder, "customer").filter("c_acctbal < 0").select("c_custkey", "c_acctbal")
    return _orders(spark, folder).delete(col("o_custkey") == col("c_custkey"), owing, [R.ordered("c_custkey")], returning=["o_orderkey", "o_orderstatus", "c_acctbal"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def delete_where(spark, folder):
    orders = _orders(spark, folder)
    orders.delete(col("o_orderstatus") == "F")
    return orders.rows


@query("SELECT CAST(0 AS BIGINT) AS n")
def truncate_table(spark, folder):
    orders = _orders(spark, folder)
    orders.truncate()
    return orders.rows.agg(F.count(lit(1)).alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def foreign_key_violations(spark, folder):
    """What an added foreign key would reject."""
    nations = table(spark, folder, "nation").select("n_nationkey")
    return table(spark, folder, "supplier").join(nations, col("s_nationkey") == col("n_nationkey"), "left_anti").select("s_suppkey", "s_name")


@query("SELECT CAST(r_regionkey AS BIGINT) + 1 AS id, r_name FROM region")
def insert_serial(spark, folder):
    """A SERIAL column takes its values from a sequence, in blocks."""
    database = Database(spark)
    regions = database.create_table("region_copy", {"id": "serial", "r_name": "text"})
    regions.insert(table(spark, folder, "region").orderBy("r_regionkey").select("r_name"), ["r_name"])
    return regions.rows


def _scratch(spark) -> str:
    """A folder for files that a query writes and reads again."""
    return f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment || ',\"' || chr(10) END AS note FROM customer")
def copy_csv_roundtrip(spark, folder):
    key = col("c_custkey")
    note = F.when(key % 3 == 0, lit(None)).when(key % 3 == 1, lit("")).otherwise(F.concat(col("c_mktsegment"), lit(',"\n')))
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", note.alias("note"))
    options = CopyOptions("csv", header=True)
    copy_to(rows, path := _scratch(spark), options)
    return copy_from(spark, path, {"c_custkey": "bigint", "c_name": "text", "c_acctbal": "double", "note": "text"}, options)


@query("SELECT doc_id, text, quality = 1 AS good FROM documents LEFT JOIN labels USING (doc_id)")
def copy_text_roundtrip(spark, folder):
    both = table(spark, folder, "documents").select("doc_id", "text").join(table(spark, folder, "labels"), "doc_id", "left")
    copy_to(both.select("doc_id", "text", (col("quality") == 1).alias("good")), path := _scratch(spark))
    return copy_from(spark, path, {"doc_id": "bigint", "text": "text", "good": "boolean"})


@query("SELECT p_partkey, p_name || '|' || p_brand || chr(92) || '|' || chr(10) || chr(1) || '2' AS odd, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'N' || chr(92) ELSE chr(92) || 'N|' END AS mark FROM part")
def copy_custom_delimiter(spark, folder):
    key = col("p_partkey")
    odd = F.concat("p_name", lit("|"), "p_brand", lit("\\|\n\x012"))
    mark = F.when(key % 4 == 0, lit(None)).when(key % 4 == 1, lit("N\\")).otherwise(lit("\\N|"))
    options = CopyOptions(delimiter="|")
    copy_to(table(spark, folder, "part").select("p_partkey", odd.alias("odd"), mark.alias("mark")), path := _scratch(spark), options)
    return copy_from(spark, path, {"p_partkey": "bigint", "odd": "text", "mark": "text"}, options)


@query("""SELECT p_partkey, [p_name, p_brand || ',"' || chr(92), NULL, 'NULL', '', '{' || p_type || '}'] AS words, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN [] ELSE [p_partkey, NULL, -1] END AS numbers,
[[p_name, ' a'], [NULL, '}']] AS nested FROM part""")
def copy_array_roundtrip(spark, folder):
    key, text = col("p_partkey"), lambda x: lit(x).cast("string")
    words = F.array("p_name", F.concat("p_brand", lit(',"\\')), text(None), text("NULL"), text(""), F.concat(lit("{"), "p_type", lit("}")))
    numbers = F.when(key % 3 == 0, lit(None)).when(key % 3 == 1, F.array().cast("array<bigint>")).otherwise(F.array(key, lit(None).cast("bigint"), lit(-1).cast("bigint")))
    nested = F.array(F.array("p_name", text(" a")), F.array(text(None), text("}")))
    copy_to(table(spark, folder, "part").select("p_partkey", words.alias("words"), numbers.alias("numbers"), nested.alias("nested")), path := _scratch(spark))
    return copy_from(spark, path, {"p_partkey": "bigint", "words": "text[]", "numbers": "bigint[]", "nested": "text[][]"})


@query("""SELECT * FROM (VALUES ('orders', 'o_orderkey', 1, 'NO', 'bigint'), ('orders', 'o_custkey', 2, 'YES', 'bigint'), ('orders', 'o_orderstatus', 3, 'YES', 'text'), ('orders', 'o_totalprice', 4, 'YES', 'double'))
AS v(table_name, column_name, ordinal_position, is_nullable, data_type)""")
def information_schema_columns(spark, folder):
    database = Database(spark)
    database.tables["public", "orders"] = _orders(spark, folder)
    return database.system("information_schema.columns").select("table_name", "column_name", "ordinal_position", "is_nullable", "data_type")


@query()
def pg_stats_like(spark, folder):
    database = Database(spark)
    database.tables["public", "orders"] = _orders(spark, folder)
    return database.analyze("orders")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37 AND o_totalprice > 1000.0")
def prepared_parameters(spark, folder):
    database = Database(spark)
    table(spark, folder, "orders").createOrReplaceTempView("corvane_prepared_orders")
    database.prepare("by_customer", "SELECT o_orderkey, o_totalprice FROM corvane_prepared_orders WHERE o_custkey = $1 AND o_totalprice > $2")
    return database.execute("by_customer", 37, 1000.0)
