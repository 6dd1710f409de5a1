"""Joins: inner, outer, cross, on any condition, semi and anti."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import relational as R
from corvane.sources.tables import table

from .registry import query, sql

col, lit = F.col, F.lit


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_equi(spark, folder):
    return table(spark, folder, "orders").join(table(spark, folder, "customer"), col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1")
def join_multi_key(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a, b = lines.alias("a"), lines.alias("b")
    on = (col("a.l_orderkey") == col("b.l_orderkey")) & (col("a.l_linenumber") == col("b.l_linenumber") + 1)
    return a.join(b, on).select("a.l_orderkey", "a.l_linenumber", "b.l_quantity")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark, folder):
    return table(spark, folder, "customer").join(table(spark, folder, "orders"), col("c_custkey") == col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT d.doc_id, l.doc_id AS labelled FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
def join_right(spark, folder):
    d, l = table(spark, folder, "documents").alias("d"), table(spark, folder, "labels").alias("l")  # noqa: E741
    return l.join(d, col("l.doc_id") == col("d.doc_id"), "right").select("d.doc_id", col("l.doc_id").alias("labelled"))


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3")
def join_full(spark, folder):
    return table(spark, folder, "customer").join(table(spark, folder, "supplier"), col("c_custkey") == col("s_suppkey") * 3, "full").select("c_custkey", "s_suppkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, folder):
    return table(spark, folder, "nation").crossJoin(table(spark, folder, "region")).select("r_name", "n_name")


@query("SELECT n_name, r_name, s_name FROM nation, region, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey AND s_acctbal > 0")
def join_comma_where(spark, folder):
    return sql(spark, folder, "SELECT n_name, r_name, s_name FROM {nation}, {region}, {supplier} WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey AND s_acctbal > 0")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > n_regionkey * 2000")
def join_theta(spark, folder):
    on = (col("s_nationkey") < col("n_nationkey")) & (col("s_acctbal") > col("n_regionkey") * 2000)
    return R.theta_join(table(spark, folder, "supplier"), table(spark, folder, "nation"), on).select("s_suppkey", "n_nationkey")


@query("SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON r_regionkey < n_regionkey")
def join_left_theta(spark, folder):
    return R.theta_join(table(spark, folder, "nation"), table(spark, folder, "region"), col("r_regionkey") < col("n_regionkey"), "left").select("n_nationkey", "r_regionkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def join_left_residual(spark, folder):
    on = (col("c_custkey") == col("o_custkey")) & (col("o_totalprice") > 200000)
    return table(spark, folder, "customer").join(table(spark, folder, "orders"), on, "left").select("c_custkey", "o_orderkey")


@query("SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON s_nationkey > n_nationkey + 5 AND s_suppkey < 9")
def join_full_theta(spark, folder):
    on = (col("s_nationkey") > col("n_nationkey") + 5) & (col("s_suppkey") < 9)
    return R.theta_join(table(spark, folder, "nation"), table(spark, folder, "supplier"), on, "full").select("n_nationkey", "s_suppkey")


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 AND c_acctbal < 0")
def join_full_residual(spark, folder):
    on = (col("c_custkey") == col("o_custkey")) & (col("o_totalprice") > 300000) & (col("c_acctbal") < 0)
    return table(spark, folder, "customer").join(table(spark, folder, "orders"), on, "full").select("c_custkey", "o_orderkey")


@query("SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, folder):
    a, b = table(spark, folder, "nation").alias("a"), table(spark, folder, "nation").alias("b")
    on = (col("a.n_regionkey") == col("b.n_regionkey")) & (col("a.n_nationkey") < col("b.n_nationkey"))
    return a.join(b, on).select(col("a.n_name").alias("one"), col("b.n_name").alias("two"))


@query("SELECT a.doc_id AS doc_id FROM labels a JOIN labels b ON nullif(a.toxic, 0) = nullif(b.toxic, 0) AND a.doc_id = b.doc_id")
def join_null_keys(spark, folder):
    """NULL keys match nothing."""
    a = table(spark, folder, "labels").select("doc_id", F.nullif("toxic", lit(0)).alias("k"))
    b = a.select(col("doc_id").alias("d"), col("k").alias("j"))
    return a.join(b, (col("k") == col("j")) & (col("doc_id") == col("d"))).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def semi_exists(spark, folder):
    return sql(spark, folder, "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(spark, folder):
    return sql(spark, folder, "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def semi_in(spark, folder):
    return sql(spark, folder, "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey END FROM nation)")
def anti_not_in_null(spark, folder):
    """One NULL among the values, and NOT IN keeps nothing."""
    return sql(spark, folder, "SELECT p_partkey FROM {part} WHERE p_size NOT IN (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey END FROM {nation})")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)")
def anti_not_in(spark, folder):
    return sql(spark, folder, "SELECT p_partkey FROM {part} WHERE p_size NOT IN (SELECT n_nationkey FROM {nation})")
