"""Subqueries, common table expressions, views, LATERAL, arrays and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import scalar as S
from corvane.operators import relational as R
from corvane.sources.tables import table

from .registry import query, sql

col, lit = F.col, F.lit


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders) AS dearest FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_sub(spark, folder):
    return sql(spark, folder, "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders}) AS dearest FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})")


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS dearest FROM customer")
def scalar_sub_corr(spark, folder):
    return sql(spark, folder, "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS dearest FROM {customer}")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def exists_select_list(spark, folder):
    return sql(spark, folder, "SELECT c_custkey, EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM {customer}")


@query("SELECT r_regionkey FROM region WHERE EXISTS (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey + 100)")
def exists_aggregate(spark, folder):
    """An aggregate without groups always has a row."""
    return sql(spark, folder, "SELECT r_regionkey FROM {region} WHERE EXISTS (SELECT count(*) FROM {nation} WHERE n_regionkey = r_regionkey + 100)")


@query("""SELECT doc_id, toxic IN (SELECT nullif(toxic, 0) FROM labels) AS among, toxic NOT IN (SELECT nullif(toxic, 0) FROM labels) AS not_among FROM documents LEFT JOIN labels USING (doc_id)""")
def in_select_list_3vl(spark, folder):
    labels = table(spark, folder, "labels")
    both = table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", "toxic")
    among = labels.select(F.nullif("toxic", lit(0)).alias("v"))
    return R.in_subquery(R.in_subquery(both, "toxic", among, "among"), "toxic", among, "not_among", negated=True).select("doc_id", "among", "not_among")


@query("""SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > (SELECT min(r_regionkey) + 3 FROM region WHERE r_regionkey = n_regionkey)""")
def corr_having(spark, folder):
    return sql(spark, folder, "SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey HAVING count(*) > (SELECT min(r_regionkey) + 3 FROM {region} WHERE r_regionkey = n_regionkey)")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND EXISTS
  (SELECT 1 FROM orders p WHERE p.o_custkey = c_custkey AND p.o_orderkey <> o.o_orderkey AND p.o_orderstatus = 'P'))""")
def corr_depth2(spark, folder):
    """The inner reference to the outermost scope goes through the middle one, where an equality makes it available."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    o, p = orders.alias("o"), orders.filter("o_orderstatus = 'P'").alias("p")
    middle = o.join(p, (col("p.o_custkey") == col("o.o_custkey")) & (col("p.o_orderkey") != col("o.o_orderkey")), "left_semi")
    return table(spark, folder, "customer").join(middle, col("c_custkey") == col("o_custkey"), "left_semi").select("c_custkey")


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per(k, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT k, n FROM per WHERE n >= 2")
def cte_chain(spark, folder):
    return sql(spark, folder, "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 200000), per(k, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT k, n FROM per WHERE n >= 2")


@query("WITH per AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k AS k, b.k AS j FROM per a JOIN per b ON a.n = b.n AND a.k = b.k + 1")
def cte_reuse(spark, folder):
    return sql(spark, folder, "WITH per AS (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT a.k AS k, b.k AS j FROM per a JOIN per b ON a.n = b.n AND a.k = b.k + 1")


@query("SELECT segment, n FROM (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment) AS d WHERE n > 10")
def derived_table(spark, folder):
    return sql(spark, folder, "SELECT segment, n FROM (SELECT c_mktsegment AS segment, count(*) AS n FROM {customer} GROUP BY c_mktsegment) AS d WHERE n > 10")


@query("SELECT key, total FROM (SELECT o_orderkey AS key, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F') AS finished WHERE total < 50000")
def view_query(spark, folder):
    """A view with names of its own for its columns."""
    from corvane.plans.database import Database

    database = Database(spark)
    finished = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    database.create_view("corvane_finished", finished, ["key", "total"], replace=True)
    return database.read("corvane_finished").filter("total < 50000")


@query("SELECT c_custkey, m FROM customer, LATERAL (SELECT max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) AS x")
def lateral_agg(spark, folder):
    return sql(spark, folder, "SELECT c_custkey, m FROM {customer}, LATERAL (SELECT max(o_totalprice) AS m FROM {orders} WHERE o_custkey = c_custkey) AS x")


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 1) AS x")
def lateral_top1(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = R.lateral_top(table(spark, folder, "customer").select("c_custkey"), orders, {"c_custkey": "o_custkey"}, [R.ordered("o_totalprice", descending=True), R.ordered("o_orderkey")])
    return top.select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, n FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) AS x ON n > 5")
def left_lateral_on(spark, folder):
    return sql(spark, folder, "SELECT c_custkey, n FROM {customer} LEFT JOIN LATERAL (SELECT count(*) AS n FROM {orders} WHERE o_custkey = c_custkey) AS x ON n > 5")


# ---- arrays and table functions


@query("SELECT vec_id, embedding[1] AS first, embedding[64] AS last, CAST(NULL AS FLOAT) AS beyond, CAST([label, NULL] AS INTEGER[]) AS made FROM embeddings")
def array_ctor_subscript(spark, folder):
    e = col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", S.subscript(e, 1).alias("first"), S.subscript(e, 64).alias("last"), S.subscript(e, 1000).alias("beyond"), S.array(col("label"), lit(None).cast("int")).alias("made"))


@query("SELECT p_partkey, p_size + 1 AS inner_value, CAST(NULL AS INTEGER) AS outside FROM part")
def array_2d_subscript(spark, folder):
    grid = F.array(F.array(col("p_size"), lit(1)), F.array(col("p_size") + 1, lit(2)))
    return table(spark, folder, "part").select("p_partkey", S.subscript(grid, 2, 1).alias("inner_value"), S.subscript(grid, 3, 1).alias("outside"))


@query("SELECT vec_id, embedding[1:2] < embedding[3:4] AS less, embedding[1:2] = embedding[1:2] AS same FROM embeddings")
def array_compare(spark, folder):
    part = lambda i: F.slice("embedding", i, 2)
    return table(spark, folder, "embeddings").select("vec_id", (part(1) < part(3)).alias("less"), (part(1) == part(1)).alias("same"))


@query("SELECT vec_id, unnest(embedding[1:3]) AS x FROM embeddings")
def unnest_lateral(spark, folder):
    return R.unnest(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.slice("embedding", 1, 3), "x").select("vec_id", "x")


@query("SELECT p_partkey, unnest([p_size, 1, p_size + 1, 2]) AS x FROM part")
def unnest_2d(spark, folder):
    grid = F.array(F.array(col("p_size"), lit(1)), F.array(col("p_size") + 1, lit(2)))
    return R.unnest(table(spark, folder, "part").select("p_partkey", "p_size"), grid, "x", dimensions=2).select("p_partkey", "x")


@query("SELECT generate_series AS g FROM generate_series(10, -5, -3) UNION ALL SELECT generate_series FROM generate_series(1, 0) UNION ALL SELECT generate_series FROM generate_series(5, 7)")
def generate_series_const(spark, folder):
    parts = [R.generate_series(spark, 10, -5, -3, "g"), R.generate_series(spark, 1, 0, 1, "g"), R.generate_series(spark, 5, 7, 1, "g")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT n_nationkey, g FROM nation, LATERAL (SELECT unnest(generate_series(n_regionkey, 3)) AS g)")
def generate_series_lateral(spark, folder):
    return R.lateral_series(table(spark, folder, "nation").select("n_nationkey", "n_regionkey"), col("n_regionkey"), lit(3), name="g").select("n_nationkey", "g")
