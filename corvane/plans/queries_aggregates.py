"""Grouping and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import aggregates as A
from corvane.functions import scalar as S
from corvane.sources.tables import table

from .registry import query

col, lit = F.col, F.lit


@query("""
SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC NULLS FIRST, l_orderkey LIMIT 100""")
def flagship_revenue(spark, folder):
    customer = table(spark, folder, "customer").filter(col("c_mktsegment") == "BUILDING").select("c_custkey")
    orders = table(spark, folder, "orders").filter(col("o_orderdate") < F.expr("timestamp_ntz'1998-03-15'")).select("o_orderkey", "o_custkey", "o_orderdate")
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", (col("l_extendedprice") * (lit(1) - col("l_discount"))).alias("amount"))
    return (
        orders.join(customer, col("c_custkey") == col("o_custkey"), "left_semi")
        .join(lineitem, col("l_orderkey") == col("o_orderkey"))
        .groupBy("l_orderkey", "o_orderdate")
        .agg(F.round(F.sum("amount"), 2).alias("revenue"))
        .orderBy(col("revenue").desc_nulls_first(), col("l_orderkey").asc_nulls_last())
        .limit(100)
    )


@query("SELECT count(*) AS n, count(quality) AS rated, count(DISTINCT lang) AS langs FROM documents LEFT JOIN labels USING (doc_id)")
def agg_count_star_col(spark, folder):
    both = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    return both.agg(F.count(lit(1)).alias("n"), F.count("quality").alias("rated"), F.count_distinct("lang").alias("langs"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS numbers, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_sum_int_double(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(A.sum_int(col("l_linenumber")).alias("numbers"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS mean, CAST(sum(DISTINCT l_linenumber) // count(DISTINCT l_linenumber) AS BIGINT) AS mean_distinct FROM lineitem GROUP BY l_returnflag")
def agg_avg_int_trunc(spark, folder):
    line = col("l_linenumber")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(A.avg_int(line).alias("mean"), A.avg_int(line, distinct=True).alias("mean_distinct"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment")
def agg_avg_double(spark, folder):
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("SELECT sum(CAST(x AS DOUBLE)) AS total FROM (SELECT CAST(p_size AS FLOAT) AS x FROM part)")
def agg_sum_real(spark, folder):
    return table(spark, folder, "part").select(col("p_size").cast("float").alias("x")).agg(A.sum_real(col("x")).cast("double").alias("total"))


@query("SELECT CAST(sum(n) AS DECIMAL(24, 2)) AS total, min(n) AS least, max(n) AS most FROM (SELECT CAST(p_retailprice AS DECIMAL(12, 2)) AS n FROM part)")
def agg_numeric(spark, folder):
    n = table(spark, folder, "part").select(col("p_retailprice").cast("decimal(12,2)").alias("n"))
    return n.agg(F.sum("n").cast("decimal(24,2)").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("SELECT o_orderstatus, min(o_orderdate) AS first, max(o_orderdate) AS last, min(o_orderpriority) AS least, max(o_totalprice) AS dearest FROM orders GROUP BY o_orderstatus")
def agg_min_max(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.min("o_orderpriority").alias("least"), F.max("o_totalprice").alias("dearest"))


@query("""SELECT l_linenumber, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp
FROM lineitem GROUP BY l_linenumber""")
def agg_stddev_var(spark, folder):
    q = col("l_quantity")
    rounded = {"sd": A.stddev(q), "sdp": F.stddev_pop(q), "v": A.variance(q), "vp": F.var_pop(q)}
    return table(spark, folder, "lineitem").groupBy("l_linenumber").agg(*(F.round(c, 6).alias(n) for n, c in rounded.items()))


@query("SELECT lang, bool_and(toxic = 1) AS every, bool_or(toxic = 1) AS some FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def agg_bool(spark, folder):
    both = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    return both.groupBy("lang").agg(F.bool_and(col("toxic") == 1).alias("every"), F.bool_or(col("toxic") == 1).alias("some"))


@query("SELECT o_custkey, array_agg(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderkey END ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def agg_array_agg_ordered(spark, folder):
    key = F.when(col("o_orderstatus") == "O", lit(None)).otherwise(col("o_orderkey"))
    return table(spark, folder, "orders").groupBy("o_custkey").agg(A.array_agg(key, col("o_orderkey")).alias("keys"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def agg_string_agg(spark, folder):
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(A.string_agg(col("n_name"), lit(", "), col("n_nationkey")).alias("names"))


@query("SELECT [1, NULL, 2, 3] AS ids, 'a;b' AS labels, 'a,a;ab' AS every")
def agg_distinct_ordered(spark, folder):
    """array_agg(DISTINCT), string_agg(DISTINCT) by first place, and delimiters by row."""
    rows = spark.createDataFrame([(1, 1, "a", ","), (2, 1, "a", ","), (3, None, None, ","), (4, None, None, ","), (5, 2, "a", ";"), (6, 3, "b", None)], "o int, id int, label string, d string")
    return rows.agg(
        A.array_agg_distinct(col("id"), col("o")).alias("ids"), A.string_agg_distinct(col("label"), F.when(col("label") == "b", lit(";")).otherwise(lit(";")), F.col("o")).alias("labels"), A.string_agg(col("label"), col("d"), col("o")).alias("every")
    )


@query("""SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers, min(DISTINCT l_quantity) AS least, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def agg_distinct_multi(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.sum_distinct(col("l_linenumber").cast("bigint")).alias("numbers"), F.min("l_quantity").alias("least"), F.count(lit(1)).alias("n"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, array_agg(o_orderkey) AS keys, string_agg(o_orderstatus, ',') AS states, CAST(NULL AS BIGINT) AS mean FROM orders WHERE o_orderkey < 0")
def agg_global_empty(spark, folder):
    none = table(spark, folder, "orders").filter(col("o_orderkey") < 0)
    key = col("o_orderkey")
    return none.agg(F.count(lit(1)).alias("n"), A.sum_int(key).alias("total"), A.array_agg(key, key).alias("keys"), A.string_agg(col("o_orderstatus"), lit(","), key).alias("states"), A.avg_int(key).alias("mean"))


@query("SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS year, o_custkey % 3 AS part, count(*) AS n FROM orders GROUP BY extract(year FROM o_orderdate), o_custkey % 3")
def group_by_expr(spark, folder):
    return table(spark, folder, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year"), S.modulo(col("o_custkey"), 3).alias("part")).agg(F.count(lit(1)).alias("n"))


@query("SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def group_null_key(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return both.groupBy("quality").agg(F.count(lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
def having_agg(spark, folder):
    grouped = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    return grouped.filter((col("n") > 12) & (col("most") > 100000)).drop("most")


@query("SELECT count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY 'constant'")
def group_by_constant(spark, folder):
    """GROUP BY 1 groups by a constant: a number is no place there."""
    return table(spark, folder, "lineitem").groupBy(lit(1).alias("k")).agg(F.count(lit(1)).alias("n"), F.max("l_quantity").alias("most")).drop("k")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, folder):
    lines = table(spark, folder, "lineitem").filter(col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'"))
    net = col("l_extendedprice") * (lit(1) - col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(lit(1)).alias("n")
    )
