"""DISTINCT, ORDER BY, LIMIT and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import relational as R
from corvane.sources.tables import table

from .registry import query

col, lit = F.col, F.lit


@query("SELECT DISTINCT quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def select_distinct(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return both.select("quality", "toxic").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS FIRST, o_orderkey")
def distinct_on(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.distinct_on(orders, ["o_custkey"], R.ordered("o_totalprice", descending=True), R.ordered("o_orderkey"))


@query("SELECT DISTINCT ON (o_orderstatus) o_orderstatus, o_custkey, n FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL) ORDER BY o_orderstatus, n DESC, o_custkey")
def distinct_on_grouped(spark, folder):
    grouped = table(spark, folder, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count(lit(1)).alias("n"))
    return R.distinct_on(grouped, ["o_orderstatus"], R.ordered("n", descending=True), R.ordered("o_custkey"))


@query("SELECT doc_id, lang, toxic, row_number() OVER (PARTITION BY lang ORDER BY toxic ASC NULLS LAST, doc_id) AS rank FROM documents LEFT JOIN labels USING (doc_id)")
def sort_nulls_default(spark, folder):
    """The rank in each language shows the order: NULLs come last ascending."""
    both = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(R.ordered("toxic"), R.ordered("doc_id"))))


@query("SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) ORDER BY toxic DESC NULLS LAST, doc_id LIMIT 20")
def sort_nulls_explicit(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left").select("doc_id", "toxic")
    return R.order_by(both, ("toxic", "desc", "last"), "doc_id").limit(20)


@query("SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) ORDER BY toxic DESC NULLS FIRST, doc_id LIMIT 20")
def sort_desc_nulls_first(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left").select("doc_id", "toxic")
    return R.order_by(both, ("toxic", "desc"), "doc_id").limit(20)


@query("SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice DESC NULLS FIRST, p_partkey LIMIT 15")
def order_by_ordinal_alias(spark, folder):
    doubled = table(spark, folder, "part").select("p_partkey", (col("p_size") * 2).alias("twice"))
    return R.limit(R.order_by(doubled, (2, "desc"), "p_partkey"), 15)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 25")
def limit_offset(spark, folder):
    return R.limit(R.order_by(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey"), 10, 25)


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
def offset_only(spark, folder):
    return R.limit(R.order_by(table(spark, folder, "nation").select("n_nationkey"), 1), offset=20)


def _keys(spark, folder):
    return table(spark, folder, "customer").select(col("c_nationkey").alias("k")), table(spark, folder, "supplier").select(col("s_nationkey").alias("j"))


def _set(op: str, every: bool):
    def run(spark, folder):
        a, b = _keys(spark, folder)
        return R.set_operation(op, a, b, every)

    return run


for _op in ("union", "intersect", "except"):
    for _every in (False, True):
        _f = _set(_op, _every)
        _f.__name__ = f"{_op}_all" if _every else {"except": "except_"}.get(_op, _op)
        query(f"SELECT c_nationkey AS k FROM customer {_op.upper()}{' ALL' if _every else ''} SELECT s_nationkey FROM supplier")(_f)


@query("""(SELECT quality AS v FROM documents LEFT JOIN labels USING (doc_id) UNION SELECT toxic + 1 FROM labels) ORDER BY v DESC NULLS FIRST LIMIT 2""")
def setop_nulls_order_limit(spark, folder):
    """NULL equals NULL in a set operation."""
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left").select(col("quality").alias("v"))
    return R.order_by(R.set_operation("union", both, table(spark, folder, "labels").select(col("toxic") + 1)), ("v", "desc")).limit(2)
