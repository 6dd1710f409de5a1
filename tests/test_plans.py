"""Shapes of plans."""

from corvane.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    df = catalogue.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "index_range_scan")
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate:timestamp_ntz>" in text


def test_subqueries_become_joins(spark):
    assert "LeftSemi" in plan(spark, "semi_exists") and "LeftAnti" in plan(spark, "anti_not_exists")


def test_comma_join_is_an_equi_join(spark):
    assert "Cartesian" not in plan(spark, "join_comma_where") and "NestedLoop" not in plan(spark, "join_comma_where")


def test_order_with_limit_is_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "flagship_revenue")
