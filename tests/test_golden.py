"""Behaviour of the dialect on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import aggregates as A
from corvane.functions import casts, intervals
from corvane.functions import scalar as S
from corvane.functions.types import DialectError, NotSupported, TypeMismatch, check_same, spark_type
from corvane.operators import relational as R


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_rounding_and_powers(spark):
    got = one(spark, S.floor(2.5), S.ceil(2.5), S.round_even(2.5), S.sqrt(9), S.power(2, 10), S.modulo(7, 3), S.absolute(-5))
    assert got == (2.0, 3.0, 2.0, 3.0, 1024.0, 1, 5)
    assert one(spark, S.floor(float("inf")), S.ceil(1e300)) == (math.inf, 1e300)


@pytest.mark.parametrize("broken", [lambda: S.sqrt(-1), lambda: S.power(1e300, 2), lambda: S.int_div(1, 0), lambda: S.modulo(1, 0), lambda: S.substring("maple", 1, -1)])
def test_domain_errors(spark, broken):
    with pytest.raises(Exception, match="(?i)zero|out of range|square root|negative"):
        spark.range(1).select(broken()).collect()


def test_text_functions(spark):
    none = F.lit(None).cast("string")
    for text in ("crème brûlée", "", "x", "tea & toast"):
        got = one(spark, S.concat(text, none, "?"), S.replace(text, "e", "--"), S.position("t", text), S.left(text, 3), S.right(text, 3), S.length(S.trim(f"\t {text} \n")))
        assert got == (text + "?", text.replace("e", "--"), text.find("t") + 1, text[:3], text[-3:], len(text))
        assert one(spark, S.left(text, -2), S.right(text, -2), S.left(text, -20), S.right(text, -20)) == (text[:-2], text[2:], "", "")
        assert one(spark, S.substring(text, 0, 2), S.substring(text, -2, 3), S.substring(text, 2), S.substring(text, 2, 2**31)) == (text[:1], "", text[1:], text[1:])
    assert one(spark, S.concat(none, "?"), S.replace(none, "a", "b"), S.position("a", none), S.left(none, 5), S.right(none, 5)) == ("?", None, None, None, None)


def test_like(spark):
    assert one(spark, S.like("a_b%c", "a#_b#%c", "#"), S.like("axb%c", "a#_b#%c", "#"), S.like("Quince", "q%E", ignore_case=True), S.like(r"a\x", r"a\x"), S.like("a\\", "a\\"), S.like(r"\a", "_a", None)) == (True, False, True, True, True, True)


def test_integers(spark):
    assert one(spark, S.int_div(7, -2), S.int_div(-7, 2), S.modulo(-7, 2)) == (-3, -3, -1)
    frame = spark.createDataFrame([(k, v) for k, v in zip("pqpqpq", (4, 7, 4, 7, None, 12), strict=True)], "crate string, amount int")
    assert tuple(frame.agg(F.count_distinct("amount"), F.sum_distinct("amount"), A.avg_int(F.col("amount"), True)).first()) == (3, 23, 7)


def test_casts(spark):
    assert one(spark, casts.cast(F.lit(2.5), "double", "int"), casts.cast(F.lit(3.5), "double", "int"), casts.cast(F.lit("2.5").cast("decimal(4,1)"), "numeric(4,1)", "int")) == (2, 4, 3)
    assert one(spark, casts.cast(F.lit("t"), "text", "boolean"), casts.cast(F.lit(True), "boolean", "text"), casts.cast(F.lit("\\x00ff"), "text", "bytea")) == (True, "true", bytearray(b"\x00\xff"))
    for bad in (casts.cast(F.lit("yes"), "text", "boolean"), casts.cast(F.lit("x"), "text", "int"), casts.cast(F.lit(40000), "bigint", "smallint")):
        with pytest.raises(Exception):
            spark.range(1).select(bad).collect()
    for source, target in (("date", "timestamp"), ("int", "boolean"), ("real", "numeric(5,1)")):
        with pytest.raises(NotSupported):
            casts.cast(F.lit(None), source, target)


def test_strict_types():
    with pytest.raises(TypeMismatch):
        check_same(spark_type("int"), spark_type("double"))
    check_same(spark_type("smallint"), spark_type("bigint"))
    assert spark_type("numeric(10,2)").simpleString() == "decimal(10,2)"
    assert spark_type("int[]").simpleString() == "array<bigint>"


def test_intervals(spark):
    rows = spark.createDataFrame([(1, "1 mon"), (2, "30 days"), (3, "31 days"), (4, "1 day 02:30")], "id int, t string").withColumn("s", intervals.parse(F.col("t")))
    assert [r.id for r in rows.orderBy(intervals.estimate(F.col("s")), "id").collect()] == [4, 1, 2, 3]
    assert rows.filter(intervals.compare(F.col("s"), "=", intervals.parse(F.lit("30 days")))).count() == 2
    assert rows.select(intervals.estimate(F.col("s"))).distinct().count() == 3
    shown = one(spark, intervals.to_text(intervals.parse(F.lit("1 year 2 mons -3 days 04:05:06.7"))), intervals.to_text(intervals.interval()))
    assert shown == ("1 year 2 mons -3 days 04:05:06.7", "00:00:00")
    day = F.lit("2024-01-31").cast("date")
    assert str(one(spark, intervals.shift_date(day, intervals.parse(F.lit("1 mon"))))[0]) == "2024-02-29 00:00:00"
    assert one(spark, intervals.shift_time(F.lit(23 * 3600 * 1_000_000), intervals.parse(F.lit("02:00:00"))))[0] == 3600 * 1_000_000
    with pytest.raises(Exception, match="invalid interval"):
        spark.range(1).select(intervals.parse(F.lit("1 moon"))).collect()


def test_ordered_aggregates(spark):
    rows = spark.createDataFrame([(1, 1, "a", ","), (2, 1, "a", ","), (3, None, None, ","), (4, None, None, ","), (5, 2, "a", ";"), (6, 3, "b", None)], "o int, id int, label string, d string")
    got = rows.agg(A.array_agg_distinct(F.col("id"), F.col("o")).alias("x"), A.string_agg(F.col("label"), F.col("d"), F.col("o")).alias("y"), A.array_agg(F.col("id"), F.col("o")).alias("z")).first()
    assert got.x == [1, None, 2, 3] and got.y == "a,a;ab" and got.z == [1, 1, None, None, 2, 3]
    empty = rows.filter("false").agg(A.array_agg(F.col("id"), F.col("o")).alias("x"), A.string_agg(F.col("label"), F.col("d"), F.col("o")).alias("y")).first()
    assert tuple(empty) == (None, None)


def test_distinct_on(spark):
    rows = spark.createDataFrame([(1, "ada", 10), (2, "ada", 30), (3, "ada", 20), (4, "bob", 5), (5, "bob", 15), (6, None, 1), (7, None, 2)], "id int, customer string, amount int")
    got = R.distinct_on(rows, ["customer"], R.ordered("amount", descending=True)).collect()
    assert sorted((r.customer or "", r.amount) for r in got) == [("", 2), ("ada", 30), ("bob", 15)]


def test_set_operations(spark):
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(2,), (3,), (4,)], "k int")
    run = lambda op, every=False: sorted(r.id for r in R.set_operation(op, a, b, every).collect())
    assert run("union") == [1, 2, 3, 4] and run("union", True) == [1, 2, 2, 3, 3, 4] and run("intersect") == [2, 3] and run("except") == [1]
    with pytest.raises(TypeMismatch):
        R.set_operation("union", a, b.selectExpr("cast(k as double)"))


def test_series_and_unnest(spark):
    values = lambda df: [r[0] for r in df.collect()]
    assert values(R.generate_series(spark, 3, 1, -1)) == [3, 2, 1] and values(R.generate_series(spark, 1, 0)) == [] and values(R.generate_series(spark, 1, None)) == []
    for bad in ((1, 2, 0), (1, 2_000_000, 1)):
        with pytest.raises(DialectError):
            R.generate_series(spark, *bad)
    rows = spark.createDataFrame([(1, 3, [1, None, 3]), (3, 1, None)], "a int, b int, v array<int>")
    assert [r.generate_series for r in R.lateral_series(rows, F.col("a"), F.col("b")).collect()] == [1, 2, 3]
    assert [r["unnest"] for r in R.unnest(rows, F.col("v")).collect()] == [1, None, 3]


def test_arrays(spark):
    assert one(spark, S.subscript(F.array(F.lit(10), F.lit(20)), 2), S.subscript(F.array(F.lit(1)), 0), S.subscript(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))), 2, 1)) == (20, None, 3)
    assert one(spark, S.any_of(20, "=", F.array(F.lit(10), F.lit(20), F.lit(None))), S.any_of(9, "=", F.array().cast("array<int>")), S.any_of(9, "=", F.array(F.lit(1), F.lit(None)))) == (True, False, None)


def test_in_subquery_as_a_value(spark):
    rows, among = spark.createDataFrame([(100,), (50,), (None,)], "x int"), spark.createDataFrame([(50,), (None,)], "v int")
    got = {r.x: r.f for r in R.in_subquery(rows, "x", among, "f").collect()}
    assert got == {100: None, 50: True, None: None}
    assert {r.x: r.f for r in R.in_subquery(rows, "x", among.filter("false"), "f", negated=True).collect()} == {100: True, 50: True, None: True}


def test_scalar_subquery_of_many_rows_is_an_error(spark):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        spark.sql("SELECT (SELECT * FROM VALUES (1), (2))").collect()
