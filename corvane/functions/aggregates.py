"""Aggregates where the dialect and Spark part ways.  count, min, max, bool_and, bool_or, stddev and variance are Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_int(x: Column) -> Column:
    """A bigint; overflow is an error."""
    return F.sum(x.cast("bigint"))


def sum_real(x: Column) -> Column:
    return F.sum(x).cast("float")


def avg_int(x: Column, distinct: bool = False) -> Column:
    """sum / count in integers, towards zero; Spark gives a double."""
    x = x.cast("bigint")
    total, n = (F.sum_distinct(x), F.count_distinct(x)) if distinct else (F.sum(x), F.count(x))
    return F.when(n > 0, F.call_function("div", total, n))


def stddev(x: Column) -> Column:
    return F.stddev_samp(x.cast("double"))


def variance(x: Column) -> Column:
    return F.var_samp(x.cast("double"))


def array_agg(x: Column, order: Column) -> Column:
    """All values, NULLs too, in the order of ``order``; NULL over no rows.  Spark drops NULLs and keeps no order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x"))))
    return F.when(F.count(F.lit(1)) > 0, F.transform(rows, lambda r: r["x"]))


def array_agg_distinct(x: Column, order: Column) -> Column:
    """Each value once, NULL among them, by its first place."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x"))))
    return F.when(F.count(F.lit(1)) > 0, F.array_distinct(F.transform(rows, lambda r: r["x"])))


def _joined(rows: Column) -> Column:
    step = lambda a, r: F.when(a.isNull(), r["x"]).otherwise(F.concat(a, F.coalesce(r["d"], F.lit("")), r["x"]))
    return F.aggregate(rows, F.lit(None).cast("string"), step)


def string_agg(x: Column, delimiter: Column, order: Column) -> Column:
    """Values that aren't NULL, each but the first after its own row's delimiter."""
    return _joined(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x"), delimiter.alias("d"))))))


def string_agg_distinct(x: Column, delimiter: Column, order: Column) -> Column:
    """Each (value, delimiter) once, by its first place."""
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x"), delimiter.alias("d")))))
    return _joined(F.array_distinct(F.transform(rows, lambda r: F.struct(r["x"].alias("x"), r["d"].alias("d")))))
