"""Relational operators where the dialect has its own rules.  Plain joins, grouping and filters are Spark's."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.types import DialectError, check_same

#: Rows of a series, at most.
SERIES_ROWS = 1_000_000


def ordered(x: Column | str, descending: bool = False, nulls: str | None = None) -> Column:
    """A sort key: NULLs are last ascending and first descending, unless ``nulls`` says otherwise."""
    x = F.col(x) if isinstance(x, str) else x
    first = descending if nulls is None else nulls.lower() == "first"
    if descending:
        return x.desc_nulls_first() if first else x.desc_nulls_last()
    return x.asc_nulls_first() if first else x.asc_nulls_last()


def order_by(df: DataFrame, *keys: int | str | Column | tuple) -> DataFrame:
    """ORDER BY: an int is a place in the output, from 1; (key, 'desc'[, 'first' | 'last']) gives direction."""

    def key(k) -> Column:
        k, *rest = k if isinstance(k, tuple) else (k,)
        if isinstance(k, int):
            if not 1 <= k <= len(df.columns):
                raise DialectError("42P10", f"ORDER BY position {k} is not in select list")
            k = df.columns[k - 1]
        words = [r.lower() for r in rest]
        return ordered(k, "desc" in words, next((w for w in words if w in ("first", "last")), None))

    return df.orderBy(*map(key, keys))


def limit(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if count is None else df.limit(count)


def distinct_on(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """DISTINCT ON: the first row of each group of keys, by order; NULL keys are one group.  order may start with the keys."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [ordered(k) for k in keys])))
    return df.withColumn("__first", first).filter(F.col("__first") == 1).drop("__first")


def set_operation(op: str, a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """UNION, INTERSECT or EXCEPT [ALL], by position, names from the left; types must agree, and NULL columns take the other's."""
    if len(a.columns) != len(b.columns):
        raise DialectError("42601", "each set operand must have the same number of columns")
    for x, y in zip(a.schema, b.schema, strict=True):
        check_same(x.dataType, y.dataType, what=op)
    b = b.toDF(*a.columns)
    if op == "union":
        return a.unionAll(b) if every else a.unionAll(b).distinct()
    if op == "intersect":
        return a.intersectAll(b) if every else a.intersect(b)
    return a.exceptAll(b) if every else a.subtract(b)


def values(spark: SparkSession, rows: Iterable[Sequence], schema: str | T.StructType | None = None) -> DataFrame:
    """VALUES: columns column1, column2, ... unless a schema names them; integers are bigint."""
    rows = [tuple(r) for r in rows]
    if schema is None:
        made = spark.createDataFrame(rows, [f"column{i + 1}" for i in range(len(rows[0]))])
        return made
    return spark.createDataFrame(rows, schema)


def unit(spark: SparkSession) -> DataFrame:
    """The one row of a SELECT without FROM."""
    return spark.range(1).select()


def generate_series(spark: SparkSession, start: int | None, stop: int | None, step: int | None = 1, name: str = "generate_series") -> DataFrame:
    """Integers from start through stop; none in the wrong direction or with a NULL."""
    if None in (start, stop, step):
        return spark.range(0).select(F.col("id").alias(name))
    if step == 0:
        raise DialectError("22023", "step size cannot equal zero")
    if max(0, (stop - start) // step + 1) > SERIES_ROWS:
        raise DialectError("54000", "series too large")
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias(name))


def series(start: Column, stop: Column, step: Column | int = 1) -> Column:
    """generate_series of a row's own values, as an array to explode; empty in the wrong direction or with a NULL."""
    step = step if isinstance(step, Column) else F.lit(step)
    start, stop, step = (c.cast("bigint") for c in (start, stop, step))
    rows = F.when((stop >= start) & (step > 0) | (stop <= start) & (step < 0), F.sequence(start, stop, step))
    rows = F.when(step == 0, F.raise_error(F.lit("step size cannot equal zero")).cast("array<bigint>")).otherwise(rows)
    return F.coalesce(rows, F.array().cast("array<bigint>"))


def lateral_series(df: DataFrame, start: Column, stop: Column, step: Column | int = 1, name: str = "generate_series", outer: bool = False) -> DataFrame:
    made = series(start, stop, step)
    return df.select("*", (F.explode_outer(made) if outer else F.explode(made)).alias(name))


def unnest(df: DataFrame, array: Column, name: str = "unnest", outer: bool = False, dimensions: int = 1) -> DataFrame:
    """A row for each element, in row-major order; a NULL or empty array gives none, or one NULL with outer."""
    for _ in range(dimensions - 1):
        array = F.flatten(array)
    return df.select("*", (F.explode_outer(array) if outer else F.explode(array)).alias(name))


def theta_join(a: DataFrame, b: DataFrame, on: Column, kind: str = "inner") -> DataFrame:
    """A join on any condition."""
    return a.join(b, on, {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross"}[kind])


def in_subquery(df: DataFrame, x: str, among: DataFrame, name: str, negated: bool = False) -> DataFrame:
    """df with ``x [NOT] IN (SELECT ... )`` as a value, in three-valued logic; Spark loses the NULL there.

    among has one column.  It is reduced to its distinct values and two counts before it meets df.
    """
    column = F.col(among.columns[0])
    facts = among.agg(F.count(F.lit(1)).alias("__rows"), F.count(F.when(column.isNull(), 1)).alias("__nulls"))
    known = among.select(column.alias("__value")).filter("__value IS NOT NULL").distinct()
    joined = df.join(known, F.col(x) == F.col("__value"), "left").crossJoin(F.broadcast(facts))  # facts: one row
    found = (
        F.when(F.col("__rows") == 0, F.lit(False)).when(F.col(x).isNull(), F.lit(None)).when(F.col("__value").isNotNull(), F.lit(True)).when(F.col("__nulls") > 0, F.lit(None)).otherwise(F.lit(False))
    )
    return joined.withColumn(name, ~found if negated else found).drop("__value", "__rows", "__nulls")


def lateral_top(df: DataFrame, other: DataFrame, on: Column | dict[str, str], order: Sequence[Column], n: int = 1, outer: bool = False) -> DataFrame:
    """JOIN LATERAL (SELECT ... WHERE on ORDER BY order LIMIT n).

    Where on is columns of df with those of other that they equal, other is cut to n rows a key before it moves to the join.
    Any other condition ranks other within each row of df that it meets.
    """
    if isinstance(on, dict):
        keys = list(on.values())
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        top = other.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")
        return df.join(top, all_of(*(df[a] == top[b] for a, b in on.items())), "left" if outer else "inner")
    tagged = df.withColumn("__row", F.monotonically_increasing_id())
    met = tagged.join(other, on, "left" if outer else "inner")
    place = F.row_number().over(Window.partitionBy("__row").orderBy(*order))
    return met.withColumn("__place", place).filter(F.col("__place") <= n).drop("__row", "__place")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
