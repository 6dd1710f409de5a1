"""Type names of the dialect, their Spark types, and the rule that numeric families don't mix without a cast."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Names and what they are carried as.
NAMES = {
    "smallint": T.LongType(), "int2": T.LongType(), "integer": T.LongType(), "int": T.LongType(), "int4": T.LongType(), "bigint": T.LongType(), "int8": T.LongType(),
    "oid": T.LongType(), "boolean": T.BooleanType(), "bool": T.BooleanType(), "real": T.FloatType(), "float4": T.FloatType(), "double precision": T.DoubleType(),
    "float8": T.DoubleType(), "double": T.DoubleType(), "text": T.StringType(), "varchar": T.StringType(), "character varying": T.StringType(), "char": T.StringType(),
    "character": T.StringType(), "bpchar": T.StringType(), "bytea": T.BinaryType(), "uuid": T.StringType(), "date": T.DateType(), "time": T.TimeType(6),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(), "timestamp without time zone": T.TimestampNTZType(),
}
#: What a bare numeric is carried as; a narrow precision keeps Spark's scale rules from cutting digits.
NUMERIC = T.DecimalType(28, 10)
INTERVAL = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])
#: Ranges that are checked where a value is stored in, or cast to, a narrow integer.
RANGES = {"smallint": 15, "int2": 15, "integer": 31, "int": 31, "int4": 31, "bigint": 63, "int8": 63, "oid": 32}


class DialectError(Exception):
    """An error of the dialect, with its SQLSTATE."""

    def __init__(self, state: str, message: str):
        super().__init__(f"{message} (SQLSTATE {state})")
        self.state = state


class TypeMismatch(DialectError):
    def __init__(self, message: str):
        super().__init__("42804", message)


class NotSupported(DialectError, NotImplementedError):
    def __init__(self, message: str):
        super().__init__("0A000", message)


def spark_type(name: str) -> T.DataType:
    """The Spark type of a dialect type name such as varchar(5), numeric(10, 2), float(24) or int[]."""
    name = " ".join(name.lower().split())
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2]), True)
    base, args = re.fullmatch(r"([a-z0-9 ]+?)\s*(?:\(([\d\s,]+)\))?", name).groups()
    given = [int(a) for a in args.split(",")] if args else []
    if base in ("numeric", "decimal"):
        return T.DecimalType(given[0], given[1] if len(given) > 1 else 0) if given else NUMERIC
    if base == "float":
        return T.FloatType() if given and given[0] <= 24 else T.DoubleType()
    if base == "interval":
        return INTERVAL
    if base not in NAMES:
        raise NotSupported(f"type {name}")
    return NAMES[base]


def family(kind: T.DataType) -> str:
    """Types of one family take part in one operation; others need a cast."""
    if isinstance(kind, T.ArrayType):
        return f"{family(kind.elementType)}[]"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, T.DecimalType):
        return "numeric"
    if kind == INTERVAL:
        return "interval"
    return {
        T.FloatType: "real", T.DoubleType: "double", T.StringType: "text", T.BooleanType: "boolean", T.DateType: "date", T.TimestampNTZType: "timestamp",
        T.TimestampType: "timestamptz", T.BinaryType: "bytea", T.TimeType: "time", T.NullType: "unknown",
    }.get(type(kind), kind.simpleString())


def check_same(*kinds: T.DataType, what: str = "operator") -> None:
    """Raises unless all are of one family; a bare NULL goes with any."""
    found = {family(k) for k in kinds} - {"unknown"}
    if len(found) > 1:
        raise TypeMismatch(f"{what} over {' and '.join(sorted(found))}")


def check_columns(df: DataFrame, *names: str, what: str = "operator") -> None:
    check_same(*(df.schema[n].dataType for n in names), what=what)
