"""CAST as the dialect has it: which pairs there are, how they round, what they refuse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import INTERVAL, RANGES, NotSupported, family, spark_type

_TRUE, _FALSE = ("true", "t", "1"), ("false", "f", "0")
_NUMBERS = ("integer", "double", "real", "numeric")


def _ranged(x: Column, bits: int) -> Column:
    low, high = (0, 2**32 - 1) if bits == 32 else (-(2**bits), 2**bits - 1)
    if bits == 63:
        return x
    return F.when((x < low) | (x > high), F.raise_error(F.lit("integer out of range")).cast("bigint")).otherwise(x)


def cast(x: Column, source: str | T.DataType, target: str) -> Column:
    """x, of a type named or given, as the target type.

    Doubles become integers by rounding half to even, decimals by rounding half away from zero.  Text must be wholly a
    value of the type, or there is an error.  Pairs that the dialect doesn't have raise NotSupported.
    """
    given = spark_type(source) if isinstance(source, str) else source
    wanted, name = spark_type(target), " ".join(target.lower().split())
    if isinstance(given, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return F.transform(x, lambda e: cast(e, given.elementType, name[:-2]))
    a, b = family(given), family(wanted)
    bits = RANGES.get(name, 63)
    if a == b:
        if b == "integer":
            return _ranged(x.cast("bigint"), bits)
        return x if b == "interval" else x.cast(wanted) if b != "text" else x
    if b == "text":
        if a == "boolean":
            return F.when(x, "true").when(~x, "false")
        if a == "bytea":
            return F.concat(F.lit("\\x"), F.lower(F.hex(x)))
        if a == "interval":
            from .intervals import to_text

            return to_text(x)
        return x.cast("string")
    if a == "text":
        if b == "boolean":
            given_text = F.lower(F.trim(x))
            bad = F.raise_error(F.concat(F.lit("invalid boolean: "), x)).cast("boolean")
            return F.when(x.isNull(), F.lit(None)).when(given_text.isin(*_TRUE), True).when(given_text.isin(*_FALSE), False).otherwise(bad)
        if b == "bytea":
            return F.unhex(F.regexp_replace(x, r"^\\x", ""))
        if b == "interval":
            from .intervals import parse

            return parse(x)
        if b == "integer":
            return _ranged(x.cast("bigint"), bits)
        return x.cast(wanted)
    if b == "integer" and a in ("double", "real"):
        return _ranged(F.rint(x.cast("double")).cast("bigint"), bits)
    if b == "integer" and a == "numeric":
        return _ranged(F.round(x, 0).cast("bigint"), bits)
    if {a, b} == {"real", "numeric"}:
        raise NotSupported(f"cast from {a} to {b}")
    if a in _NUMBERS and b in _NUMBERS:
        return x.cast(wanted)
    if {a, b} == {"timestamp", "timestamptz"}:
        return x.cast(wanted)
    raise NotSupported(f"cast from {a} to {b}")


__all__ = ["INTERVAL", "cast"]
