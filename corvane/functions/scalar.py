"""Scalar functions and operators of the dialect, as Column builders.

Everything is built from Spark's own expressions, so it stays in generated code.  Arguments are Columns, or Python values
that become literals.  Where a function's behaviour differs from Spark's function of the same name, its docstring says how.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Arg = Column | str | int | float | bool | None


def col(x: Arg) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _int(x: Arg) -> Column:
    return col(x).cast("bigint")


def _guard(condition: Column, message: str, value: Column, kind: str) -> Column:
    """value, or an error where condition holds."""
    return F.when(condition, F.raise_error(F.lit(message)).cast(kind)).otherwise(value)


# ---- integers: 64 bits, checked, division towards zero


def int_div(a: Arg, b: Arg) -> Column:
    """Integer division towards zero; Spark's / would give a double."""
    return F.call_function("div", _int(a), _int(b))


def modulo(a: Arg, b: Arg) -> Column:
    """Remainder with the sign of the dividend; zero divisors are errors."""
    return _int(a) % _int(b)


def negate(a: Arg) -> Column:
    return -col(a)


# ---- text


_WHITE = r"(?U)^\s+|\s+$"


def upper(x: Arg) -> Column:
    return F.upper(col(x))


def lower(x: Arg) -> Column:
    return F.lower(col(x))


def trim(x: Arg) -> Column:
    """Strips all Unicode white space at both ends; Spark strips blanks only."""
    return F.regexp_replace(col(x), _WHITE, "")


def length(x: Arg) -> Column:
    return F.char_length(col(x)).cast("bigint")


def concat(*xs: Arg) -> Column:
    """NULL arguments are passed over, and all NULL gives ''."""
    return F.concat_ws("", *(col(x).cast("string") for x in xs))


def concat_op(a: Arg, b: Arg) -> Column:
    """a || b: NULL if either is."""
    return F.concat(col(a), col(b))


def replace(x: Arg, old: Arg, new: Arg) -> Column:
    return F.replace(col(x), col(old), col(new))


def position(part: Arg, x: Arg) -> Column:
    """1-based, 0 where absent, 1 for an empty part."""
    return F.position(col(part), col(x)).cast("bigint")


def left(x: Arg, n: Arg) -> Column:
    """The first n characters; a negative n drops as many from the far end."""
    n = col(n).cast("int")
    return F.substring(col(x), F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.char_length(col(x)) + n, F.lit(0))))


def right(x: Arg, n: Arg) -> Column:
    """The last n characters; a negative n drops as many from the front."""
    n, size = col(n).cast("int"), F.char_length(col(x))
    start = F.when(n >= 0, F.greatest(size - n, F.lit(0))).otherwise(F.least(-n, size))
    return F.substring(col(x), start + 1, size)


def substring(x: Arg, start: Arg, count: Arg = None) -> Column:
    """The window [start, start + count) cut to the text, with places from 1; a negative count is an error."""
    start = col(start).cast("bigint")
    first = F.greatest(start, F.lit(1)).cast("int")
    if count is None:
        return F.substring(col(x), first, F.char_length(col(x)))
    count = col(count).cast("bigint")
    size = F.greatest(F.least(start + count, F.lit(2**31 - 1)) - first, F.lit(0)).cast("int")
    return _guard(count < 0, "negative substring length not allowed", F.substring(col(x), first, size), "string")


# ---- numbers


def absolute(x: Arg) -> Column:
    return F.abs(col(x))


#: From here on doubles have no fractions.
_WHOLE = float(2**52)


def _whole(x: Column, rounded: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= _WHOLE), x).otherwise(rounded.cast("double"))


def floor(x: Arg) -> Column:
    """Of a double, a double; Spark gives a bigint, which saturates.  Integers: use as they are."""
    return _whole(col(x), F.floor(col(x)))


def ceil(x: Arg) -> Column:
    return _whole(col(x), F.ceil(col(x)))


ceiling = ceil


def round_even(x: Arg) -> Column:
    """Ties go to the even neighbour; Spark's round goes away from zero."""
    return F.rint(col(x))


def sqrt(x: Arg) -> Column:
    """A negative argument is an error; Spark gives NaN."""
    x = col(x).cast("double")
    return _guard(x < 0, "cannot take square root of a negative number", F.sqrt(x), "double")


def power(x: Arg, y: Arg) -> Column:
    """A result that isn't finite is an error."""
    made = F.power(col(x).cast("double"), col(y).cast("double"))
    return _guard(F.isnan(made) | (F.abs(made) == float("inf")), "value out of range: overflow", made, "double")


pow = power  # noqa: A001


# ---- time


def extract(field: str, x: Arg) -> Column:
    """A double; seconds carry their fraction."""
    if field.lower() not in ("year", "month", "day", "hour", "minute", "second"):
        raise NotImplementedError(f"extract({field})")
    return F.extract(F.lit(field), col(x)).cast("double")


def current_timestamp() -> Column:
    return F.current_timestamp()


now = current_timestamp


# ---- choice


def coalesce(*xs: Arg) -> Column:
    return F.coalesce(*map(col, xs))


def nullif(a: Arg, b: Arg) -> Column:
    return F.when(col(a) == col(b), F.lit(None)).otherwise(col(a))


def is_distinct(a: Arg, b: Arg) -> Column:
    return ~col(a).eqNullSafe(col(b))


_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def any_of(x: Arg, op: str, array: Column) -> Column:
    """x op ANY (array), in three-valued logic."""
    return F.exists(array, lambda e: _COMPARE[op](col(x), e))


def like_pattern(pattern: str, escape: str | None = "\\") -> str:
    """A pattern in Spark's own escape.  An escape before an ordinary character, or at the end, stands for itself; None or '' turns escapes off."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and pattern[i + 1 : i + 2] in ("%", "_", escape):
            out.append("\\" + pattern[i + 1] if pattern[i + 1] in "%_\\" else pattern[i + 1])
            i += 1
        else:
            out.append("\\\\" if c == "\\" else c)
        i += 1
    return "".join(out)


def like(x: Arg, pattern: str, escape: str | None = "\\", ignore_case: bool = False) -> Column:
    """LIKE and ILIKE.  The pattern stays one of Spark's own, so that prefixes reach the scan."""
    own = like_pattern(pattern, escape)
    return F.lower(col(x)).like(own.lower()) if ignore_case else col(x).like(own)


# ---- arrays


def subscript(array: Column, *places: Arg) -> Column:
    """array[i][j]...: places from 1; out of range or NULL gives NULL."""
    for place in places:
        array = F.get(array, col(place).cast("int") - 1)
    return array


def array(*xs: Arg) -> Column:
    return F.array(*map(col, xs))
