"""Calendar intervals as struct<months, days, micros>, with the dialect's comparison and arithmetic.

Intervals are compared by an estimate in which a month has 30 days and a day 24 hours.  Dates and timestamps take the
months first, cut to the month's last day, then the days, then the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Micros, days or months of each unit, singular.
_UNITS = {
    "microsecond": ("micros", 1), "millisecond": ("micros", 1000), "second": ("micros", 1_000_000), "sec": ("micros", 1_000_000), "minute": ("micros", 60_000_000),
    "min": ("micros", 60_000_000), "hour": ("micros", 3_600_000_000), "day": ("days", 1), "week": ("days", 7), "month": ("months", 1), "mon": ("months", 1), "year": ("months", 12),
}


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    part = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(part(months, "int").alias("months"), part(days, "int").alias("days"), part(micros, "bigint").alias("micros"))


def parse(text: Column) -> Column:
    """From text such as '1 year 2 mons -3 days 04:05:06.7'; anything else is an error."""
    sums = {"months": [], "days": [], "micros": []}
    for unit, (part, size) in _UNITS.items():
        plural = f"{unit}s?"
        number = F.regexp_extract(text, rf"(?i)([+-]?\d+(?:\.\d+)?)\s*{plural}(?![a-z])", 1)
        sums[part].append(F.when(number != "", F.round(number.cast("decimal(28,6)") * size, 0).cast("bigint")).otherwise(F.lit(0)))
    clock = r"([+-]?)(\d+):(\d{1,2})(?::(\d{1,2}(?:\.\d{1,6})?))?"
    piece = lambda i: F.regexp_extract(text, clock, i)
    seconds = F.when(piece(4) == "", F.lit("0")).otherwise(piece(4)).cast("decimal(18,6)")
    micros = piece(2).cast("bigint") * 3_600_000_000 + piece(3).cast("bigint") * 60_000_000 + (seconds * 1_000_000).cast("bigint")
    sums["micros"].append(F.when(text.rlike(clock), F.when(piece(1) == "-", -micros).otherwise(micros)).otherwise(F.lit(0)))
    total = {k: sum(v[1:], v[0]) for k, v in sums.items()}
    words = "|".join(_UNITS)
    fine = text.rlike(rf"(?i)^\s*(?:(?:[+-]?\d+(?:\.\d+)?\s*(?:{words})s?|{clock})\s*)+$")
    made = interval(total["months"], total["days"], total["micros"])
    return F.when(text.isNull(), F.lit(None)).when(fine, made).otherwise(F.raise_error(F.concat(F.lit("invalid interval: "), text)).cast("struct<months:int,days:int,micros:bigint>"))


def estimate(x: Column) -> Column:
    """The number by which intervals are ordered, compared and grouped."""
    return ((x["months"].cast("decimal(28,0)") * 30 + x["days"]) * DAY + x["micros"]).cast("decimal(38,0)")


def compare(a: Column, op: str, b: Column) -> Column:
    from .scalar import _COMPARE

    return _COMPARE[op](estimate(a), estimate(b))


def add(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), interval(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"]))


def negate(a: Column) -> Column:
    return times(a, F.lit(-1))


def subtract(a: Column, b: Column) -> Column:
    return add(a, negate(b))


def times(a: Column, n: Column) -> Column:
    return F.when(a.isNotNull() & n.isNotNull(), interval(a["months"] * n, a["days"] * n, a["micros"] * n))


def shift(when: Column, by: Column, sign: int = 1) -> Column:
    """A date, timestamp or timestamptz plus (or minus) an interval: a timestamp, or a timestamptz of one."""
    by = by if sign > 0 else negate(by)
    moved = when + F.make_ym_interval(F.lit(0), by["months"])
    seconds = by["micros"].cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(8,0)")
    return moved + F.make_dt_interval(by["days"], F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def shift_date(day: Column, by: Column, sign: int = 1) -> Column:
    return shift(day.cast("timestamp_ntz"), by, sign)


def shift_time(micros_of_day: Column, by: Column, sign: int = 1) -> Column:
    """A time of day, as micros since midnight, plus an interval's micros, around the clock."""
    return F.pmod(micros_of_day + by["micros"] * sign, F.lit(DAY))


def to_text(x: Column) -> Column:
    """'1 year 2 mons 3 days 04:05:06', as the dialect shows it."""
    years, months = F.call_function("div", x["months"], F.lit(12)), x["months"] % 12
    unit = lambda n, one, many: F.when(n != 0, F.concat(n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many))))
    m = F.abs(x["micros"])
    clock = F.format_string("%s%02d:%02d:%02d", F.when(x["micros"] < 0, F.lit("-")).otherwise(F.lit("")), F.call_function("div", m, F.lit(3_600_000_000)), F.call_function("div", m, F.lit(60_000_000)) % 60, F.call_function("div", m, F.lit(1_000_000)) % 60)
    rest = m % 1_000_000
    clock = F.concat(clock, F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), 6, "0"), F.lit("0")))))
    shown = F.when((x["micros"] != 0) | ((x["months"] == 0) & (x["days"] == 0)), clock)
    return F.when(x.isNotNull(), F.concat_ws(" ", unit(years, " year", " years"), unit(months, " mon", " mons"), unit(x["days"], " day", " days"), shown))


def to_text_sql(x: str) -> str:
    """to_text() of a SQL expression, as SQL."""
    unit = lambda n, one: f"CASE WHEN {n} <> 0 THEN concat(CAST({n} AS STRING), ' {one}', CASE WHEN {n} = 1 THEN '' ELSE 's' END) END"
    m = f"abs({x}.micros)"
    clock = f"format_string('%s%02d:%02d:%02d', CASE WHEN {x}.micros < 0 THEN '-' ELSE '' END, {m} div 3600000000L, {m} div 60000000L % 60, {m} div 1000000L % 60)"
    rest = f"CASE WHEN {m} % 1000000L = 0 THEN '' ELSE concat('.', rtrim('0', lpad(CAST({m} % 1000000L AS STRING), 6, '0'))) END"
    shown = f"CASE WHEN {x}.micros <> 0 OR ({x}.months = 0 AND {x}.days = 0) THEN concat({clock}, {rest}) END"
    return f"CASE WHEN {x} IS NOT NULL THEN concat_ws(' ', {unit(f'{x}.months div 12', 'year')}, {unit(f'{x}.months % 12', 'mon')}, {unit(f'{x}.days', 'day')}, {shown}) END"


def parse_sql(x: str) -> str:
    """parse() of a SQL expression, as SQL."""
    sums: dict[str, list[str]] = {"months": [], "days": [], "micros": []}
    for unit, (part, size) in _UNITS.items():
        number = f"regexp_extract({x}, '(?i)([+-]?[0-9]+(?:[.][0-9]+)?) *{unit}s?(?![a-z])', 1)"
        sums[part].append(f"CASE WHEN {number} <> '' THEN CAST(round(CAST({number} AS DECIMAL(28,6)) * {size}, 0) AS BIGINT) ELSE 0L END")
    clock = "([+-]?)([0-9]+):([0-9][0-9]?)(?::([0-9][0-9]?(?:[.][0-9]+)?))?"
    piece = lambda i: f"regexp_extract({x}, '{clock}', {i})"
    seconds = f"CAST(CAST(CASE WHEN {piece(4)} = '' THEN '0' ELSE {piece(4)} END AS DECIMAL(18,6)) * 1000000 AS BIGINT)"
    sign = f"CASE WHEN {piece(1)} = '-' THEN -1L ELSE 1L END"
    sums["micros"].append(f"CASE WHEN {x} RLIKE '{clock}' THEN {sign} * (CAST({piece(2)} AS BIGINT) * 3600000000L + CAST({piece(3)} AS BIGINT) * 60000000L + {seconds}) ELSE 0L END")
    made = f"named_struct('months', CAST({' + '.join(sums['months'])} AS INT), 'days', CAST({' + '.join(sums['days'])} AS INT), 'micros', {' + '.join(sums['micros'])})"
    fine = f"{x} RLIKE '(?i)^ *(?:(?:[+-]?[0-9]+(?:[.][0-9]+)? *(?:{'|'.join(_UNITS)})s?|{clock}) *)+$'"
    kind = "STRUCT<months:INT,days:INT,micros:BIGINT>"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {fine} THEN CAST({made} AS {kind}) ELSE CAST(raise_error(concat('invalid interval: ', {x}, ' (SQLSTATE 22007)')) AS {kind}) END"
