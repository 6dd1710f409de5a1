"""COPY in text and CSV format, by Spark's reader and writer."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.types import DialectError, NotSupported, spark_type


@dataclass(frozen=True)
class CopyOptions:
    format: str = "text"
    delimiter: str | None = None
    null: str | None = None
    header: bool = False
    quote: str = '"'
    escape: str | None = None

    def __post_init__(self) -> None:
        if self.format not in ("text", "csv"):
            raise NotSupported(f"COPY format {self.format}")

    @property
    def separator(self) -> str:
        return self.delimiter or ("," if self.format == "csv" else "\t")

    @property
    def null_text(self) -> str:
        return self.null if self.null is not None else ("" if self.format == "csv" else "\\N")


#: The escapes of the text format.
_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v"))
#: While a row is cut into cells this stands before a digit: 0 for itself, 1 for a backslash, 2 for an escaped delimiter.
_ASIDE = "\x01"


def _escaped(x: Column, separator: str) -> Column:
    for plain, shown in _ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(shown))
    return x if separator in [plain for plain, _ in _ESCAPES] else F.replace(x, F.lit(separator), F.lit("\\" + separator))


def _asides(separator: str) -> tuple[tuple[str, str], ...]:
    return ((_ASIDE, _ASIDE + "0"), ("\\\\", _ASIDE + "1"), ("\\" + separator, _ASIDE + "2"))


def _cells(row: Column, separator: str) -> Column:
    """A row's cells, with what is escaped set aside, so that no delimiter in a value counts."""
    for plain, aside in _asides(separator):
        row = F.replace(row, F.lit(plain), F.lit(aside))
    return F.split(row, f"\\Q{separator}\\E", -1)


def _unescaped(x: Column, separator: str) -> Column:
    for plain, shown in _ESCAPES[1:]:
        x = F.replace(x, F.lit(shown), F.lit(plain))
    x = F.replace(x, F.lit("\\"), F.lit(""))  # before any other character it stands for nothing
    x = F.replace(F.replace(x, F.lit(_ASIDE + "2"), F.lit(separator)), F.lit(_ASIDE + "1"), F.lit("\\"))
    return F.replace(x, F.lit(_ASIDE + "0"), F.lit(_ASIDE))


_BOOLEANS = {True: ("t", "true", "y", "yes", "on", "1"), False: ("f", "false", "n", "no", "off", "0")}


def _bad(state: str, what: str, x: Column, kind: T.DataType) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), x, F.lit(f" (SQLSTATE {state})"))).cast(kind)


#: An array's text: a quoted element, and a run that quoted ones may interrupt.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ELEMENT = rf'(?s)\s*({_QUOTED}|[^,"]*)\s*,'
_NESTED = rf'(?s)\s*(\{{[^{{}}"]*+(?:{_QUOTED}[^{{}}"]*+)*+\}})\s*,'


def _array(x: Column, kind: T.ArrayType) -> Column:
    """An array from its text: {a,"b, c",NULL}; of arrays: {{1,2},{3,4}}."""
    nested = isinstance(kind.elementType, T.ArrayType)
    if nested and isinstance(kind.elementType.elementType, T.ArrayType):
        raise NotSupported("COPY of arrays of three dimensions")
    text = F.trim(x)
    body = F.substring(text, F.lit(2), F.length(text) - 2)
    listed = F.concat(body, F.lit(","))
    parts = F.regexp_extract_all(listed, F.lit(_NESTED if nested else _ELEMENT), F.lit(1))
    # what the pattern left out is no element
    whole = text.startswith("{") & text.endswith("}") & (F.length(text) >= 2) & (F.length(F.regexp_replace(listed, _NESTED if nested else _ELEMENT, "")) == 0)
    if nested:
        made = F.transform(parts, lambda e: _array(e, kind.elementType))
    else:
        plain = lambda e: F.when(e.startswith('"'), F.regexp_replace(F.substring(e, F.lit(2), F.length(e) - 2), r"(?s)\\(.)", "$1")).when(F.upper(F.trim(e)) != "NULL", F.trim(e))
        made = F.transform(parts, lambda e: _scalar(plain(e), kind.elementType))
    return F.when(text == "{}", F.array().cast(kind)).when(whole, made).otherwise(F.when(x.isNotNull(), _bad("22P02", "malformed array", x, kind)))


def _scalar(x: Column, wanted: T.DataType) -> Column:
    if isinstance(wanted, T.StringType):
        return x
    if isinstance(wanted, T.BooleanType):
        low = F.lower(F.trim(x))
        return F.when(x.isNull(), F.lit(None)).when(low.isin(*_BOOLEANS[True]), True).when(low.isin(*_BOOLEANS[False]), False).otherwise(_bad("22P02", "invalid boolean", x, wanted))
    if isinstance(wanted, T.BinaryType):
        return F.unhex(F.regexp_replace(x, r"^\\x", ""))
    made = x.try_cast(wanted)
    return F.when(x.isNotNull() & made.isNull(), _bad("22P02", f"invalid {wanted.simpleString()}", x, wanted)).otherwise(made)


def _typed(x: Column, kind: str) -> Column:
    wanted = spark_type(kind)
    return _array(x, wanted) if isinstance(wanted, T.ArrayType) else _scalar(x, wanted)


def _array_text(x: Column, kind: T.DataType) -> Column:
    """An array as text; elements that could be read as something else are quoted."""
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("{"), F.array_join(F.transform(x, lambda e: F.coalesce(_array_text(e, kind.elementType), F.lit("NULL"))), ","), F.lit("}"))
    if isinstance(kind, T.BooleanType):
        return F.when(x, "t").when(~x, "f")
    plain = F.concat(F.lit("\\x"), F.lower(F.hex(x))) if isinstance(kind, T.BinaryType) else x.cast("string")
    odd = (plain == "") | (F.upper(plain) == "NULL") | plain.rlike(r'[\s,{}"\\]')
    return F.when(odd, F.concat(F.lit('"'), F.regexp_replace(plain, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(plain)


def _shown(df: DataFrame) -> list[Column]:
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "t").when(~c, "f")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.concat(F.lit("\\x"), F.lower(F.hex(c)))
        elif isinstance(f.dataType, T.ArrayType):
            c = _array_text(c, f.dataType)
        out.append(c.cast("string").alias(f.name))
    return out


def copy_to(df: DataFrame, path: str, options: CopyOptions = CopyOptions(), mode: str = "errorifexists") -> None:
    """COPY TO: files of rows in the format, in a folder."""
    shown = _shown(df)
    if options.format == "text":
        cells = [F.coalesce(_escaped(c, options.separator), F.lit(options.null_text)) for c in shown]
        df.select(F.concat_ws(options.separator, *cells).alias("value")).write.mode(mode).text(path)
        return
    writer = df.select(*shown).write.mode(mode).option("sep", options.separator).option("header", options.header).option("quote", options.quote)
    # an empty text is quoted, a NULL isn't
    writer.option("escape", options.escape or options.quote).option("nullValue", options.null_text).option("emptyValue", options.quote * 2).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def copy_from(spark: SparkSession, path: str, columns: dict[str, str], options: CopyOptions = CopyOptions()) -> DataFrame:
    """COPY FROM: rows of the columns (name to dialect type).  A row with another number of cells, or a bad one, is an error."""
    names = list(columns)
    if options.format == "text":
        cells, null_text = _cells(F.col("value"), options.separator), options.null_text
        for plain, aside in _asides(options.separator):
            null_text = null_text.replace(plain, aside)
        wrong = _bad("22P04", "malformed COPY row", F.col("value"), T.ArrayType(T.StringType()))
        rows = spark.read.text(path).filter(F.col("value") != "\\.").select(F.when(F.size(cells) == len(names), cells).otherwise(wrong).alias("c"))
        raw = [F.when(F.get("c", F.lit(i)) != null_text, _unescaped(F.get("c", F.lit(i)), options.separator)) for i in range(len(names))]
        return rows.select(*(_typed(raw[i], k).alias(c) for i, (c, k) in enumerate(columns.items())))
    # what the reader gives for a quoted empty text, so that it isn't taken for the NULL that an empty cell is; no data can hold it
    empty = f"\x01{uuid.uuid4().hex}\x02"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    reader = spark.read.schema(schema).option("sep", options.separator).option("header", options.header).option("quote", options.quote).option("escape", options.escape or options.quote)
    rows = reader.option("nullValue", options.null_text).option("emptyValue", empty).option("mode", "FAILFAST").option("multiLine", True).option("enforceSchema", True).csv(path)
    return rows.select(*(_typed(F.when(F.col(c) == empty, "").otherwise(F.col(c)), k).alias(c) for c, k in columns.items()))


def check_copy(kind: str) -> None:
    """Forms of COPY that the dialect refuses."""
    if kind in ("query", "file", "binary"):
        raise DialectError("0A000", f"COPY of a {kind} is not supported")
