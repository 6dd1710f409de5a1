"""The dialect's SQL, bound to types and told to Spark.

:func:`Dialect.run` parses a statement, resolves its names and types, and gives Spark SQL text in which every rule of the dialect
is explicit: integer division, NULL order, rounding, subscripts, DISTINCT ON and so on.  Planning and running are Spark's.
Statements that change tables go to :mod:`corvane.operators.dml`.

Literals take on the type of what they meet; other operands of different families are an error (42804).
"""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import intervals
from corvane.functions import scalar as S
from corvane.functions.types import DialectError, NotSupported, TypeMismatch, family, spark_type

from .grammar import Node, Query, Select, Statement, Values, parse

_NUMBERS = ("integer", "double", "real", "numeric")
_TIMES = ("date", "time", "timestamp", "timestamptz", "interval", "uuid", "bytea")
_TYPES = {"integer": "BIGINT", "double": "DOUBLE", "real": "FLOAT", "numeric": "DECIMAL(28,10)", "text": "STRING", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "time": "TIME(6)", "bytea": "BINARY", "interval": "STRUCT<months:INT,days:INT,micros:BIGINT>"}
_AGGREGATES = frozenset("count sum avg min max stddev stddev_samp stddev_pop variance var_samp var_pop bool_and bool_or array_agg string_agg".split())


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"


@dataclass
class Relation:
    alias: str
    columns: list[tuple[str, str]]
    sql: str | None = None  # where it can stand in another FROM too


@dataclass
class Scope:
    relations: list[Relation] = field(default_factory=list)
    outer: Scope | None = None
    #: Columns of scopes further out that queries within this one use: relation and column, with the value to be equal to.
    taken: dict[tuple[str, str], tuple[str, str, str]] = field(default_factory=dict)

    def own(self, parts: tuple[str, ...]) -> tuple[Relation, str, str] | None:
        """(relation, column, type) of a name in this scope."""
        name = parts[-1]
        if len(parts) > 1:
            for r in self.relations:
                if r.alias in (parts[-2], ".".join(parts[:-1])):
                    for c, kind in r.columns:
                        if c == name:
                            return r, c, kind
        else:
            hits = [(r, c, kind) for r in self.relations for c, kind in r.columns if c == name]
            if len(hits) > 1:
                raise DialectError("42702", f"column reference {name} is ambiguous")
            if hits:
                return hits[0]
        return None

    def find(self, parts: tuple[str, ...]) -> tuple[str, str]:
        """A name here or one scope out, as it is; one from further out is taken into the scope between.

        Spark resolves names one scope out only.  The scope between joins the distinct values of the column under a name of
        its own, and keeps those that equal the column, so that each scope refers to the next.
        """
        found = self.own(parts)
        if found is None and self.outer:
            found = self.outer.own(parts)
        if found:
            return f"{quoted(found[0].alias)}.{quoted(found[1])}", found[2]
        if self.outer is None or self.outer.outer is None:
            raise DialectError("42703", f"column {'.'.join(parts)} does not exist")
        value, kind = self.outer.find(parts)
        at = self.outer.outer
        while (found := at.own(parts)) is None:
            at = at.outer
        if found[0].sql is None:
            raise NotSupported(f"{'.'.join(parts)} from two queries further out, of what is no table")
        key = (found[0].alias, found[1])
        if key not in self.outer.taken:
            name = f"__out{len(self.outer.taken)}"
            self.outer.taken[key] = (name, f"JOIN (SELECT DISTINCT {quoted(found[1])} AS {quoted(name)} FROM {found[0].sql}) AS {quoted(name)}", value)
        name = self.outer.taken[key][0]
        return f"{quoted(name)}.{quoted(name)}", kind


Typed = tuple[str, str]
Columns = list[tuple[str, str]]


class Binder:
    def __init__(self, database, params: tuple = ()):
        self.database, self.params, self.count = database, params, 0

    def fresh(self) -> str:
        self.count += 1
        return f"__{self.count}"

    # ---- expressions

    def literal(self, kind: str, text: str, wanted: str | None = None) -> Typed:
        if kind == "unknown":
            return (f"CAST(NULL AS {self.type_sql(wanted)})" if wanted else "NULL"), wanted or "unknown"
        if kind == "bool":
            return text.upper(), "boolean"
        if kind == "int":
            if wanted in ("double", "real", "numeric"):
                return f"CAST({text} AS {_TYPES[wanted]})", wanted
            return (f"{text}L" if abs(int(text)) < 2**63 else text), "integer"
        if kind == "double":
            if wanted in ("real", "numeric"):
                return f"CAST('{text}' AS {_TYPES[wanted]})", wanted
            return f"{text}D", "double"
        if wanted in _TIMES:
            return self.cast((text_literal(text), "text"), wanted)
        return text_literal(text), "text"

    def parameter(self, number: int, wanted: str | None) -> Typed:
        if not 1 <= number <= len(self.params):
            raise DialectError("42P02", f"there is no parameter ${number}")
        v = self.params[number - 1]
        match v:
            case None:
                return self.literal("unknown", "NULL", wanted)
            case bool():
                return str(v).upper(), "boolean"
            case int():
                return self.literal("int", str(v), wanted)
            case float():
                return (f"CAST('{v}' AS DOUBLE)", "double") if wanted in (None, "double") else self.literal("double", repr(v), wanted)
            case decimal.Decimal():
                return f"CAST('{v}' AS DECIMAL(28,10))", "numeric"
            case datetime.datetime():
                return self.cast((text_literal(v.isoformat(" ")), "text"), "timestamp" if v.tzinfo is None else "timestamptz")
            case datetime.date():
                return self.cast((text_literal(v.isoformat()), "text"), "date")
            case bytes():
                return f"X'{v.hex()}'", "bytea"
            case list() | tuple():
                items = [Binder(self.database, (x,)).parameter(1, None) for x in v]
                kind = next((k for _, k in items if k != "unknown"), "integer")
                return f"array({', '.join(s for s, _ in items)})", f"{kind}[]"
        return self.literal("text", str(v), wanted)

    @staticmethod
    def type_sql(kind: str) -> str:
        if kind.endswith("[]"):
            return f"ARRAY<{Binder.type_sql(kind[:-2])}>"
        return _TYPES.get(kind, "STRING")

    def same(self, a: Node, b: Node, scope: Scope, what: str) -> tuple[Typed, Typed]:
        """Both, with literals in the other's type."""
        loose = lambda n: n.kind in ("literal", "param")
        if loose(a) and not loose(b):
            y = self.expr(b, scope)
            return self.expr(a, scope, y[1]), self.check(self.expr(a, scope, y[1]), y, what)
        x = self.expr(a, scope)
        y = self.expr(b, scope, x[1] if loose(b) or x[1] == "unknown" else None)
        if x[1] == "unknown" and y[1] != "unknown":
            x = self.expr(a, scope, y[1])
        return x, self.check(x, y, what)

    @staticmethod
    def check(x: Typed, y: Typed, what: str) -> Typed:
        if x[1] != y[1] and "unknown" not in (x[1], y[1]):
            raise TypeMismatch(f"{what} over {x[1]} and {y[1]}")
        return y

    def boolean(self, node: Node, scope: Scope, aggregates: bool = True) -> str:
        sql, kind = self.expr(node, scope, "boolean")
        if kind not in ("boolean", "unknown"):
            raise TypeMismatch(f"a condition of type {kind}")
        return sql

    def condition(self, node: Node, scope: Scope) -> str:
        """A condition that rows must meet: NULL and false are one there, so [NOT] IN is a semi or anti join."""
        if node.kind == "bool" and node[0] == "AND":
            return f"({self.condition(node[1], scope)} AND {self.condition(node[2], scope)})"
        if node.kind == "in_query":
            return self.in_query(node, scope, value=False)[0]
        if node.kind == "not" and node[0].kind == "in_query":
            return self.in_query(Node("in_query", (*node[0].args[:2], not node[0][2])), scope, value=False)[0]
        return self.boolean(node, scope)

    def in_query(self, node: Node, scope: Scope, value: bool) -> Typed:
        """x [NOT] IN (SELECT ...).  As a value it is NULL where x or one of the rows is, and no row equals x; Spark has false there."""
        x = self.expr(node[0], scope)
        sql, columns = self.query(node[1], scope)
        if len(columns) != 1:
            raise DialectError("42601", "a subquery in IN has one column")
        self.check(x, ("", columns[0][1]), "IN")
        if not value:
            return f"({x[0]} {'NOT ' if node[2] else ''}IN ({sql}))", "boolean"
        yes, no = ("false", "true") if node[2] else ("true", "false")
        unknown = f"EXISTS (SELECT 1 FROM ({sql}) AS __among(__x) WHERE __x IS NULL)"
        return f"CASE WHEN {x[0]} IN ({sql}) THEN {yes} WHEN {x[0]} IS NULL THEN CASE WHEN EXISTS ({sql}) THEN CAST(NULL AS BOOLEAN) ELSE {no} END WHEN {unknown} THEN CAST(NULL AS BOOLEAN) ELSE {no} END", "boolean"

    def comparable(self, x: Typed) -> str:
        if x[1] == "interval":
            return f"((CAST({x[0]}.months AS DECIMAL(28,0)) * 30 + {x[0]}.days) * 86400000000 + {x[0]}.micros)"
        return x[0]

    def arithmetic(self, op: str, a: Node, b: Node, scope: Scope) -> Typed:
        if op == "||":
            x, y = self.expr(a, scope, "text"), self.expr(b, scope, "text")
            if {x[1], y[1]} - {"text", "unknown"}:
                raise TypeMismatch(f"|| over {x[1]} and {y[1]}")
            return f"concat({x[0]}, {y[0]})", "text"
        x, y = self.expr(a, scope), self.expr(b, scope)
        kinds = (x[1], y[1])
        if "interval" in kinds:
            return self.interval_arithmetic(op, x, y)
        x, y = self.same(a, b, scope, op)
        kind = x[1] if x[1] != "unknown" else y[1]
        if kind not in _NUMBERS:
            raise TypeMismatch(f"{op} over {x[1]} and {y[1]}")
        if kind == "integer":
            left, right = f"CAST({x[0]} AS BIGINT)", f"CAST({y[0]} AS BIGINT)"
            return f"({left} {'div' if op == '/' else op} {right})", kind
        if op == "%" and kind in ("double", "real"):
            raise TypeMismatch("modulo of floating-point numbers")
        made = f"({x[0]} {op} {y[0]})"
        return (f"CAST({made} AS FLOAT)" if kind == "real" else made), kind

    def interval_arithmetic(self, op: str, x: Typed, y: Typed) -> Typed:
        if op == "+" and x[1] == "interval" and y[1] != "interval":
            x, y = y, x
        part = lambda i, name: f"{i}.{name}"
        if x[1] == y[1] == "interval" and op in "+-":
            fields = ", ".join(f"'{n}', {part(x[0], n)} {op} {part(y[0], n)}" for n in ("months", "days", "micros"))
            return f"CAST(named_struct({fields}) AS {_TYPES['interval']})", "interval"
        if op == "*" and "integer" in (x[1], y[1]):
            i, n = (x[0], y[0]) if x[1] == "interval" else (y[0], x[0])
            fields = ", ".join(f"'{f}', {part(i, f)} * {n}" for f in ("months", "days", "micros"))
            return f"CAST(named_struct({fields}) AS {_TYPES['interval']})", "interval"
        if op in "+-" and x[1] in ("date", "timestamp", "timestamptz"):
            moment = f"CAST({x[0]} AS TIMESTAMP_NTZ)" if x[1] == "date" else x[0]
            seconds = f"CAST(CAST({y[0]}.micros AS DECIMAL(24,0)) / CAST(1000000 AS DECIMAL(8,0)) AS DECIMAL(18,6))"
            return f"({moment} {op} make_ym_interval(0, {y[0]}.months) {op} make_dt_interval({y[0]}.days, 0, 0, {seconds}))", "timestamptz" if x[1] == "timestamptz" else "timestamp"
        if op in "+-" and x[1] == "time":
            # around the clock
            micros = f"(extract(hour FROM {x[0]}) * 3600000000L + extract(minute FROM {x[0]}) * 60000000L + CAST(extract(second FROM {x[0]}) * 1000000 AS BIGINT))"
            micros = f"pmod({micros} {op} {y[0]}.micros, 86400000000L)"
            seconds = f"CAST(CAST({micros} % 60000000L AS DECIMAL(18,0)) / CAST(1000000 AS DECIMAL(8,0)) AS DECIMAL(16,6))"
            return f"make_time(CAST({micros} div 3600000000L AS INT), CAST({micros} div 60000000L % 60 AS INT), {seconds})", "time"
        raise TypeMismatch(f"{op} over {x[1]} and {y[1]}")

    def cast(self, x: Typed, target: str) -> Typed:
        sql, source = x
        wanted = spark_type(target)
        kind = family(wanted)
        if source == "unknown":
            return f"CAST({sql} AS {wanted.simpleString()})", kind
        if source == kind == "interval" or (source == kind == "text"):
            return sql, kind
        if kind == "integer" and source in ("double", "real"):
            made = f"CAST(rint(CAST({sql} AS DOUBLE)) AS BIGINT)"
        elif kind == "integer" and source == "numeric":
            made = f"CAST(round({sql}, 0) AS BIGINT)"
        elif kind == "text":
            if source == "interval":
                return f"get(transform(array({sql}), __i -> {intervals.to_text_sql('__i')}), 0)", "text"
            made = {"boolean": f"CASE WHEN {sql} THEN 'true' WHEN NOT {sql} THEN 'false' END", "bytea": f"concat('\\\\x', lower(hex({sql})))"}.get(source, f"CAST({sql} AS STRING)")
        elif source == "text" and kind == "boolean":
            low = f"lower(trim({sql}))"
            made = f"CASE WHEN {sql} IS NULL THEN NULL WHEN {low} IN ('true', 't', '1') THEN true WHEN {low} IN ('false', 'f', '0') THEN false ELSE CAST(raise_error(concat('invalid boolean: ', {sql})) AS BOOLEAN) END"
        elif source == "text" and kind == "bytea":
            made = f"unhex(regexp_replace({sql}, '^[\\\\\\\\]x', ''))"
        elif source == "text" and kind == "interval":
            return self.interval_literal(sql), kind
        elif source == "text" or source == kind or (source in _NUMBERS and kind in _NUMBERS and {source, kind} != {"real", "numeric"}) or {source, kind} == {"timestamp", "timestamptz"}:
            made = f"CAST({sql} AS {wanted.simpleString()})"
        elif source.endswith("[]") and kind.endswith("[]"):
            inner = self.cast(("e", source[:-2]), target.strip()[:-2])[0]
            made = f"transform({sql}, e -> {inner})"
        else:
            raise NotSupported(f"cast from {source} to {kind}")
        base = target.lower().split("(")[0].strip()
        low, high = {"smallint": (-(2**15), 2**15 - 1), "int2": (-(2**15), 2**15 - 1), "integer": (-(2**31), 2**31 - 1), "int": (-(2**31), 2**31 - 1), "int4": (-(2**31), 2**31 - 1)}.get(base, (None, None))
        if kind == "integer" and low is not None:
            made = f"CASE WHEN {made} NOT BETWEEN {low}L AND {high}L THEN CAST(raise_error('integer out of range') AS BIGINT) ELSE {made} END"
        return made, kind

    def interval_literal(self, sql: str) -> str:
        """An interval from a text literal: parsed once, here."""
        if not sql.startswith("'"):
            return f"get(transform(array({sql}), __t -> {intervals.parse_sql('__t')}), 0)"
        spark = self.database.spark
        row = spark.range(1).select(intervals.parse(F.expr(sql)).alias("i")).first().i
        return f"CAST(named_struct('months', {row.months}, 'days', {row.days}, 'micros', {row.micros}L) AS {_TYPES['interval']})"

    def expr(self, node: Node, scope: Scope, wanted: str | None = None) -> Typed:
        match node.kind:
            case "literal":
                return self.literal(node[0], node[1], wanted)
            case "param":
                return self.parameter(node[0], wanted)
            case "column":
                return scope.find(node.args)
            case "bool":
                return f"({self.boolean(node[1], scope)} {node[0]} {self.boolean(node[2], scope)})", "boolean"
            case "not":
                return f"(NOT {self.boolean(node[0], scope)})", "boolean"
            case "op":
                return self.arithmetic(node[0], node[1], node[2], scope)
            case "negate":
                x = self.expr(node[0], scope, wanted)
                if x[1] == "interval":
                    return self.interval_arithmetic("*", x, ("-1", "integer"))
                if x[1] not in (*_NUMBERS, "unknown"):
                    raise TypeMismatch(f"- over {x[1]}")
                return f"(- {x[0]})", x[1]
            case "compare":
                x, y = self.same(node[1], node[2], scope, node[0])
                return f"({self.comparable(x)} {node[0]} {self.comparable(y)})", "boolean"
            case "distinct":
                x, y = self.same(node[0], node[1], scope, "IS DISTINCT FROM")
                same = f"({self.comparable(x)} <=> {self.comparable(y)})"
                return same if node[2] else f"(NOT {same})", "boolean"
            case "null":
                return f"({self.expr(node[0], scope)[0]} IS {'NOT ' if node[1] else ''}NULL)", "boolean"
            case "any":
                array = self.expr(node[2], scope)
                x = self.expr(node[0], scope, array[1][:-2])
                if not array[1].endswith("[]"):
                    raise TypeMismatch("ANY needs an array")
                self.check(x, ("", array[1][:-2]), "ANY")
                return f"exists({array[0]}, __e -> {x[0]} {node[1]} __e)", "boolean"
            case "between":
                low, high = (Node("compare", (op, node[0], node[i])) for op, i in ((">=", 1), ("<=", 2)))
                made = f"({self.expr(low, scope)[0]} AND {self.expr(high, scope)[0]})"
                return (f"(NOT {made})" if node[3] else made), "boolean"
            case "in":
                x = self.expr(node[0], scope)
                items = [self.check(x, self.expr(i, scope, x[1]), "IN")[0] for i in node[1]]
                return f"({x[0]} {'NOT ' if node[2] else ''}IN ({', '.join(items)}))", "boolean"
            case "in_query":
                return self.in_query(node, scope, value=True)
            case "exists":
                return f"EXISTS ({self.query(node[0], scope)[0]})", "boolean"
            case "scalar":
                sql, columns = self.query(node[0], scope)
                if len(columns) != 1:
                    raise DialectError("42601", "a scalar subquery has one column")
                return f"({sql})", columns[0][1]
            case "like":
                return self.like(node, scope)
            case "case":
                return self.case(node, scope, wanted)
            case "cast":
                return self.cast(self.expr(node[0], scope, family(spark_type(node[1])) if node[0].kind == "literal" and node[0][0] == "unknown" else None), node[1])
            case "array":
                return self.array(node, scope, wanted)
            case "subscript":
                x, i = self.expr(node[0], scope), self.expr(node[1], scope)
                if not x[1].endswith("[]") and not x[1].startswith("nested "):
                    raise TypeMismatch(f"subscript of {x[1]}")
                inner = x[1][7:] if x[1].startswith("nested ") else x[1][:-2]
                return f"get({x[0]}, CAST({i[0]} AS INT) - 1)", inner
            case "extract":
                x = self.expr(node[1], scope)
                if node[0] not in ("year", "month", "day", "hour", "minute", "second") or x[1] not in ("date", "timestamp"):
                    raise NotSupported(f"extract({node[0]} from {x[1]})")
                return f"CAST(extract({node[0]} FROM {x[0]}) AS DOUBLE)", "double"
            case "call":
                return self.call(node, scope, wanted)
        raise NotSupported(node.kind)

    def like(self, node: Node, scope: Scope) -> Typed:
        x, pattern = self.expr(node[0], scope), node[1]
        if pattern.kind == "param":
            pattern = Node("literal", ("text", str(self.params[pattern[0] - 1])))
        if pattern.kind != "literal" or pattern[0] != "text":
            made = f"({x[0]} {'ILIKE' if node[3] else 'LIKE'} {self.expr(pattern, scope)[0]})"
        else:
            own = S.like_pattern(pattern[1], node[2])
            made = f"(lower({x[0]}) LIKE {text_literal(own.lower())})" if node[3] else f"({x[0]} LIKE {text_literal(own)})"
        return (f"(NOT {made})" if node[4] else made), "boolean"

    def case(self, node: Node, scope: Scope, wanted: str | None) -> Typed:
        of, arms, other = node.args
        results = [a for _, a in arms] + ([other] if other else [])
        kind = next((k for r in results if r.kind not in ("literal", "param") for k in [self.expr(r, scope)[1]] if k != "unknown"), None)
        kind = kind or next((k for r in results for k in [self.expr(r, scope)[1]] if k != "unknown"), wanted or "text")
        made = [self.expr(r, scope, kind) for r in results]
        for m in made:
            self.check((None, kind), m, "CASE")
        tests = [self.expr(Node("compare", ("=", of, t)), scope)[0] if of else self.boolean(t, scope) for t, _ in arms]
        body = " ".join(f"WHEN {t} THEN {m[0]}" for t, m in zip(tests, made, strict=False))
        return f"CASE {body}{f' ELSE {made[-1][0]}' if other else ''} END", kind

    def array(self, node: Node, scope: Scope, wanted: str | None) -> Typed:
        if not node.args:
            if not wanted or not wanted.endswith("[]"):
                raise TypeMismatch("an empty ARRAY needs a type")
            return f"CAST(array() AS {self.type_sql(wanted)})", wanted
        kind = next((k for i in node.args for k in [self.expr(i, scope)[1]] if k != "unknown"), "text")
        items = [self.check((None, kind), self.expr(i, scope, kind), "ARRAY")[0] for i in node.args]
        return f"array({', '.join(items)})", f"nested {kind}" if kind.endswith("[]") or kind.startswith("nested ") else f"{kind}[]"

    # ---- functions

    def call(self, node: Node, scope: Scope, wanted: str | None) -> Typed:
        name, args, distinct = node.args
        if name in _AGGREGATES:
            return self.aggregate(name, args, distinct, scope)
        if name in ("coalesce", "nullif"):
            kind = next((k for a in args if a.kind not in ("literal", "param") for k in [self.expr(a, scope)[1]] if k != "unknown"), None)
            made = [self.expr(a, scope, kind) for a in args]
            kind = kind or next((k for _, k in made if k != "unknown"), wanted or "text")
            for m in made:
                self.check((None, kind), m, name)
            return (f"coalesce({', '.join(m[0] for m in made)})", kind) if name == "coalesce" else (f"CASE WHEN {made[0][0]} = {made[1][0]} THEN NULL ELSE {made[0][0]} END", kind)
        if name in ("now", "current_timestamp"):
            return "current_timestamp()", "timestamptz"
        if name in ("nextval", "currval", "setval"):
            values = [a[1] if a.kind == "literal" else str(a) for a in args]
            return f"{self.database.call(name, *(int(v) if v.lstrip('-').isdigit() else v == 'true' if v in ('true', 'false') else v for v in values))}L", "integer"
        made = [self.expr(a, scope) for a in args]
        sql = [m[0] for m in made]
        kinds = [m[1] for m in made]

        def takes(*allowed: str) -> None:
            if len(kinds) != len(allowed) or any(k not in a.split("|") and k != "unknown" for k, a in zip(kinds, allowed, strict=True)):
                raise DialectError("42883", f"function {name}({', '.join(kinds)}) does not exist")

        match name:
            case "upper" | "lower":
                takes("text")
                return f"{name}({sql[0]})", "text"
            case "trim":
                takes("text")
                return f"regexp_replace({sql[0]}, '(?U)^\\\\s+|\\\\s+$', '')", "text"
            case "length":
                takes("text")
                return f"CAST(char_length({sql[0]}) AS BIGINT)", "integer"
            case "abs":
                takes("integer|double")
                return f"abs({sql[0]})", kinds[0]
            case "floor" | "ceil" | "ceiling":
                takes("integer|double")
                inner = "floor" if name == "floor" else "ceil"
                whole = f"CASE WHEN isnan({sql[0]}) OR abs({sql[0]}) >= 4503599627370496D THEN {sql[0]} ELSE CAST({inner}({sql[0]}) AS DOUBLE) END"
                return (sql[0] if kinds[0] == "integer" else whole), kinds[0]
            case "round":
                takes("integer|double")
                return (sql[0] if kinds[0] == "integer" else f"rint({sql[0]})"), kinds[0]
            case "sqrt":
                takes("integer|double")
                return f"CASE WHEN {sql[0]} < 0 THEN CAST(raise_error('cannot take square root of a negative number') AS DOUBLE) ELSE sqrt(CAST({sql[0]} AS DOUBLE)) END", "double"
            case "power" | "pow":
                takes("integer|double", "integer|double")
                made = f"power(CAST({sql[0]} AS DOUBLE), CAST({sql[1]} AS DOUBLE))"
                return f"CASE WHEN isnan({made}) OR abs({made}) = double('Infinity') THEN CAST(raise_error('value out of range: overflow') AS DOUBLE) ELSE {made} END", "double"
            case "mod":
                takes("integer", "integer")
                return f"(CAST({sql[0]} AS BIGINT) % CAST({sql[1]} AS BIGINT))", "integer"
            case "replace":
                takes("text", "text", "text")
                return f"replace({', '.join(sql)})", "text"
            case "position":
                takes("text", "text")
                return f"CAST(position({sql[0]}, {sql[1]}) AS BIGINT)", "integer"
            case "left":
                takes("text", "integer")
                return f"substr({sql[0]}, 1, CAST(CASE WHEN {sql[1]} >= 0 THEN {sql[1]} ELSE greatest(char_length({sql[0]}) + {sql[1]}, 0) END AS INT))", "text"
            case "right":
                takes("text", "integer")
                size = f"char_length({sql[0]})"
                return f"substr({sql[0]}, CAST(1 + CASE WHEN {sql[1]} >= 0 THEN greatest({size} - {sql[1]}, 0) ELSE least(- {sql[1]}, {size}) END AS INT))", "text"
            case "substring" | "substr":
                takes("text", *["integer"] * (len(kinds) - 1))
                start = f"CAST(greatest({sql[1]}, 1) AS INT)"
                if len(sql) == 2:
                    return f"substr({sql[0]}, {start})", "text"
                size = f"CAST(greatest(least({sql[1]} + {sql[2]}, 2147483647) - greatest({sql[1]}, 1), 0) AS INT)"
                return f"CASE WHEN {sql[2]} < 0 THEN CAST(raise_error('negative substring length not allowed') AS STRING) ELSE substr({sql[0]}, {start}, {size}) END", "text"
            case "concat":
                if set(kinds) - {"text", "unknown"}:
                    raise DialectError("42883", f"function concat({', '.join(kinds)}) does not exist")
                return f"concat_ws('', {', '.join(sql)})", "text"
        if args and args[0].kind != "literal" and (known := self.database.by_oid(name, self.params_of(args[1:]))) is not None:
            arms = " ".join(f"WHEN {oid}L THEN {text_literal(value)}" for oid, value in known.items())
            return (f"CASE CAST({sql[0]} AS BIGINT) {arms} END" if arms else "CAST(NULL AS STRING)"), "text"
        values = [a[1] if a.kind == "literal" else f"-{a[0][1]}" if a.kind == "negate" and a[0].kind == "literal" else None for a in args]
        return self.parameter_of(self.database.call(name, *values))

    @staticmethod
    def params_of(args: list[Node]) -> list[str]:
        return [a[1] for a in args if a.kind == "literal"]

    def parameter_of(self, value: object) -> Typed:
        return Binder(self.database, (value,)).parameter(1, "text" if value is None else None)

    def aggregate(self, name: str, args: list[Node], distinct: bool, scope: Scope) -> Typed:
        some = "DISTINCT " if distinct else ""
        if name == "count":
            return ("count(1)" if args[0].kind == "star" else f"count({some}{self.expr(args[0], scope)[0]})"), "integer"
        x, kind = self.expr(args[0], scope)
        if name in ("sum", "avg"):
            if kind not in _NUMBERS:
                raise DialectError("42883", f"function {name}({kind}) does not exist")
            if kind == "integer":
                total = f"sum({some}CAST({x} AS BIGINT))"
                return (total if name == "sum" else f"CASE WHEN count({x}) > 0 THEN {total} div count({some}{x}) END"), "integer"
            made = f"{name}({some}{x})"
            return (f"CAST({made} AS FLOAT)" if kind == "real" else made), kind
        if name in ("min", "max"):
            return f"{name}({x})", kind
        if name in ("bool_and", "bool_or"):
            return f"{name}({x})", "boolean"
        if name == "array_agg":
            rows = f"collect_list(named_struct('x', {x}))"
            made = f"transform({rows}, __r -> __r.x)"
            return f"CASE WHEN count(1) > 0 THEN {f'array_distinct({made})' if distinct else made} END", f"{kind}[]"
        if name == "string_agg":
            rows = f"collect_list(CASE WHEN {x} IS NOT NULL THEN named_struct('x', {x}, 'd', {self.expr(args[1], scope, 'text')[0]}) END)"
            rows = f"array_distinct({rows})" if distinct else rows
            return f"aggregate({rows}, CAST(NULL AS STRING), (__a, __r) -> CASE WHEN __a IS NULL THEN __r.x ELSE concat(__a, coalesce(__r.d, ''), __r.x) END)", "text"
        spark_name = {"stddev": "stddev_samp", "variance": "var_samp"}.get(name, name)
        if kind not in _NUMBERS:
            raise DialectError("42883", f"function {name}({kind}) does not exist")
        return f"{spark_name}({some}CAST({x} AS DOUBLE))", "double"

    # ---- relations

    def base(self, name: str) -> tuple[str, Columns]:
        key = self.database._key(name)
        system = name.removeprefix("pg_catalog.")
        if key not in self.database.tables and key not in self.database.views and system.startswith(("pg_", "information_schema.")):
            df = self.database.system(system)
            view = "corvane_system_" + system.replace(".", "_")
        else:
            df = self.database.read(name)
            view = "corvane_" + "_".join(key)
        df.createOrReplaceTempView(view)
        return quoted(view), [(f.name, family(f.dataType)) for f in df.schema]

    def source(self, node: Node, scope: Scope, ctes: dict[str, Columns]) -> str:
        """SQL of a FROM item; its relations join scope."""
        match node.kind:
            case "table":
                name, alias, names = node.args
                if name in ctes:
                    sql, columns = quoted(name), ctes[name]
                else:
                    sql, columns = self.base(name)
                alias = alias or name.split(".")[-1]
                if names:
                    columns = [(n, k) for n, (_, k) in zip(names + [c for c, _ in columns[len(names) :]], columns, strict=True)]
                    sql = f"(SELECT * FROM {sql})"
                scope.relations.append(Relation(alias, columns, None if name in ctes else f"{sql} AS {quoted(alias)}" + (f"({', '.join(quoted(c) for c, _ in columns)})" if names else "")))
                return f"{sql} AS {quoted(alias)}" + (f"({', '.join(quoted(c) for c, _ in columns)})" if names else "")
            case "derived":
                query, alias, names, lateral = node.args
                sql, columns = self.query(query, scope if lateral else scope.outer, ctes)
                if names:
                    columns = [(n, k) for n, (_, k) in zip(names, columns, strict=True)]
                scope.relations.append(Relation(alias, columns))
                return f"{'LATERAL ' if lateral else ''}({sql}) AS {quoted(alias)}({', '.join(quoted(c) for c, _ in columns)})"
            case "call":
                name, args, alias, names = node.args
                made = [self.expr(a, scope) for a in args]
                column = (names or [alias])[0]
                if name == "unnest":
                    rows, kind = made[0][0], made[0][1]
                    while kind.startswith("nested "):
                        rows, kind = f"flatten({rows})", kind[7:]
                    kind = kind[:-2]
                elif name == "generate_series":
                    if any(k not in ("integer", "unknown") for _, k in made):
                        raise DialectError("42883", "generate_series takes integers")
                    a, b, step = (f"CAST({m[0]} AS BIGINT)" for m in (*made, ("1L", "integer"))[:3])
                    rows = f"coalesce(CASE WHEN {step} = 0 THEN CAST(raise_error('step size cannot equal zero') AS ARRAY<BIGINT>) WHEN ({b} >= {a} AND {step} > 0) OR ({b} <= {a} AND {step} < 0) THEN sequence({a}, {b}, {step}) END, CAST(array() AS ARRAY<BIGINT>))"
                    kind = "integer"
                else:
                    raise DialectError("42883", f"table function {name} does not exist")
                correlated = bool(scope.relations)
                scope.relations.append(Relation(alias, [(column, kind)]))
                return f"{'LATERAL ' if correlated else ''}(SELECT explode({rows})) AS {quoted(alias)}({quoted(column)})"
        kind, left, right, on = node.args
        a = self.source(left, scope, ctes)
        b = self.source(right, scope, ctes)
        if kind == "cross":
            return f"{a} CROSS JOIN {b}" if not b.startswith("LATERAL") else f"{a} JOIN {b}"
        if any(_queries(on)):
            raise NotSupported("a subquery in ON")
        return f"{a} {kind.upper()} JOIN {b} ON {self.boolean(on, scope)}"

    # ---- queries

    def query(self, query: Query, outer: Scope | None = None, ctes: dict[str, Columns] | None = None) -> tuple[str, Columns]:
        ctes = dict(ctes or getattr(self, "_ctes", {}))
        before = getattr(self, "_ctes", {})
        head = []
        for name, names, inner in query.ctes:
            sql, columns = self.query(inner, None, ctes)
            if names:
                columns = [(n, k) for n, (_, k) in zip(names, columns, strict=True)]
            ctes[name] = columns
            head.append(f"{quoted(name)}({', '.join(quoted(c) for c, _ in columns)}) AS ({sql})")
        self._ctes = ctes
        try:
            sql, columns = self.select(query.body, outer, ctes, query.order) if isinstance(query.body, Select) else self.other(query, outer, ctes)
        finally:
            self._ctes = before
        if query.limit is not None:
            sql += f" LIMIT {query.limit}"
        if query.offset:
            sql += f" OFFSET {query.offset}"
        return (f"WITH {', '.join(head)} " if head else "") + sql, columns

    def direction(self, down: bool, nulls: str | None) -> str:
        return f"{'DESC' if down else 'ASC'} NULLS {(nulls or ('first' if down else 'last')).upper()}"

    def other(self, query: Query, outer: Scope | None, ctes: dict[str, Columns]) -> tuple[str, Columns]:
        sql, columns = self.body(query.body, outer, ctes)
        if query.order:
            names = [c for c, _ in columns]
            keys = []
            for x, down, nulls in query.order:
                if x.kind == "literal" and x[0] == "int":
                    name = names[self.place(x, len(names))]
                elif x.kind == "column" and len(x.args) == 1 and x[0] in names:
                    name = x[0]
                else:
                    raise NotSupported("ORDER BY of a set operation other than an output column")
                keys.append(f"{quoted(name)} {self.direction(down, nulls)}")
            sql = f"SELECT * FROM ({sql}) ORDER BY {', '.join(keys)}"
        return sql, columns

    @staticmethod
    def place(x: Node, n: int) -> int:
        if not 1 <= int(x[1]) <= n:
            raise DialectError("42P10", f"ORDER BY position {x[1]} is not in select list")
        return int(x[1]) - 1

    def body(self, body, outer: Scope | None, ctes: dict[str, Columns]) -> tuple[str, Columns]:
        if isinstance(body, Query):
            return self.query(body, outer, ctes)
        if isinstance(body, Select):
            return self.select(body, outer, ctes, [])
        if isinstance(body, Values):
            width = len(body.rows[0])
            kinds = [next((k for r in body.rows for k in [self.expr(r[i], Scope())[1]] if k != "unknown"), "text") for i in range(width)]
            rows = [f"({', '.join(self.check((None, k), self.expr(x, Scope(), k), 'VALUES')[0] for x, k in zip(r, kinds, strict=True))})" for r in body.rows]
            columns = [(f"column{i + 1}", k) for i, k in enumerate(kinds)]
            return f"SELECT * FROM VALUES {', '.join(rows)} AS __v({', '.join(c for c, _ in columns)})", columns
        left, a = self.body(body.left, outer, ctes)
        right, b = self.body(body.right, outer, ctes)
        if len(a) != len(b):
            raise DialectError("42601", "each set operand must have the same number of columns")
        kinds = []
        for (_, x), (_, y) in zip(a, b, strict=True):
            self.check((None, x), (None, y), body.op.upper())
            kinds.append(y if x == "unknown" else x)
        wrap = lambda sql: f"SELECT * FROM ({sql})"
        return f"{wrap(left)} {body.op.upper()}{' ALL' if body.every else ''} {wrap(right)}", [(n, k) for (n, _), k in zip(a, kinds, strict=True)]

    def named(self, x: Node) -> str:
        return {"column": lambda: x.args[-1], "call": lambda: x[0], "cast": lambda: self.named(x[0]), "subscript": lambda: self.named(x[0]), "case": lambda: "case", "extract": lambda: "extract", "array": lambda: "array", "exists": lambda: "exists"}.get(x.kind, lambda: "?column?")()

    def items(self, select: Select, scope: Scope) -> list[tuple[str, str, str]]:
        """(sql, name, type) of each output column, names made unlike."""
        out = []
        for x, alias in select.items:
            if x.kind == "star":
                for r in scope.relations:
                    if x[0] in (None, r.alias):
                        out += [(f"{quoted(r.alias)}.{quoted(c)}", c, k) for c, k in r.columns]
            else:
                sql, kind = self.expr(x, scope)
                out.append((sql, alias or self.named(x), kind))
        seen: dict[str, int] = {}
        named = []
        for sql, name, kind in out:
            seen[name] = seen.get(name, 0) + 1
            named.append((sql, name if seen[name] == 1 else f"{name}_{seen[name]}", kind))
        return named

    def select(self, select: Select, outer: Scope | None, ctes: dict[str, Columns], order: list) -> tuple[str, Columns]:
        scope = Scope(outer=outer)
        source = f" FROM {self.source(select.source, scope, ctes)}" if select.source else ""
        where = [self.condition(select.where, scope)] if select.where else []
        items = self.items(select, scope)
        if select.group:
            keys = [self.expr(g, scope)[0] for g in select.group]
            tail = f" GROUP BY {', '.join(f'CAST({k} AS BIGINT)' if k.rstrip('L').lstrip('-').isdigit() else k for k in keys)}"
        else:
            tail = ""
        if select.having:
            tail += f" HAVING {self.condition(select.having, scope)}"
        if any(x for k, _, _ in order for x in _queries(k)):
            raise NotSupported("a subquery in ORDER BY")
        if scope.taken:
            if tail or any(_aggregates(x) for x, _ in select.items):
                raise NotSupported("columns of a query two further out below a query that aggregates")
            source = (f"{source} " if source else " FROM (SELECT 1) AS __one ") + " ".join(join for _, join, _ in scope.taken.values())
            where += [f"{quoted(name)}.{quoted(name)} <=> {value}" for name, _, value in scope.taken.values()]
        tail = source + (f" WHERE {' AND '.join(where)}" if where else "") + tail
        names = [n for _, n, _ in items]
        keys: list[tuple[str, str]] = []  # (expression, direction)
        for x, down, nulls in order:
            if x.kind == "literal" and x[0] == "int":
                key = items[self.place(x, len(items))][0]
            elif x.kind == "column" and len(x.args) == 1 and x[0] in names:
                key = items[names.index(x[0])][0]
            else:
                key, kind = self.expr(x, scope)
                key = self.comparable((key, kind))
                if select.distinct and key not in [s for s, _, _ in items]:
                    raise DialectError("42P10", "for SELECT DISTINCT, ORDER BY expressions must appear in select list")
            keys.append((key, self.direction(down, nulls)))
        columns = [(n, k) for _, n, k in items]
        shown = ", ".join(f"{s} AS {quoted(n)}" for s, n, _ in items)
        if select.distinct_on:
            on = [self.expr(x, scope)[0] for x in select.distinct_on]
            if {k for k, _ in keys[: len(set(on))]} - set(on):
                raise DialectError("42P10", "SELECT DISTINCT ON expressions must match initial ORDER BY expressions")
            hidden = ", ".join(f"{k} AS __k{i}" for i, (k, _) in enumerate(keys))
            within = ", ".join(f"{k} {d}" for k, d in keys) or ", ".join(on)
            inner = f"SELECT {shown}{', ' + hidden if hidden else ''}, row_number() OVER (PARTITION BY {', '.join(on)} ORDER BY {within}) AS __first{tail}"
            by = ", ".join(f"__k{i} {d}" for i, (_, d) in enumerate(keys))
            return f"SELECT {', '.join(map(quoted, names))} FROM ({inner}) WHERE __first = 1" + (f" ORDER BY {by}" if by else ""), columns
        if not keys:
            return f"SELECT {'DISTINCT ' if select.distinct else ''}{shown}{tail}", columns
        of_output = {s: quoted(n) for s, n, _ in items}
        if select.distinct:
            by = ", ".join(f"{of_output[k]} {d}" for k, d in keys)
            return f"SELECT * FROM (SELECT DISTINCT {shown}{tail}) ORDER BY {by}", columns
        # keys travel beside the output, so that an alias never hides an input column
        hidden = ", ".join(f"{k} AS __k{i}" for i, (k, _) in enumerate(keys) if k not in of_output)
        by = ", ".join(f"{of_output.get(k, f'__k{i}')} {d}" for i, (k, d) in enumerate(keys))
        return f"SELECT {', '.join(map(quoted, names))} FROM (SELECT {shown}{', ' + hidden if hidden else ''}{tail}) ORDER BY {by}", columns


class Dialect:
    """Statements in the dialect's SQL, over a database."""

    def __init__(self, database):
        self.database = database

    def translate(self, sql: str, *params: object) -> str:
        """The Spark SQL of a query."""
        statement = parse(sql)
        if statement.kind != "query":
            raise NotSupported("only queries have a translation")
        return Binder(self.database, params).query(statement.parts["query"])[0]

    def run(self, sql: str, *params: object) -> DataFrame | None:
        """A query's rows, RETURNING's rows, or None."""
        statement = parse(sql)
        return getattr(self, f"_{statement.kind}")(statement.parts, Binder(self.database, params))

    def _spark(self, sql: str) -> DataFrame:
        return self.database.spark.sql(sql)

    def _query(self, p: dict, binder: Binder) -> DataFrame:
        sql, columns = binder.query(p["query"])
        make = lambda: self._spark(sql).toDF(*(c for c, _ in columns))
        return self._planned(make(), make)

    def _planned(self, df: DataFrame, make) -> DataFrame:
        """df, or the same planned without a rule that Spark 4.1 breaks off in: a scalar subquery that correlates two unions."""
        try:
            df._jdf.queryExecution().optimizedPlan()
            return df
        except Py4JJavaError as error:
            if "key not found" not in str(error.java_exception):
                raise
        conf, key = self.database.spark.conf, "spark.sql.optimizer.excludedRules"
        before = conf.get(key, "")
        conf.set(key, ",".join(filter(None, [before, "org.apache.spark.sql.catalyst.optimizer.PushProjectionThroughUnion"])))
        try:
            df = make()
            df._jdf.queryExecution().executedPlan()
            return df
        finally:
            conf.set(key, before) if before else conf.unset(key)

    def _explain(self, p: dict, binder: Binder) -> DataFrame:
        text = self.database.explain(self._query(p, binder), p["analyze"])
        return self.database.spark.createDataFrame([(line,) for line in text.splitlines()], "`QUERY PLAN` string")

    # ---- changes

    def _plain(self, df: DataFrame, *aliases: str) -> Scope:
        """A scope in which every alias names df's columns by their plain names."""
        return Scope([Relation(a, [(f.name, family(f.dataType)) for f in df.schema]) for a in aliases])

    def _returning(self, items, df: DataFrame, binder: Binder, alias: str) -> DataFrame | None:
        if items is None:
            return None
        view = binder.fresh()
        df.createOrReplaceTempView(f"corvane_returning{view}")
        scope = self._plain(df, alias)
        made = binder.items(Select(items=items), scope)
        return self._spark(f"SELECT {', '.join(f'{s} AS {quoted(n)}' for s, n, _ in made)} FROM `corvane_returning{view}` AS {quoted(alias)}")

    def _insert(self, p: dict, binder: Binder) -> DataFrame | None:
        table = self.database.table(p["table"])
        names = p["columns"] or list(table.columns)
        if p["query"] is None:
            source = self.database.spark.range(1).select()
            names = []
        else:
            source = self._values_for(p["query"], table, names, binder)
        alias = p["table"].split(".")[-1]
        update, where = None, None
        if p["conflict"] == "update":
            own = Relation(alias, [(c, family(spark_type(k))) for c, k in table.columns.items()])
            scope = Scope([own, Relation("excluded", own.columns)])
            flat = lambda s: s.replace("`excluded`.`", "`excluded_").replace(f"{quoted(alias)}.", "")

            def told(x: Node) -> Column:
                # a bare name is the table's own column
                return F.expr(flat(binder.expr(_qualified(x, alias), scope)[0]))

            update = {c: told(x) for c, x in p["update"]}
            where = told(p["where"]) if p["where"] else None
        added = table.insert(source, names, p["conflict"], update, where, returning=["*"] if p["returning"] is not None else None)
        return self._returning(p["returning"], added, binder, alias)

    def _values_for(self, query: Query, table, names: list[str], binder: Binder) -> DataFrame:
        """The rows to insert, literals in the columns' types."""
        if isinstance(query.body, Values) and not query.ctes:
            kinds = [family(spark_type(table.columns[n])) for n in names]
            rows = [f"({', '.join(self._stored(x, n, k, table, binder) for x, n, k in zip(r, names, kinds, strict=False))})" for r in query.body.rows]
            width = len(query.body.rows[0])
            return self._spark(f"SELECT * FROM VALUES {', '.join(rows)} AS __v({', '.join(map(quoted, names[:width]))})")
        return self._query({"query": query}, binder)

    def _stored(self, x: Node, name: str, kind: str, table, binder: Binder) -> str:
        sql, given = binder.expr(x, Scope(), kind)
        if given not in (kind, "unknown"):
            raise TypeMismatch(f"column {name} is {kind}, the value {given}")
        return f"CAST({sql} AS {spark_type(table.columns[name]).simpleString()})"

    def _from(self, p: dict, binder: Binder, table, alias: str) -> tuple[DataFrame | None, Scope, dict[str, str]]:
        """FROM or USING as a DataFrame whose columns carry their relation's name, so that none clashes with the table's."""
        own = Relation(alias, [(c, family(spark_type(k))) for c, k in table.columns.items()])
        if p["source"] is None:
            return None, Scope([own]), {}
        inner = Scope()
        sql = binder.source(p["source"], inner, {})
        flat = {f"{quoted(r.alias)}.{quoted(c)}": quoted(f"__{r.alias}_{c}") for r in inner.relations for c, _ in r.columns}
        df = self._spark(f"SELECT {', '.join(f'{a} AS {b}' for a, b in flat.items())} FROM {sql}")
        return df, Scope([own, *inner.relations]), flat

    def _change(self, p: dict, binder: Binder):
        table = self.database.table(p["table"])
        alias = p["alias"] or p["table"].split(".")[-1]
        source, scope, flat = self._from(p, binder, table, alias)

        def told(x: Node, wanted: str | None = None) -> Column:
            sql, kind = binder.expr(x, scope, wanted)
            if wanted and kind not in (wanted, "unknown"):
                raise TypeMismatch(f"a value of type {kind} for {wanted}")
            for a, b in flat.items():
                sql = sql.replace(a, b)
            return F.expr(sql.replace(f"{quoted(alias)}.", ""))

        return table, alias, source, told

    def _update(self, p: dict, binder: Binder) -> DataFrame | None:
        table, alias, source, told = self._change(p, binder)
        changes = {}
        for c, x in p["changes"]:
            default = table.defaults.get(c)
            changes[c] = (default if isinstance(default, Column) else F.lit(None)) if x.kind == "default" else told(x, family(spark_type(table.columns[c])))
        where = told(p["where"]) if p["where"] else (F.lit(True) if source is not None else None)
        got = table.update(changes, where, source, returning=["*"] if p["returning"] is not None else None)
        return self._returning(p["returning"], got, binder, alias)

    def _delete(self, p: dict, binder: Binder) -> DataFrame | None:
        table, alias, source, told = self._change(p, binder)
        where = told(p["where"]) if p["where"] else (F.lit(True) if source is not None else None)
        got = table.delete(where, source, returning=list(table.columns) if p["returning"] is not None else None)
        return self._returning(p["returning"], got, binder, alias)

    def _truncate(self, p: dict, binder: Binder) -> None:
        self.database.truncate(*p["tables"])

    # ---- definitions and session

    def _create_table(self, p: dict, binder: Binder) -> None:
        from corvane.operators.dml import ForeignKey

        if p["if_not_exists"] and self.database._key(p["name"]) in self.database.tables:
            return
        alias = p["name"].split(".")[-1]
        kinds = {c: {"serial": "integer", "bigserial": "bigint", "smallserial": "smallint"}.get(k, k) for c, k in p["columns"].items()}
        scope = Scope([Relation(alias, [(c, family(spark_type(k))) for c, k in kinds.items()])])
        plain = lambda x, wanted=None: F.expr(binder.expr(x, scope, wanted)[0].replace(f"{quoted(alias)}.", ""))
        keys = []
        for columns, other, references in p["foreign"]:
            theirs = self.database.table(other)
            keys.append(ForeignKey(columns, theirs, references or theirs.primary_key))
        self.database.create_table(
            p["name"], p["columns"], primary_key=p["key"], unique=p["unique"], not_null=p["not_null"], foreign_keys=keys,
            checks={f"check{i + 1}": plain(x) for i, x in enumerate(p["checks"])}, defaults={c: plain(x, family(spark_type(kinds[c]))) for c, x in p["defaults"].items()},
        )

    def _create_view(self, p: dict, binder: Binder) -> None:
        self.database.create_view(p["name"], self._query(p, binder), p["columns"], p["replace"])

    def _create_schema(self, p: dict, binder: Binder) -> None:
        self.database.create_schema(**p)

    def _create_index(self, p: dict, binder: Binder) -> None:
        self.database.create_index(**p)

    def _create_sequence(self, p: dict, binder: Binder) -> None:
        self.database.create_sequence(**p)

    def _drop(self, p: dict, binder: Binder) -> None:
        for name in p["names"]:
            try:
                getattr(self.database, f"drop_{p['what']}")(name)
            except (DialectError, KeyError):
                if not p["if_exists"]:
                    raise

    def _alter(self, p: dict, binder: Binder) -> None:
        from corvane.operators.dml import ForeignKey

        table, do = self.database.table(p["table"]), p["do"]
        if do == "rename":
            schema = self.database._key(p["table"])[0]
            self.database.rename_table(p["table"], f"{schema}.{p['to']}")
        elif do in ("add_primary_key", "add_unique"):
            getattr(table, do)(*p["columns"])
        elif do == "add_foreign_key":
            theirs = self.database.table(p["other"])
            table.add_foreign_key(ForeignKey(tuple(p["columns"]), theirs, tuple(p["references"]) or theirs.primary_key))
        elif do == "add_column":
            default = F.expr(binder.expr(p["default"], Scope(), family(spark_type(p["type"])))[0]) if p["default"] else None
            table.add_column(p["column"], p["type"], default)
        elif do == "rename_column":
            table.rename_column(p["column"], p["to"])
        elif do == "alter_type":
            table.alter_type(p["column"], p["type"])
        else:
            getattr(table, do)(p.get("column") or p["name"])

    def _declare(self, p: dict, binder: Binder) -> None:
        from corvane.streaming.results import Cursor

        df = self._query(p, binder)
        self.database.cursors[p["name"]] = (df.schema, Cursor(df))

    def _fetch(self, p: dict, binder: Binder) -> DataFrame:
        if p["name"] not in self.database.cursors:
            raise DialectError("34000", f"cursor {p['name']} does not exist")
        schema, cursor = self.database.cursors[p["name"]]
        return self.database.spark.createDataFrame(cursor.fetch(p["count"]), schema)

    def _close(self, p: dict, binder: Binder) -> None:
        if p["name"] not in self.database.cursors:
            raise DialectError("34000", f"cursor {p['name']} does not exist")
        self.database.cursors.pop(p["name"])[1].close()

    def _analyze(self, p: dict, binder: Binder) -> None:
        for name in [p["table"]] if p["table"] else [f"{s}.{n}" for s, n in self.database.tables]:
            self.database.analyze(name)

    def _nothing(self, p: dict, binder: Binder) -> None:
        return None

    def _set(self, p: dict, binder: Binder) -> None:
        self.database.set(p["name"], p["value"])

    def _show(self, p: dict, binder: Binder) -> DataFrame:
        return self.database.spark.createDataFrame([(self.database.show(p["name"]),)], f"{p['name']} string")

    def _reset(self, p: dict, binder: Binder) -> None:
        self.database.reset(p["name"])

    def _discard(self, p: dict, binder: Binder) -> None:
        self.database.discard_all()


def _qualified(x: Node, alias: str) -> Node:
    """x with bare column names under the alias."""
    if x.kind == "column" and len(x.args) == 1:
        return Node("column", (alias, x.args[0]))
    deeper = lambda a: _qualified(a, alias) if isinstance(a, Node) else [deeper(b) for b in a] if isinstance(a, list) else tuple(deeper(b) for b in a) if isinstance(a, tuple) else a
    return Node(x.kind, tuple(deeper(a) for a in x.args))


__all__ = ["Binder", "Dialect", "Statement"]


def _parts(x):
    """All nodes of an expression, queries' insides left out."""
    if isinstance(x, Node):
        yield x
        for a in x.args:
            yield from _parts(a)
    elif isinstance(x, (list, tuple)):
        for a in x:
            yield from _parts(a)


def _queries(x: Node):
    return (n for n in _parts(x) if n.kind in ("scalar", "exists", "in_query"))


def _aggregates(x: Node) -> bool:
    return any(n.kind == "call" and n[0] in _AGGREGATES for n in _parts(x))
