"""A catalog: schemas, tables, views, sequences, settings, prepared statements, statistics, and the views that describe them."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.types import DialectError, NotSupported, family, spark_type
from corvane.operators.dml import Table
from corvane.session import apply_runtime_defaults, stored


@dataclass
class Sequence64:
    """A generator of 64-bit integers, in the driver.  Rows of a DataFrame get a block of values at once."""

    name: str
    increment: int = 1
    start: int | None = None
    minimum: int | None = None
    maximum: int | None = None
    cycle: bool = False
    last: int | None = None
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __post_init__(self) -> None:
        if self.increment == 0:
            raise DialectError("22023", "INCREMENT must not be zero")
        up = self.increment > 0
        self.minimum = self.minimum if self.minimum is not None else (1 if up else -(2**63))
        self.maximum = self.maximum if self.maximum is not None else (2**63 - 1 if up else -1)
        self.start = self.start if self.start is not None else (self.minimum if up else self.maximum)
        self._next, self._used = self.start, False

    def _take(self) -> int:
        value = self._next
        if not self.minimum <= value <= self.maximum:
            if not self.cycle:
                raise DialectError("2200H", f"nextval: reached the end of sequence {self.name}")
            value = self.minimum if self.increment > 0 else self.maximum
        self._next, self.last = value + self.increment, value
        return value

    def nextval(self) -> int:
        with self.lock:
            return self._take()

    def currval(self) -> int:
        if self.last is None:
            raise DialectError("55000", f"currval of sequence {self.name} is not yet defined in this session")
        return self.last

    def setval(self, value: int, is_called: bool = True) -> int:
        if not self.minimum <= value <= self.maximum:
            raise DialectError("22003", f"setval: value {value} is out of bounds")
        with self.lock:
            self._next = value + self.increment if is_called else value
            self.last = value if is_called else self.last
        return value

    def fill(self, df: DataFrame, column: str) -> DataFrame:
        """df with a value for each row: numbers within partitions, and a block that starts where partitions before end."""
        with self.lock:
            # stored, so that the rows that are counted are those that are numbered
            parted = stored(df.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
            sizes = {r["__part"]: r["count"] for r in parted.groupBy("__part").count().collect()}  # one row for each partition
            total, base, ends = 0, [], self._next
            for part in sorted(sizes):
                base.append((part, total))
                total += sizes[part]
            last = ends + (total - 1) * self.increment
            if total and not self.minimum <= last <= self.maximum:
                raise DialectError("2200H", f"nextval: reached the end of sequence {self.name}")
            starts = df.sparkSession.createDataFrame(base, "__part int, __before bigint")
            place = F.row_number().over(Window.partitionBy("__part").orderBy("__id")) - 1 + F.col("__before")
            if total:
                self._next, self.last = last + self.increment, last
            numbered = parted.join(F.broadcast(starts), "__part")  # a row for each partition
            return numbered.select(*df.columns, (F.lit(ends).cast("bigint") + place * self.increment).alias(column))


#: Settings and their defaults.
SETTINGS = {
    "work_mem": "4MB", "statement_timeout": "0", "search_path": '"$user", public', "default_statistics_target": "100", "timezone": "UTC", "client_encoding": "UTF8",
    "server_encoding": "UTF8", "datestyle": "ISO, MDY", "intervalstyle": "postgres", "standard_conforming_strings": "on", "application_name": "", "extra_float_digits": "1",
    "default_transaction_isolation": "read committed", "transaction_isolation": "read committed", "client_min_messages": "notice", "bytea_output": "hex",
}


#: Types by OID, with their short and their full names.
TYPES = (
    (16, "bool", "boolean"), (17, "bytea", "bytea"), (20, "int8", "bigint"), (21, "int2", "smallint"), (23, "int4", "integer"), (25, "text", "text"), (700, "float4", "real"),
    (701, "float8", "double precision"), (1007, "_int4", "integer[]"), (1009, "_text", "text[]"), (1016, "_int8", "bigint[]"), (1022, "_float8", "double precision[]"), (1042, "bpchar", "character"),
    (1043, "varchar", "character varying"), (1082, "date", "date"), (1083, "time", "time without time zone"), (1114, "timestamp", "timestamp without time zone"),
    (1184, "timestamptz", "timestamp with time zone"), (1186, "interval", "interval"), (1700, "numeric", "numeric"), (2950, "uuid", "uuid"),
)


def _type_of(declared: str) -> tuple[int, int]:
    """(OID, modifier) of a type name such as varchar(5)."""
    base, _, rest = declared.lower().partition("(")
    base, given = base.strip(), [int(x) for x in rest.rstrip(")] ").split(",") if x.strip().isdigit()]
    base = {"int": "integer", "decimal": "numeric", "float": "double precision", "double": "double precision", "char": "character", "serial": "integer", "bigserial": "bigint", "boolean": "boolean"}.get(base, base)
    oid = next((o for o, short, shown in TYPES if base in (short, shown, shown.split(" without")[0])), 0)
    modifier = (given[0] << 16 | (given[1] if len(given) > 1 else 0)) + 4 if given and oid == 1700 else given[0] + 4 if given else -1
    return oid, modifier


@dataclass
class Database:
    spark: SparkSession
    name: str = "corvane"
    tables: dict[tuple[str, str], Table] = field(default_factory=dict)
    views: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    schemas: list[str] = field(default_factory=lambda: ["pg_catalog", "information_schema", "public"])
    sequences: dict[str, Sequence64] = field(default_factory=dict)
    indexes: dict[str, tuple[str, tuple[str, ...], bool]] = field(default_factory=dict)
    settings: dict[str, str] = field(default_factory=lambda: dict(SETTINGS))
    prepared: dict[str, str] = field(default_factory=dict)
    statistics: dict[tuple[str, str], list[dict]] = field(default_factory=dict)
    cursors: dict[str, tuple] = field(default_factory=dict)

    def __post_init__(self) -> None:
        apply_runtime_defaults(self.spark)

    def _key(self, name: str) -> tuple[str, str]:
        schema, _, base = name.rpartition(".")
        return (schema or "public", base)

    def sql(self, text: str, *params: object) -> DataFrame | None:
        """A statement in the dialect's SQL."""
        from .dialect import Dialect

        return Dialect(self).run(text, *params)

    # ---- definitions

    def create_schema(self, name: str, if_not_exists: bool = False) -> None:
        if name in self.schemas:
            if if_not_exists:
                return
            raise DialectError("42P06", f"schema {name} already exists")
        self.schemas.append(name)

    def drop_schema(self, name: str) -> None:
        if any(s == name for s, _ in (*self.tables, *self.views)):
            raise DialectError("2BP01", f"schema {name} is not empty")
        self.schemas.remove(name)

    def create_table(self, name: str, columns: dict[str, str], rows: DataFrame | None = None, **options) -> Table:
        key = self._key(name)
        if key in self.tables or key in self.views:
            raise DialectError("42P07", f"relation {name} already exists")
        if key[0] not in self.schemas:
            raise DialectError("3F000", f"schema {key[0]} does not exist")
        kinds, defaults = {}, dict(options.pop("defaults", {}))
        for c, kind in columns.items():
            if kind.lower() in ("serial", "bigserial", "smallserial"):
                made = self.create_sequence(f"{key[1]}_{c}_seq")
                defaults[c] = lambda df, column, s=made: s.fill(df, column)
                kind = {"serial": "integer", "bigserial": "bigint", "smallserial": "smallint"}[kind.lower()]
            kinds[c] = kind
        self.tables[key] = Table.create(self.spark, key[1], kinds, rows, defaults=defaults, **options)
        return self.tables[key]

    def drop_table(self, name: str) -> None:
        table = self.table(name)
        if any(child is not table for child, _ in table.referenced_by):
            raise DialectError("2BP01", f"other tables reference {name}")
        del self.tables[self._key(name)]

    def rename_table(self, old: str, new: str) -> None:
        self.tables[self._key(new)] = self.tables.pop(self._key(old))
        self.tables[self._key(new)].name = self._key(new)[1]

    def table(self, name: str) -> Table:
        if self._key(name) not in self.tables:
            raise DialectError("42P01", f"relation {name} does not exist")
        return self.tables[self._key(name)]

    def create_view(self, name: str, query: DataFrame, columns: Sequence[str] | None = None, replace: bool = False) -> None:
        """A view holds its resolved query: renaming what it reads doesn't break it."""
        key = self._key(name)
        if key in self.tables or (key in self.views and not replace):
            raise DialectError("42P07", f"relation {name} already exists")
        self.views[key] = query.toDF(*columns) if columns else query
        self.views[key].createOrReplaceTempView(key[1])

    def drop_view(self, name: str) -> None:
        if self.views.pop(self._key(name), None) is None:
            raise DialectError("42P01", f"view {name} does not exist")
        self.spark.catalog.dropTempView(self._key(name)[1])

    def read(self, name: str) -> DataFrame:
        key = self._key(name)
        return self.views[key] if key in self.views else self.table(name).rows

    def create_index(self, name: str, table: str, columns: Sequence[str], unique: bool = False) -> None:
        """A unique index checks its key from now on; others are taken note of, as Spark prunes by file statistics instead."""
        if name in self.indexes:
            raise DialectError("42P07", f"relation {name} already exists")
        if unique:
            self.table(table).add_unique(*columns)
        self.indexes[name] = (table, tuple(columns), unique)

    def drop_index(self, name: str) -> None:
        table, columns, unique = self.indexes.pop(name)
        if unique:
            self.table(table).unique.remove(columns)

    def create_sequence(self, name: str, **options) -> Sequence64:
        if name in self.sequences:
            raise DialectError("42P07", f"relation {name} already exists")
        self.sequences[name] = Sequence64(name, **options)
        return self.sequences[name]

    def drop_sequence(self, name: str) -> None:
        if self.sequences.pop(name, None) is None:
            raise DialectError("42P01", f"sequence {name} does not exist")

    def truncate(self, *names: str) -> None:
        tables = [self.table(n) for n in names]
        before = [t.rows for t in tables]
        try:
            for t in tables:  # emptied together: one may reference another
                t.rows = t.rows.limit(0)
            for t in tables:
                t._check_references(t.rows)
        except DialectError:
            for t, rows in zip(tables, before, strict=True):
                t.rows = rows
            raise

    # ---- session

    def set(self, name: str, value: str) -> None:
        if name.lower() not in self.settings:
            raise DialectError("42704", f"unrecognized configuration parameter {name}")
        if name.lower() == "timezone" and value.upper() != "UTC":
            raise NotSupported("time zones other than UTC")
        self.settings[name.lower()] = value

    def show(self, name: str) -> str:
        if name.lower() not in self.settings:
            raise DialectError("42704", f"unrecognized configuration parameter {name}")
        return self.settings[name.lower()]

    def reset(self, name: str | None = None) -> None:
        if name is None:
            self.settings = dict(SETTINGS)
        else:
            self.set(name, SETTINGS[name.lower()])

    def discard_all(self) -> None:
        self.reset()
        self.prepared.clear()

    def prepare(self, name: str, sql: str) -> None:
        self.prepared[name] = sql

    def execute(self, name: str, *args: object) -> DataFrame:
        """$1, $2, ... are bound as typed parameters, never as text."""
        import re

        sql = self.prepared[name]
        return self.spark.sql(re.sub(r"\$(\d+)", r":p\1", sql), args={f"p{i + 1}": a for i, a in enumerate(args)})

    def explain(self, query: DataFrame, analyze: bool = False) -> str:
        """The plan; with analyze the query runs, and each node that counts its rows shows how many it gave."""
        execution = query._jdf.queryExecution()
        if not analyze:
            return execution.explainString(query._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        began = time.perf_counter()
        execution.toRdd().count()
        lines: list[str] = []

        def walk(plan, depth: int) -> None:
            kind = plan.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                return walk(plan.executedPlan(), depth)
            if kind.endswith("QueryStageExec"):
                return walk(plan.plan(), depth)
            if kind not in ("WholeStageCodegenExec", "InputAdapter", "AQEShuffleReadExec"):
                rows = plan.metrics().get("numOutputRows")
                shown = f" (actual rows={rows.get().value()} loops=1)" if rows.isDefined() else ""
                lines.append(f"{'  ' * depth}{'-> ' * bool(depth)}{plan.simpleStringWithNodeId()[:300]}{shown}")
                depth += 1
            children = plan.children()
            for i in range(children.size()):
                walk(children.apply(i), depth)

        walk(execution.executedPlan(), 0)
        return "\n".join([*lines, f"Execution Time: {(time.perf_counter() - began) * 1000:.3f} ms"])

    def functions(self) -> dict[str, object]:
        """Session and introspection functions without arguments, as they stand now."""
        return {
            "version": f"Corvane on Spark {self.spark.version}", "current_database": self.name, "current_catalog": self.name, "current_schema": "public", "current_user": "corvane",
            "session_user": "corvane", "user": "corvane", "pg_backend_pid": os.getpid(), "pg_my_temp_schema": 0,
        }

    #: Introspection functions that are constants.
    TRUE = ("has_table_privilege", "has_schema_privilege", "has_database_privilege", "has_column_privilege", "has_sequence_privilege", "has_function_privilege", "has_any_column_privilege", "pg_has_role", "pg_table_is_visible", "pg_function_is_visible")
    ZERO = ("pg_relation_size", "pg_table_size", "pg_indexes_size", "pg_total_relation_size", "pg_my_temp_schema")
    FALSE = ("pg_is_other_temp_schema",)
    NULL = ("obj_description", "col_description", "pg_get_viewdef", "pg_get_triggerdef", "pg_get_ruledef", "pg_get_partkeydef", "pg_get_functiondef")

    def _constraints(self) -> list[tuple[int, str, tuple[str, str], str, tuple[str, ...], str]]:
        """(oid, name, table, kind, columns, definition) of every constraint."""
        out: list[tuple[str, tuple[str, str], str, tuple[str, ...], str]] = []
        indexed = {(self._key(t), tuple(c)) for t, c, unique in self.indexes.values() if unique}  # an index is no constraint
        for (s, n), t in self.tables.items():
            if t.primary_key:
                out.append((f"{n}_pkey", (s, n), "p", tuple(t.primary_key), f"PRIMARY KEY ({', '.join(t.primary_key)})"))
            out += [(f"{n}_{'_'.join(u)}_key", (s, n), "u", tuple(u), f"UNIQUE ({', '.join(u)})") for u in t.unique if ((s, n), tuple(u)) not in indexed]
            out += [(c, (s, n), "c", (), f"CHECK ({c})") for c in t.checks]
            out += [(k.name, (s, n), "f", tuple(k.columns), f"FOREIGN KEY ({', '.join(k.columns)}) REFERENCES {k.table.name}({', '.join(k.references)})") for k in t.foreign_keys]
        return [(60000 + i, *x) for i, x in enumerate(out)]

    def _indexed(self, name: str) -> str:
        table, columns, unique = self.indexes[name]
        return f"CREATE {'UNIQUE ' if unique else ''}INDEX {name} ON {table} USING btree ({', '.join(columns)})"

    def by_oid(self, name: str, rest: Sequence[str] = ()) -> dict[int, str] | None:
        """What an introspection function gives for each OID; None for a function of something else."""
        match name.lower():
            case "format_type":
                return {oid: shown for oid, _, shown in TYPES}
            case "pg_get_constraintdef":
                return {c[0]: c[-1] for c in self._constraints()}
            case "pg_get_indexdef":
                return {40000 + i: self._indexed(n) for i, n in enumerate(self.indexes)}
            case "pg_get_userbyid":
                return {10: "corvane"}
        return None

    def call(self, name: str, *args: object) -> object:
        name = name.lower()
        if args and args[0] is not None and str(args[0]).isdigit() and (known := self.by_oid(name)) is not None:
            shown = known.get(int(str(args[0])))
            modifier = int(str(args[1])) if name == "format_type" and len(args) > 1 and args[1] is not None else -1
            if shown and modifier >= 4 and shown.startswith("character"):
                return f"{shown}({modifier - 4})"
            if shown == "numeric" and modifier >= 4:
                return f"numeric({modifier - 4 >> 16},{modifier - 4 & 0xFFFF})"
            return shown
        if name in self.functions():
            return self.functions()[name]
        for names, value in ((self.TRUE, True), (self.ZERO, 0), (self.FALSE, False), (self.NULL, None)):
            if name in names:
                return value
        if name == "current_setting":
            return self.show(str(args[0]))
        if name in ("nextval", "currval", "setval"):
            return getattr(self.sequences[str(args[0])], name)(*args[1:])
        if name in ("format_type", "to_regtype"):
            try:
                spark_type(str(args[0]))
            except NotSupported:
                return None
            return str(args[0]).lower()
        if name == "to_regclass":
            return str(args[0]) if self._key(str(args[0])) in {**self.tables, **self.views} else None
        if name == "pg_get_userbyid":
            return "corvane"
        if name == "pg_get_serial_sequence":
            wanted = f"{self._key(str(args[0]))[1]}_{args[1]}_seq"
            return f"public.{wanted}" if wanted in self.sequences else None
        if name == "pg_get_indexdef":
            return self._indexed(str(args[0]))
        if name == "pg_get_constraintdef":
            table = self.table(str(args[0]))
            return f"PRIMARY KEY ({', '.join(table.primary_key)})"
        if name in ("pg_get_expr", "oidvectortypes", "pg_get_function_arguments", "pg_get_function_result"):
            return str(args[0]) if args else None
        raise DialectError("42883", f"function {name} does not exist")

    # ---- statistics and descriptions

    def analyze(self, name: str, buckets: int = 100) -> DataFrame:
        """Per column: null fraction, distinct values (about), least and greatest, and bounds of equal parts; in one pass."""
        df = self.read(name)
        plain = [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))]
        parts = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(plain):
            c = F.col(f"`{f.name}`")
            parts += [F.count(c).alias(f"c{i}"), F.approx_count_distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"z{i}")]
            if isinstance(f.dataType, T.NumericType):
                parts.append(F.percentile_approx(c, [k / min(buckets, 10) for k in range(min(buckets, 10) + 1)]).cast("array<string>").alias(f"h{i}"))
        row = df.agg(*parts).first()
        found = []
        for i, f in enumerate(plain):
            n = row["n"]
            found.append({"tablename": self._key(name)[1], "attname": f.name, "null_frac": (n - row[f"c{i}"]) / n if n else 0.0, "n_distinct": float(row[f"d{i}"]), "least": row[f"a{i}"], "greatest": row[f"z{i}"], "histogram_bounds": row[f"h{i}"] if isinstance(f.dataType, T.NumericType) else None})
        self.statistics[self._key(name)] = found
        return self.pg_stats()

    def pg_stats(self) -> DataFrame:
        schema = "schemaname string, tablename string, attname string, null_frac double, n_distinct double, least string, greatest string, histogram_bounds array<string>"
        rows = [(s, x["tablename"], x["attname"], x["null_frac"], x["n_distinct"], x["least"], x["greatest"], x["histogram_bounds"]) for (s, _), xs in self.statistics.items() for x in xs]
        return self.spark.createDataFrame(rows, schema)

    def _relations(self) -> list[tuple[str, str, str, T.StructType, dict[str, str]]]:
        out = [(s, n, "BASE TABLE", t.rows.schema, t.columns) for (s, n), t in self.tables.items()]
        return out + [(s, n, "VIEW", v.schema, {f.name: family(f.dataType) for f in v.schema}) for (s, n), v in self.views.items()]

    def system(self, view: str) -> DataFrame:
        """A catalog view by name."""
        make, relations = self.spark.createDataFrame, self._relations()
        oid = {(s, n): 16384 + i for i, (s, n, *_) in enumerate(relations)}
        space = {s: 2200 + i for i, s in enumerate(self.schemas)}
        match view.lower():
            case "information_schema.schemata":
                return make([(self.name, s) for s in self.schemas], "catalog_name string, schema_name string")
            case "information_schema.tables":
                return make([(self.name, s, n, k) for s, n, k, *_ in relations], "table_catalog string, table_schema string, table_name string, table_type string")
            case "information_schema.columns":
                rows = []
                for s, n, _, schema, kinds in relations:
                    t = self.tables.get((s, n))
                    required = set(t.primary_key) | t.not_null if t else set()
                    rows += [(self.name, s, n, f.name, i + 1, "NO" if f.name in required else "YES", kinds[f.name]) for i, f in enumerate(schema)]
                return make(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
            case "pg_namespace":
                return make([(space[s], s) for s in self.schemas], "oid bigint, nspname string")
            case "pg_class":
                rows = [(oid[s, n], n, space[s], "r" if k == "BASE TABLE" else "v", len(schema)) for s, n, k, schema, _ in relations]
                rows += [(30000 + i, n, 2202, "S", 3) for i, n in enumerate(self.sequences)] + [(40000 + i, n, 2202, "i", len(c)) for i, (n, (_, c, _)) in enumerate(self.indexes.items())]
                return make(rows, "oid bigint, relname string, relnamespace bigint, relkind string, relnatts int")
            case "pg_attribute":
                rows = []
                for s, n, _, schema, kinds in relations:
                    t = self.tables.get((s, n))
                    required = set(t.primary_key) | t.not_null if t else set()
                    rows += [(oid[s, n], f.name, i + 1, kinds[f.name], *_type_of(kinds[f.name]), f.name in required) for i, f in enumerate(schema)]
                return make(rows, "attrelid bigint, attname string, attnum int, atttypname string, atttypid bigint, atttypmod int, attnotnull boolean")
            case "pg_type":
                return make([(o, n) for o, n, _ in TYPES], "oid bigint, typname string")
            case "pg_index":
                rows = [(40000 + i, oid.get(self._key(t), 0), u, list(c)) for i, (_, (t, c, u)) in enumerate(self.indexes.items())]
                return make(rows, "indexrelid bigint, indrelid bigint, indisunique boolean, indkeys array<string>")
            case "pg_constraint":
                rows = [(o, c, oid[t], kind, list(columns)) for o, c, t, kind, columns, _ in self._constraints()]
                return make(rows, "oid bigint, conname string, conrelid bigint, contype string, conkeys array<string>")
            case "pg_attrdef":
                return make([(oid[s, n], c) for (s, n), t in self.tables.items() for c in t.defaults], "adrelid bigint, attname string")
            case "pg_settings":
                return make(sorted(self.settings.items()), "name string, setting string")
            case "pg_database":
                return make([(1, self.name)], "oid bigint, datname string")
            case "pg_roles":
                return make([(10, "corvane", True)], "oid bigint, rolname string, rolsuper boolean")
            case "pg_stat_activity":
                return make([(os.getpid(), self.name, "corvane", "active")], "pid int, datname string, usename string, state string")
            case "pg_proc":
                return make([(50000 + i, n) for i, n in enumerate(sorted(self.functions()))], "oid bigint, proname string")
            case "pg_depend":
                # what goes when a table goes: its constraints and its indexes
                rows = [(2606, o, oid[t], "a") for o, _, t, *_ in self._constraints()]
                rows += [(1259, 40000 + i, oid[self._key(t)], "a") for i, (t, _, _) in enumerate(self.indexes.values()) if self._key(t) in oid]
                return make(rows, "classid bigint, objid bigint, refobjid bigint, deptype string")
            case "pg_stats":
                return self.pg_stats()
        raise DialectError("42P01", f"relation {view} does not exist")
