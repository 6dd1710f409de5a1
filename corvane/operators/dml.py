"""INSERT, UPDATE, DELETE and TRUNCATE over immutable DataFrames.

A :class:`Table` is a schema, its constraints, and a DataFrame.  A statement checks its rows with queries, then gives a
new DataFrame to the table and hands back what RETURNING would: new rows of an insert or update, old ones of a delete.
Sources are read once, before anything changes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.types import DialectError, check_same, spark_type


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: Table
    references: tuple[str, ...]
    name: str = "foreign key"


@dataclass
class Table:
    name: str
    columns: dict[str, str]  # name to dialect type, in order
    rows: DataFrame
    primary_key: tuple[str, ...] = ()
    unique: list[tuple[str, ...]] = field(default_factory=list)
    not_null: set[str] = field(default_factory=set)
    checks: dict[str, Column] = field(default_factory=dict)
    defaults: dict[str, Column | Callable[[DataFrame, str], DataFrame]] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    referenced_by: list[tuple[Table, ForeignKey]] = field(default_factory=list)

    @classmethod
    def create(cls, spark: SparkSession, name: str, columns: dict[str, str], rows: DataFrame | None = None, **options) -> Table:
        schema = T.StructType([T.StructField(c, spark_type(k)) for c, k in columns.items()])
        table = cls(name, dict(columns), rows if rows is not None else spark.createDataFrame([], schema), **options)
        for key in table.foreign_keys:
            key.table.referenced_by.append((table, key))
        return table

    # ---- checks

    def _shaped(self, df: DataFrame) -> DataFrame:
        """df's columns as the table's, in its order and types."""
        out = []
        for name, kind in self.columns.items():
            wanted = spark_type(kind)
            given = df.schema[name].dataType
            check_same(given, wanted, what=f"column {name}")
            out.append(F.col(name).cast(wanted).alias(name) if given != wanted else F.col(name))
        return df.select(*out)

    def _check_rows(self, new: DataFrame) -> None:
        tests = [(F.col(c).isNull(), "23502", f"null value in column {c}") for c in {*self.not_null, *self.primary_key}]
        for c, kind in self.columns.items():
            base, _, rest = kind.lower().partition("(")
            if base.strip() in ("varchar", "char", "character varying", "character", "bpchar") and rest:
                tests.append((F.char_length(F.col(c)) > int(rest.rstrip(") ")), "22001", f"value too long for {c} {kind}"))
            if base.strip() in ("smallint", "int2", "integer", "int", "int4"):
                bits = 15 if base.strip() in ("smallint", "int2") else 31
                tests.append(((F.col(c) < -(2**bits)) | (F.col(c) >= 2**bits), "22003", f"{c} out of range"))
        tests += [(~F.coalesce(check, F.lit(True)), "23514", f"check {name}") for name, check in self.checks.items()]
        if tests:
            # one pass for all of them: an aggregate of one row
            found = new.agg(*(F.coalesce(F.bool_or(t), F.lit(False)).alias(f"t{i}") for i, (t, _, _) in enumerate(tests))).first()
            for broken, (_, state, message) in zip(found, tests, strict=True):
                if broken:
                    raise DialectError(state, message)

    def _check_keys(self, rows: DataFrame, new: DataFrame, others: DataFrame | None = None, touched: set[str] | None = None) -> None:
        """Unique and foreign keys of new rows, where rows are those of the whole table.

        Keys of others, the rows beside new, are unlike already, so that only new ones meet them; none of them is looked at for
        a key that no column in touched belongs to.  Without others all rows are held against each other.
        """
        for key in [k for k in (self.primary_key, *self.unique) if k and (touched is None or touched & set(k))]:
            full = (rows if others is None else new).select(*key).dropna()
            broken = bool(full.groupBy(*key).count().filter("count > 1").take(1))
            if not broken and others is not None:
                there = others.select(*(F.col(c).alias(f"__{c}") for c in key))
                broken = bool(full.join(there, [F.col(c) == F.col(f"__{c}") for c in key], "left_semi").take(1))
            if broken:
                raise DialectError("23505", f"duplicate key in {self.name} ({', '.join(key)})")
        for key in self.foreign_keys:
            theirs = rows if key.table is self else key.table.rows
            missing = new.select(*key.columns).dropna().distinct()
            there = theirs.select(*(F.col(b).alias(f"__{b}") for b in key.references))
            if missing.join(there, [F.col(a) == F.col(f"__{b}") for a, b in zip(key.columns, key.references, strict=True)], "left_anti").take(1):
                raise DialectError("23503", f"{self.name} violates {key.name}")

    def _check_references(self, rows: DataFrame) -> None:
        for child, key in self.referenced_by:
            theirs = rows if child is self else child.rows
            used = theirs.select(*key.columns).dropna().distinct()
            kept = rows.select(*(F.col(b).alias(f"__{b}") for b in key.references))
            if used.join(kept, [F.col(a) == F.col(f"__{b}") for a, b in zip(key.columns, key.references, strict=True)], "left_anti").take(1):
                raise DialectError("23503", f"{self.name} is still referenced from {child.name}")

    def _returned(self, df: DataFrame, returning: Sequence[Column | str] | None) -> DataFrame | None:
        return None if returning is None else df.select(*returning)

    # ---- statements

    def insert(self, source: DataFrame, columns: Sequence[str] | None = None, conflict: str | None = None, update: dict[str, Column] | None = None, where: Column | None = None, order: Column | None = None, returning: Sequence[Column | str] | None = None) -> DataFrame | None:
        """INSERT.  conflict: None, 'nothing' or 'update'; the arbiter is the primary key.

        In update and where, the table's columns go by their names and the proposed row's as ``excluded_<name>``.  Of source
        rows with one key the first by ``order`` counts; for 'update', a second one is an error, as in the dialect.
        """
        given = list(columns or self.columns)[: len(source.columns)]
        new = source.toDF(*given)
        for name in self.columns:
            if name not in given:
                default = self.defaults.get(name)
                if callable(default) and not isinstance(default, Column):
                    new = default(new, name)
                else:
                    new = new.withColumn(name, default if default is not None else F.lit(None).cast(spark_type(self.columns[name])))
        new = self._shaped(new)
        self._check_rows(new)
        if conflict is None:
            rows = self.rows.unionByName(new)
            self._check_keys(rows, new, self.rows)
            self.rows = rows
            return self._returned(new, returning)
        key = list(self.primary_key)
        if not key:
            raise DialectError("42P10", "ON CONFLICT needs a primary key")
        if conflict == "nothing":
            place = F.row_number().over(Window.partitionBy(*key).orderBy(order if order is not None else F.monotonically_increasing_id()))
            once = new.withColumn("__place", place).filter("__place = 1").drop("__place")
            added = once.join(self.rows.select(*key), key, "left_anti").select(*self.columns)
            rows = self.rows.unionByName(added)
            self._check_keys(rows, added, self.rows)
            self.rows = rows
            return self._returned(added, returning)
        if new.groupBy(*key).count().filter("count > 1").take(1):
            raise DialectError("21000", "ON CONFLICT DO UPDATE cannot affect a row a second time")
        proposed = new.select(*(F.col(c).alias(f"excluded_{c}") for c in self.columns))
        on = [F.col(k) == F.col(f"excluded_{k}") for k in key]
        both = self.rows.withColumn("__old", F.lit(True)).join(proposed.withColumn("__new", F.lit(True)), on, "full")
        hit = F.col("__old") & F.col("__new") & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
        hit = F.coalesce(hit, F.lit(False))
        fresh = F.col("__old").isNull()
        out = both.select(
            *(F.when(fresh, F.col(f"excluded_{c}")).when(hit, (update or {}).get(c, F.col(c))).otherwise(F.col(c)).cast(spark_type(k)).alias(c) for c, k in self.columns.items()),
            (hit | fresh).alias("__changed"),
        )
        changed, rows = out.filter("__changed").select(*self.columns), out.select(*self.columns)
        self._check_rows(changed)
        self._check_keys(rows, changed, out.filter("NOT __changed").select(*self.columns))
        self._check_references(rows)
        self.rows = rows
        return self._returned(changed, returning)

    def _first_match(self, other: DataFrame | None, on: Column | None, order: Sequence[Column]) -> DataFrame:
        """The table's rows with __hit and, from other, the first match of each by order."""
        tagged = self.rows.withColumn("__row", F.monotonically_increasing_id()) if not self.primary_key else self.rows
        key = list(self.primary_key) or ["__row"]
        if other is None:
            return tagged.withColumn("__hit", F.coalesce(on, F.lit(False)) if on is not None else F.lit(True))
        # numbered before the join: without an order the first match is the first in other's own
        met = tagged.join(other.withColumn("__met", F.lit(True)).withColumn("__scanned", F.monotonically_increasing_id()), on, "left")
        place = F.row_number().over(Window.partitionBy(*(F.col(k) for k in key)).orderBy(*order, "__scanned"))
        return met.withColumn("__place", place).filter("__place = 1").withColumn("__hit", F.coalesce("__met", F.lit(False)))

    def update(self, changes: dict[str, Column], where: Column | None = None, source: DataFrame | None = None, order: Sequence[Column] = (), returning: Sequence[Column | str] | None = None) -> DataFrame | None:
        """UPDATE [... FROM source].  A row with several matches is updated once, by the first in order."""
        matched = self._first_match(source, where, order)
        out = matched.select(*(F.when(F.col("__hit"), changes[c].cast(spark_type(k))).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c, k in self.columns.items()), "__hit")
        changed, rows = out.filter("__hit").select(*self.columns), out.select(*self.columns)
        self._check_rows(changed)
        self._check_keys(rows, changed, out.filter("NOT __hit").select(*self.columns), set(changes))
        if any(set(changes) & set(key.references) for _, key in self.referenced_by):
            self._check_references(rows)
        self.rows = rows
        return self._returned(changed, returning)

    def delete(self, where: Column | None = None, using: DataFrame | None = None, order: Sequence[Column] = (), returning: Sequence[Column | str] | None = None) -> DataFrame | None:
        """DELETE [... USING using]."""
        matched = self._first_match(using, where, order)
        gone = matched.filter("__hit")
        rows = matched.filter("NOT __hit").select(*self.columns)
        self._check_references(rows)
        self.rows = rows
        return self._returned(gone, returning)

    def truncate(self) -> None:
        rows = self.rows.limit(0)
        self._check_references(rows)
        self.rows = rows

    # ---- definitions

    def add_column(self, name: str, kind: str, default: Column | None = None) -> None:
        self.columns[name] = kind
        self.rows = self.rows.withColumn(name, (default if default is not None else F.lit(None)).cast(spark_type(kind)))

    def drop_column(self, name: str) -> None:
        if name in self.primary_key or any(name in k for k in self.unique):
            raise DialectError("2BP01", f"a key of {self.name} needs column {name}")
        del self.columns[name]
        self.rows = self.rows.drop(name)

    def rename_column(self, old: str, new: str) -> None:
        self.columns = {new if c == old else c: k for c, k in self.columns.items()}
        self.primary_key = tuple(new if c == old else c for c in self.primary_key)
        self.unique = [tuple(new if c == old else c for c in k) for k in self.unique]
        self.not_null = {new if c == old else c for c in self.not_null}
        self.rows = self.rows.withColumnRenamed(old, new)

    def alter_type(self, name: str, kind: str) -> None:
        from corvane.functions.casts import cast

        made = cast(F.col(name), self.rows.schema[name].dataType, kind)
        self.columns[name] = kind
        self.rows = self.rows.withColumn(name, made)

    def add_primary_key(self, *columns: str) -> None:
        candidate = replace(self, primary_key=columns)
        candidate._check_rows(self.rows)
        candidate._check_keys(self.rows, self.rows.limit(0))
        self.primary_key = columns

    def add_unique(self, *columns: str) -> None:
        candidate = replace(self, unique=[*self.unique, columns])
        candidate._check_keys(self.rows, self.rows.limit(0))
        self.unique = candidate.unique

    def add_foreign_key(self, key: ForeignKey) -> None:
        candidate = replace(self, foreign_keys=[key])
        candidate._check_keys(self.rows, self.rows)
        self.foreign_keys.append(key)
        key.table.referenced_by.append((self, key))

    def drop_constraint(self, name: str) -> None:
        """By name: <table>_pkey, <table>_<columns>_key, a check's name, or a foreign key's."""
        if name == f"{self.name}_pkey" and self.primary_key:
            self.primary_key = ()
            return
        for key in self.unique:
            if name == f"{self.name}_{'_'.join(key)}_key":
                self.unique.remove(key)
                return
        if self.checks.pop(name, None) is not None:
            return
        for key in self.foreign_keys:
            if key.name == name:
                self.foreign_keys.remove(key)
                key.table.referenced_by.remove((self, key))
                return
        raise DialectError("42704", f"constraint {name} of {self.name} does not exist")
