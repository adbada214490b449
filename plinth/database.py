"""The catalog: named tables, and what all queries on them share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from .operators import ddl, dml
from .operators.lifecycle import Events, Migrations, Record, Transactions
from .operators.query import Query
from .operators.services import Advice, Cache, Profiler
from .sources import files


class Database(Transactions):
    """Tables by name: DataFrames, paths of Parquet, or what the session's catalog has. Opening one runs nothing."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | str] | None = None, folder: str | None = None, prefix: str = ""):
        self.spark, self.tables, self.folder, self.prefix = spark, dict(tables or {}), folder, prefix
        self.macros: dict[str, Callable[..., Query]] = {}
        self.scopes: dict[str, Callable[[Query], Query]] = {}
        self.named_scopes: dict[str, Callable[..., Query]] = {}
        self.plugins: dict[str, Any] = {}
        self.cache, self.profiler, self.advice, self.events = Cache(), Profiler(), Advice(), Events()
        self.migrations = Migrations(self)
        self.constraints = ddl.Constraints()
        self.held: list[DataFrame] = []
        self.relations: dict[str, dict[str, tuple]] = {}

    def frame(self, name: str) -> DataFrame:
        found = self.tables.get(name)
        if isinstance(found, DataFrame):
            return found
        if found or self.folder and not self.spark.catalog.tableExists(name):
            return self.spark.read.parquet(found or f"{self.folder}/{name}.parquet")
        return self.spark.table(name)

    def register_views(self, more: dict[str, DataFrame] | None = None) -> None:
        """Make the tables visible to SQL text."""
        for name, table in (self.tables | (more or {})).items():
            (table if isinstance(table, DataFrame) else self.spark.read.parquet(table)).createOrReplaceTempView(name)

    def materialized(self, df: DataFrame) -> DataFrame:
        self.held.append(df.cache())
        return self.held[-1]

    def release(self) -> None:
        """Give back what with_materialized() and cache() keep."""
        for df in self.held:
            df.unpersist()
        self.held.clear()
        self.cache.invalidate()

    def put(self, name: str, df: DataFrame) -> None:
        """A new version of a table."""
        self.tables[name] = df

    def find(self, table: Any = None) -> Query:
        query = Query(self)
        if self.prefix:
            query = query.prefix(self.prefix)
        return query if table is None else query.from_(table)

    table = find

    def table_exists(self, name: str) -> bool:
        return name in self.tables or self.spark.catalog.tableExists(name)

    # ---- schemas of tables that are held by name

    def create_table(self, name: str, columns: dict[str, Any], if_not_exists: bool = False) -> DataFrame:
        if self.table_exists(name):
            if if_not_exists:
                return self.frame(name)
            raise ValueError(f"table {name} exists")
        self.put(name, ddl.create_table(self.spark, columns))
        return self.tables[name]

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        """Takes the table out of the catalog; its files stay."""
        if name not in self.tables and not if_exists:
            raise ValueError(f"no table {name}")
        self.tables.pop(name, None)

    def rename_table(self, name: str, new: str) -> None:
        self.tables[new] = self.tables.pop(name)

    def truncate_table(self, name: str) -> None:
        self.put(name, self.frame(name).limit(0))

    def add_column(self, table: str, name: str, kind: Any) -> None:
        self.put(table, ddl.add_column(self.frame(table), name, kind))

    def drop_column(self, table: str, name: str) -> None:
        self.put(table, ddl.drop_column(self.frame(table), name))

    def alter_column(self, table: str, name: str, kind: Any) -> None:
        self.put(table, ddl.alter_column(self.frame(table), name, kind))

    def rename_column(self, table: str, old: str, new: str) -> None:
        self.put(table, ddl.rename_column(self.frame(table), old, new))

    def violations(self, table: str) -> dict[str, DataFrame]:
        """For each constraint of the table, the rows or keys that break it."""
        others = {c.ref_table for c in self.constraints.listed(table, "foreign")}
        return self.constraints.violations(table, {name: self.frame(name) for name in {table, *others}})

    # ---- SQL text

    def raw_query(self, sql: str, params: dict | list | None = None) -> DataFrame:
        """SQL with :named or ? parameters, bound by Spark and never pasted in."""
        self.register_views()
        return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)

    fetch_all = execute_statement = raw_query

    def raw_query_one(self, sql: str, params: dict | list | None = None) -> Row | None:
        return self.raw_query(sql, params).first()

    fetch = raw_query_one

    def raw_query_value(self, sql: str, params: dict | list | None = None) -> Any:
        row = self.raw_query_one(sql, params)
        return None if row is None else row[0]

    fetch_column = raw_query_value

    # ---- rows as objects

    def record(self, table: str, values: dict[str, Any], key: str = "id") -> Record:
        """A new row, written by its save()."""
        return Record(self, table, values, key)

    def find_record(self, table: str, value: Any, key: str = "id") -> Record | None:
        return Record.find(self, table, value, key)

    # ---- relations

    def relate(self, table: str, name: str, kind: str, other: str, **given: Any) -> None:
        """A relation for Query.with_related(): has_one, has_many, belongs_to or has_many_through, with that function's keys (and `junction`, a table's name)."""
        self.relations.setdefault(table, {})[name] = (kind, other, given)

    # ---- whole catalog

    def seed(self, name: str, source: Any, columns: Any = None) -> DataFrame:
        """Fill a table from another one's rows, by place."""
        found = self.frame(source) if isinstance(source, str) else source
        self.put(name, dml.insert_from(self.frame(name), found, columns))
        return self.tables[name]

    def dump(self, path: str, tables: Any = None) -> list[str]:
        """Write tables (all without names) below a folder; gives their names."""
        names = sorted(tables or self.tables)
        for name in names:
            files.dump(self.frame(name), f"{path}/{name}.parquet")
        return names

    def restore(self, path: str, tables: Any) -> None:
        for name in tables:
            self.put(name, files.restore(self.spark, f"{path}/{name}.parquet"))

    # ---- extension

    def macro(self, name: str, function: Callable[..., Query]) -> None:
        self.macros[name] = function

    def has_macro(self, name: str) -> bool:
        return name in self.macros

    def add_scope(self, name: str, scope: Callable[[Query], Query]) -> None:
        """Applied to every query that doesn't turn it off."""
        self.scopes[name] = scope

    def remove_scope(self, name: str) -> None:
        self.scopes.pop(name, None)

    def name_scope(self, name: str, scope: Callable[..., Query]) -> None:
        self.named_scopes[name] = scope

    def register_plugin(self, plugin: Any) -> None:
        """An object with register(db)."""
        plugin.register(self)
        self.plugins[type(plugin).__name__] = plugin

    def config(self, key: str, value: Any) -> None:
        self.spark.conf.set(key, value)
