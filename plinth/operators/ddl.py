"""Schemas, table versions and constraints. Constraints are kept in a registry and checked by queries: plain files enforce none."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Portable column types and Spark's.
TYPES: dict[str, T.DataType] = {
    "primary_key": T.IntegerType(), "big_primary_key": T.LongType(), "string": T.StringType(), "text": T.StringType(), "char": T.StringType(), "integer": T.IntegerType(), "big_integer": T.LongType(), "small_integer": T.ShortType(),
    "boolean": T.BooleanType(), "float": T.DoubleType(), "date": T.DateType(), "time": T.StringType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "json": T.StringType(), "uuid": T.StringType(), "jsonb": T.VariantType(),
    "serial": T.IntegerType(), "big_serial": T.LongType(), "binary": T.BinaryType(), "tiny_integer": T.ByteType(), "double": T.DoubleType(), "real": T.FloatType(),
}


@dataclass(frozen=True)
class ColumnSchema:
    kind: str
    precision: int | None = None
    scale: int = 0
    nullable: bool = True
    default: Any = None
    comment: str | None = None
    unique: bool = False

    @property
    def data_type(self) -> T.DataType:
        if self.kind == "decimal":
            return T.DecimalType(self.precision or 10, self.scale)
        if self.kind.startswith("array:"):
            return T.ArrayType(ColumnSchema(self.kind[6:]).data_type)
        return TYPES[self.kind]

    def not_null(self) -> ColumnSchema:
        return ColumnSchema(self.kind, self.precision, self.scale, False, self.default, self.comment, self.unique)


def schema_of(columns: dict[str, ColumnSchema | str]) -> T.StructType:
    out = []
    for name, given in columns.items():
        c = ColumnSchema(given) if isinstance(given, str) else given
        out.append(T.StructField(name, c.data_type, c.nullable and not c.kind.endswith("primary_key"), {"comment": c.comment} if c.comment else None))
    return T.StructType(out)


def create_table(spark: SparkSession, columns: dict[str, ColumnSchema | str]) -> DataFrame:
    return spark.createDataFrame([], schema_of(columns))


def add_column(df: DataFrame, name: str, kind: ColumnSchema | str) -> DataFrame:
    c = ColumnSchema(kind) if isinstance(kind, str) else kind
    return df.withColumn(name, F.lit(c.default).cast(c.data_type))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def alter_column(df: DataFrame, name: str, kind: ColumnSchema | str) -> DataFrame:
    c = ColumnSchema(kind) if isinstance(kind, str) else kind
    return df.withColumn(name, F.col(name).cast(c.data_type))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


@dataclass(frozen=True)
class Constraint:
    kind: str  # primary, unique, foreign, check, index
    name: str
    columns: tuple[str, ...] = ()
    expression: str | None = None
    ref_table: str | None = None
    ref_columns: tuple[str, ...] = ()
    include: tuple[str, ...] = ()


@dataclass
class Constraints:
    """Named constraints and indexes of tables. An index only says how a table should be laid out when it is written."""

    held: dict[str, dict[str, Constraint]] = field(default_factory=dict)

    def _add(self, table: str, c: Constraint) -> None:
        self.held.setdefault(table, {})[c.name] = c

    def add_primary_key(self, name: str, table: str, columns: Sequence[str]) -> None:
        self._add(table, Constraint("primary", name, tuple(columns)))

    def add_unique(self, name: str, table: str, columns: Sequence[str]) -> None:
        self._add(table, Constraint("unique", name, tuple(columns)))

    def add_check(self, name: str, table: str, expression: str) -> None:
        self._add(table, Constraint("check", name, (), expression))

    def add_foreign_key(self, name: str, table: str, columns: Sequence[str], ref_table: str, ref_columns: Sequence[str]) -> None:
        self._add(table, Constraint("foreign", name, tuple(columns), None, ref_table, tuple(ref_columns)))

    def create_index(self, name: str, table: str, columns: Sequence[str], unique: bool = False, where: str | None = None, include: Sequence[str] = ()) -> None:
        """`where`: only the rows that the index is about; `include`: columns read with it."""
        self._add(table, Constraint("unique" if unique else "index", name, tuple(columns), where, include=tuple(include)))

    def create_fulltext_index(self, name: str, table: str, columns: Sequence[str]) -> None:
        self._add(table, Constraint("fulltext", name, tuple(columns)))

    def create_spatial_index(self, name: str, table: str, columns: Sequence[str]) -> None:
        """Columns by which rows that lie close should be written close."""
        self._add(table, Constraint("spatial", name, tuple(columns)))

    def layout(self, table: str) -> dict[str, list[str]]:
        """What the indexes ask of the table's files: columns to sort by, those of the first index first, and columns for Bloom filters (unique keys)."""
        found = self.listed(table)
        sort = list(dict.fromkeys(k for c in found if c.kind in ("primary", "index", "spatial") for k in c.columns))
        return {"sort_by": sort, "bloom": list(dict.fromkeys(k for c in found if c.kind in ("primary", "unique") for k in c.columns))}

    def drop(self, name: str, table: str) -> None:
        self.held.get(table, {}).pop(name, None)

    def rename(self, old: str, table: str, new: str) -> None:
        c = self.held[table].pop(old)
        self._add(table, replace(c, name=new))

    def exists(self, name: str, table: str, kind: str | None = None) -> bool:
        c = self.held.get(table, {}).get(name)
        return c is not None and kind in (None, c.kind)

    def listed(self, table: str, kind: str | None = None) -> list[Constraint]:
        return [c for c in self.held.get(table, {}).values() if kind in (None, c.kind)]

    def violations(self, table: str, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """For each constraint, the rows or keys that break it."""
        df, out = frames[table], {}
        for c in self.listed(table):
            if c.kind in ("primary", "unique"):
                known = df.dropna(subset=list(c.columns)) if c.kind == "unique" else df
                known = known if c.expression is None else known.filter(c.expression)
                out[c.name] = known.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1 if c.kind == "unique" else (F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in c.columns], F.lit(False)))
            elif c.kind == "check":
                out[c.name] = df.filter(~F.coalesce(F.expr(c.expression), F.lit(True)))
            elif c.kind == "foreign":
                keys = frames[c.ref_table].select(*[F.col(r).alias(k) for k, r in zip(c.columns, c.ref_columns, strict=True)])
                out[c.name] = df.dropna(subset=list(c.columns)).join(keys, list(c.columns), "left_anti")
        return out


def write_laid_out(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Write so that filters prune: a folder for each partition value, rows in order within each file. Rows aren't moved first, so a large partition is written by all tasks that hold rows of it."""
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    df.write.partitionBy(*partition_by).parquet(path)
