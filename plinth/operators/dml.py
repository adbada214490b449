"""Changes of tables as functions from DataFrame to DataFrame: the new version of the table. Nothing is changed in place."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.aggregate import ordering
from ..functions.core import col, value

Keys = str | Sequence[str]


def _keys(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _rows(table: DataFrame, rows: Any) -> DataFrame:
    """Rows as a DataFrame with the table's columns; what a row doesn't give is null."""
    if isinstance(rows, DataFrame):
        given = rows
    else:
        listed = [rows] if isinstance(rows, dict) else list(rows)
        fields = [f for f in table.schema if any(f.name in r for r in listed)]
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        # Through Arrow, rows become a local relation, whose size the planner knows.
        given = table.sparkSession.createDataFrame(pa.Table.from_pylist([{f.name: r.get(f.name) for f in fields} for r in listed], to_arrow_schema(schema)), schema)
    return given.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])


def insert(table: DataFrame, rows: Any) -> DataFrame:
    """One row (dict), several, or a DataFrame."""
    return table.unionByName(_rows(table, rows))


insert_multi = insert


def insert_from(table: DataFrame, source: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """INSERT ... SELECT: columns by place, as many as named."""
    return table.unionByName(_rows(table, source.toDF(*(columns or table.columns))))


def replace(table: DataFrame, rows: Any, keys: Keys = "id") -> DataFrame:
    """Rows of the same key give way to the new ones."""
    new = _rows(table, rows)
    return table.join(new.select(*_keys(keys)).distinct(), _keys(keys), "left_anti").select(*table.columns).unionByName(new)


def _one_per_key(source: DataFrame, keys: list[str]) -> DataFrame:
    """The source's rows with a key, with an error if two share one: the target row could then get either."""
    several = F.raise_error(F.concat(F.lit("more than one source row for key "), F.concat_ws(",", *[F.col(f"`{k}`").cast("string") for k in keys])))
    rows = source.dropna(subset=keys).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct("*")).alias("__row"))
    return rows.select(F.when(F.col("__n") > 1, several.cast(rows.schema["__row"].dataType)).otherwise(F.col("__row")).alias("__row")).select("__row.*")


def _equal(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in keys])


def _assigned(name: str, how: Any) -> Column:
    """The new value of a target column: inc()/dec(), an expression over t. and s., or a literal."""
    if isinstance(how, tuple) and how[0] in ("inc", "dec"):
        return F.col(f"t.`{name}`") + F.lit(how[1]) if how[0] == "inc" else F.col(f"t.`{name}`") - F.lit(how[1])
    return value(how)


def upsert(table: DataFrame, rows: Any, on_duplicate: dict[str, Any] | Iterable[str], keys: Keys = "id") -> DataFrame:
    """Insert, or where the key is there update: the named columns from the new row, or by a map of column to inc(), dec(), literal or expression over t. (the table) and s. (the new row)."""
    sets = on_duplicate if isinstance(on_duplicate, dict) else {c: F.col(f"s.`{c}`") for c in on_duplicate}
    return merge(table, _rows(table, rows), keys, sets, True)


def merge(
    table: DataFrame,
    source: Any,
    keys: Keys,
    when_matched: dict[str, Any] | Iterable[str] | None = None,
    when_not_matched: bool | dict[str, Any] | Iterable[str] = (),
    delete_not_matched_by_source: bool = False,
    matched_if: str | Column | None = None,
) -> DataFrame:
    """MERGE by a left join of the table with the source, which the planner sends to every task where it is small: the table then stays where it is.

    Matched rows get the maps' values (names alone: the source's column) if `matched_if`, over t.
    and s., holds; unmatched source rows are inserted (True: the columns both have); unmatched
    target rows stay or go. Null keys match nothing. Two source rows of one key are an error.
    """
    names = _keys(keys)
    source = source if isinstance(source, DataFrame) else _rows(table, source)
    s = _one_per_key(source, names).withColumn("__s", F.lit(True)).alias("s")
    sets = when_matched if isinstance(when_matched, dict) else {c: F.col(f"s.`{c}`") for c in when_matched or ()}
    both = [c for c in table.columns if c in source.columns]
    puts = when_not_matched if isinstance(when_not_matched, dict) else {c: F.col(f"s.`{c}`") for c in (both if when_not_matched is True else when_not_matched or ())}
    matched = F.col("__s").isNotNull()
    applies = matched if matched_if is None else matched & F.coalesce(col(matched_if), F.lit(False))
    joined = table.alias("t").join(s, _equal(names), "inner" if delete_not_matched_by_source else "left")
    kept = joined.select(*[F.when(applies, _assigned(f.name, sets[f.name])).otherwise(F.col(f"t.`{f.name}`")).cast(f.dataType).alias(f.name) if f.name in sets else F.col(f"t.`{f.name}`") for f in table.schema])
    if not puts:
        return kept
    # The keys of both, no more of them than the source has: the source's other rows are looked for among these and not among the table's.
    met = table.alias("t").join(s.select(*names), _equal(names), "left_semi").select(*names).distinct().alias("m")
    new = source.alias("s").join(met, reduce(lambda a, b: a & b, [F.col(f"s.`{k}`") == F.col(f"m.`{k}`") for k in names]), "left_anti")
    return kept.unionByName(new.select(*[(_assigned(f.name, puts[f.name]) if f.name in puts else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]))


def update(table: DataFrame, sets: dict[str, Any], where: str | Column | None = None, limit: int | None = None, order: Sequence[Any] = ()) -> DataFrame:
    """Rows whose condition is unknown stay as they are.

    `limit` takes the first in `order` — names with or without a direction, nulls last ascending and
    first descending, or Columns — and, where these are equal, in the order of all columns; so it changes as
    many rows as it says, and of rows equal in all columns any.
    """
    hit = F.lit(True) if where is None else F.coalesce(col(where), F.lit(False))
    df = table.alias("t")
    if limit is None:
        return df.select(*_set(table, sets, hit))
    if not order:
        raise ValueError("a limit needs an order")
    plain = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in table.schema]
    by = [c.asc_nulls_last() for c in plain]
    first = df.filter(hit).orderBy(*[_ordered(o) for o in order], *by).limit(limit)
    digest = F.struct(F.xxhash64(*plain, *[c.isNull() for c in plain]), F.hash(*plain))  # rows of equal content
    # At most `limit` rows: so many of each content change.
    quota = first.select(digest.alias("__digest")).groupBy("__digest").agg(F.count(F.lit(1)).alias("__quota"))
    marked = df.select(F.struct("*").alias("__row"), digest.alias("__digest")).join(quota, "__digest", "left")
    rest = marked.filter("__quota IS NULL").select("__row.*")
    place = F.row_number().over(Window.partitionBy("__digest").orderBy("__digest"))
    some = marked.filter("__quota IS NOT NULL").withColumn("__hit", place <= F.col("__quota")).select("__row.*", "__hit").alias("t")
    return rest.unionByName(some.select(*_set(table, sets, F.col("__hit"))))


def _ordered(by: Any) -> Column:
    if isinstance(by, Column):
        return by
    name, _, way = by.rpartition(" ")
    return ordering(name, way) if way.upper() in ("ASC", "DESC") else ordering(by)


def _set(table: DataFrame, sets: dict[str, Any], hit: Column) -> list[Column]:
    return [F.when(hit, _assigned(f.name, sets[f.name])).otherwise(F.col(f"t.`{f.name}`")).cast(f.dataType).alias(f.name) if f.name in sets else F.col(f"t.`{f.name}`") for f in table.schema]


def update_join(table: DataFrame, other: DataFrame, on: Keys, sets: dict[str, Any], where: str | Column | None = None) -> DataFrame:
    """UPDATE ... FROM over an inner join: sets and where are over t. and s. Two partners for one row are an error."""
    names = _keys(on)
    s = _one_per_key(other, names).withColumn("__s", F.lit(True)).alias("s")
    joined = table.alias("t").join(s, _equal(names), "left")
    return joined.select(*_set(table, sets, F.col("__s").isNotNull() & (F.lit(True) if where is None else F.coalesce(col(where), F.lit(False)))))


def delete(table: DataFrame, where: str | Column) -> DataFrame:
    """Rows whose condition is unknown are kept."""
    return table.filter(~F.coalesce(col(where), F.lit(False)))


def delete_join(table: DataFrame, other: DataFrame, on: str | Column | Sequence[str], where: str | Column | None = None) -> DataFrame:
    """Rows with a partner in `other` go; `on` and `where` are over t. and s."""
    match = _equal(list(on)) if isinstance(on, (list, tuple)) else col(on)
    return table.alias("t").join(other.alias("s"), match if where is None else match & col(where), "left_anti").select("t.*")


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)
