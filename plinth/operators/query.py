"""An immutable fluent query over DataFrames. Every method gives a new query; get() gives its DataFrame, and Catalyst plans it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from types import SimpleNamespace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import json as js
from ..functions.aggregate import Aggregate, Windowed, ordering
from ..functions.core import _bound, col
from . import dml, paginate, relations
from .predicates import Conditions, Grammar, condition, frame_of, is_query

if TYPE_CHECKING:
    from ..database import Database

JOINS = {"INNER": "inner", "LEFT": "left", "LEFT OUTER": "left", "RIGHT": "right", "RIGHT OUTER": "right", "FULL": "full", "FULL OUTER": "full", "CROSS": "cross", "SEMI": "left_semi", "LEFT SEMI": "left_semi", "ANTI": "left_anti", "LEFT ANTI": "left_anti"}


@dataclass(frozen=True)
class State:
    source: Any = None
    prefix: str = ""
    joins: tuple = ()
    items: tuple = ()
    where: Conditions = Conditions()
    groups: tuple = ()
    grouping: str = "groupBy"
    having: tuple = ()
    distinct: bool = False
    distinct_on: tuple = ()
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    sets: tuple = ()
    ctes: tuple = ()
    hints: tuple = ()
    index: str | None = None
    cached: tuple | None = None
    duplicates: tuple | None = None
    related: tuple = ()
    objects: bool = False
    scopes_off: Any = ()


class Query(Grammar):
    def __init__(self, db: Database, state: State | None = None):
        self.db, self.state = db, state or State()

    def _with(self, **changes: Any) -> Query:
        return Query(self.db, replace(self.state, **changes))

    def __getattr__(self, name: str) -> Callable[..., Query]:
        macro = self.db.macros.get(name) if not name.startswith("_") and "db" in self.__dict__ else None
        if macro is None:
            raise AttributeError(name)
        return lambda *args, **given: macro(self, *args, **given)

    # ---- source and projection

    def from_(self, table: Any) -> Query:
        """A table name, with or without an alias (`t a`, `t AS a`), a DataFrame or a query."""
        return self._with(source=table)

    table = from_

    def prefix(self, prefix: str) -> Query:
        return self._with(prefix=prefix)

    def select(self, *items: Any) -> Query:
        """Columns or expressions, also several in one string; dicts of alias to expression; Columns; aggregates and window functions; queries, which become scalar subqueries. Calls add up; none means all columns."""
        return self._with(items=(*self.state.items, *_items(items)))

    def select_json(self, column: str, path: js.Path, alias: str | None = None, as_text: bool = True) -> Query:
        return self.select(js.json_get(column, path, as_text).alias(alias or "_".join(js.parts(path))))

    def distinct(self) -> Query:
        return self._with(distinct=True)

    def distinct_on(self, *columns: Any) -> Query:
        """The first row of each key, in the query's order."""
        return self._with(distinct_on=tuple(c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])))

    def option(self, *hints: str) -> Query:
        """Planner hints such as "broadcast(a)" by name; those that Spark doesn't know it passes over."""
        return self._with(hints=(*self.state.hints, *hints))

    def index(self, column: str = "id") -> Query:
        """rows() then gives a dict by this column: later rows win, null keys are left out."""
        return self._with(index=column)

    # ---- conditions

    def _where(self, connector: str, what: Column) -> Query:
        return self._with(where=self.state.where.add(connector, what))

    def having(self, left: Any, right: Any = ..., operator: str = "=") -> Query:
        """After grouping. A name means a selected alias if there is one."""
        return self._with(having=(*self.state.having, ("AND", left, right, operator)))

    def or_having(self, left: Any, right: Any = ..., operator: str = "=") -> Query:
        return self._with(having=(*self.state.having, ("OR", left, right, operator)))

    def having_raw(self, sql: str, params: dict[str, Any] | None = None) -> Query:
        return self.having(_bound(sql, params) if params else F.expr(sql))

    # ---- joins

    def join(self, table: Any, on: Any = None, kind: str = "INNER") -> Query:
        how = " ".join(kind.upper().removesuffix("JOIN").split())
        if how not in JOINS:
            raise ValueError(f"unknown join {kind!r}")
        return self._with(joins=(*self.state.joins, (JOINS[how], table, on, False)))

    def inner_join(self, table: Any, on: Any) -> Query:
        return self.join(table, on)

    def left_join(self, table: Any, on: Any) -> Query:
        return self.join(table, on, "LEFT")

    def right_join(self, table: Any, on: Any) -> Query:
        return self.join(table, on, "RIGHT")

    def full_join(self, table: Any, on: Any) -> Query:
        return self.join(table, on, "FULL")

    def cross_join(self, table: Any) -> Query:
        return self.join(table, None, "CROSS")

    def semi_join(self, table: Any, on: Any) -> Query:
        return self.join(table, on, "SEMI")

    def anti_join(self, table: Any, on: Any) -> Query:
        return self.join(table, on, "ANTI")

    def lateral_join(self, query: Any, on: Any = None, kind: str = "LEFT", alias: str = "lateral") -> Query:
        """A subquery or table function that may use outer columns, as F.col(...).outer()."""
        how = JOINS[kind.upper()]
        return self._with(joins=(*self.state.joins, (how, (query, alias), on, True)))

    # ---- grouping, order, limits

    def group_by(self, *columns: Any) -> Query:
        """A second call replaces the first."""
        return self._with(groups=tuple(_items(columns)), grouping="groupBy")

    def rollup(self, *columns: Any) -> Query:
        return self._with(groups=tuple(_items(columns)), grouping="rollup")

    def cube(self, *columns: Any) -> Query:
        return self._with(groups=tuple(_items(columns)), grouping="cube")

    def order_by(self, by: Any, direction: str = "ASC") -> Query:
        """A column, an expression, "a ASC, b DESC", a list, or a dict of column to direction. Nulls come last ascending, first descending."""
        return self._with(order=(*self.state.order, *_orders(by, direction)))

    def order_by_json(self, column: str, path: js.Path, direction: str = "ASC") -> Query:
        return self.order_by(js.json_order(column, path), direction)

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    # ---- set operations and common tables

    def union(self, query: Any) -> Query:
        return self._with(sets=(*self.state.sets, ("union", query)))

    def union_all(self, query: Any) -> Query:
        return self._with(sets=(*self.state.sets, ("union_all", query)))

    def intersect(self, query: Any) -> Query:
        return self._with(sets=(*self.state.sets, ("intersect", query)))

    def except_(self, query: Any) -> Query:
        return self._with(sets=(*self.state.sets, ("except", query)))

    def with_(self, name: str, query: Any, columns: Iterable[str] = ()) -> Query:
        """A named table for this query: a query, a DataFrame, a function or SQL text."""
        return self._with(ctes=(*self.state.ctes, (name, query, tuple(columns), False)))

    def with_materialized(self, name: str, query: Any, columns: Iterable[str] = ()) -> Query:
        """As with_(), computed once and kept where memory or disk allows, until Database.release()."""
        return self._with(ctes=(*self.state.ctes, (name, query, tuple(columns), True)))

    def with_recursive(self, name: str, sql: str, columns: Iterable[str] = (), most_levels: int = 100) -> Query:
        """SQL text of the form `anchor UNION ALL step`."""
        return self._with(ctes=(*self.state.ctes, (name, ("recursive", sql, most_levels), tuple(columns), False)))

    # ---- scopes

    def scope(self, function: Callable[..., Query] | str, *args: Any) -> Query:
        return (self.db.named_scopes[function] if isinstance(function, str) else function)(self, *args)

    def without_global_scope(self, *names: str) -> Query:
        return self._with(scopes_off=(*self.state.scopes_off, *names))

    def without_global_scopes(self) -> Query:
        return self._with(scopes_off=None)

    def cache(self, key: str | None = None, ttl: float | None = None) -> Query:
        """Keep the result, for `ttl` seconds or until a table that the query names is changed."""
        return self._with(cached=(key, ttl))

    def no_cache(self) -> Query:
        return self._with(cached=None)

    # ---- the plan

    def _resolve(self, table: Any, tables: dict[str, DataFrame]) -> DataFrame:
        if isinstance(table, tuple):
            return frame_of(table[0]).alias(table[1])
        if not isinstance(table, str):
            return frame_of(table)
        words = table.split()
        name, alias = words[0], words[-1]
        if len(words) not in (1, 2) and not (len(words) == 3 and words[1].upper() == "AS"):
            raise ValueError(f"not a table: {table!r}")
        name = name if name in tables else self.state.prefix + name
        found = tables[name] if name in tables else self.db.frame(name)
        return found.alias(alias.rpartition(".")[2])

    def _tables(self) -> dict[str, DataFrame]:
        tables: dict[str, DataFrame] = {}
        for name, query, columns, keep in self.state.ctes:
            if isinstance(query, tuple):
                self.db.register_views(tables)
                heads = f"({', '.join(columns)})" if columns else ""
                frame = self.db.spark.sql(f"WITH RECURSIVE {name}{heads} MAX RECURSION LEVEL {query[2]} AS ({query[1]}) SELECT * FROM {name}")
            elif isinstance(query, str):
                self.db.register_views(tables)
                frame = self.db.spark.sql(query)
            elif isinstance(query, Query):
                frame = query._plan(tables)
            else:
                frame = frame_of(query)
            if columns and not isinstance(query, tuple):
                frame = frame.toDF(*columns)
            tables[name] = self.db.materialized(frame) if keep else frame
        return tables

    def get(self) -> DataFrame:
        query = self
        if self.state.scopes_off is not None:
            for name, scope in self.db.scopes.items():
                if name not in self.state.scopes_off:
                    query = scope(query)
        frame = query._plan({})
        self.db.events.emit("query", query=self, frame=frame)
        if self.state.related:
            frame = relations.loaded(self.db, self.state.prefix + self.state.source.split()[0], frame, self.state.related)
        return frame if self.state.cached is None else self.db.cache.keep(frame, self.state.cached[0], self.state.cached[1], self.table_names())

    def table_names(self) -> set[str]:
        """The catalog's tables that this query and those inside it name."""
        s = self.state
        found: set[str] = set()
        own = {c[0] for c in s.ctes}
        for given in (s.source, *(j[1] for j in s.joins), *(c[1] for c in s.ctes), *(q for _, q in s.sets)):
            given = given[0] if isinstance(given, tuple) else given
            if isinstance(given, Query):
                found |= given.table_names()
            elif isinstance(given, str) and given.split()[0] not in own and len(given.split()) < 4:
                found.add(s.prefix + given.split()[0])
        return found

    def _plan(self, outer: dict[str, DataFrame]) -> DataFrame:
        s = self.state
        tables = outer | self._tables()
        df = self._resolve(s.source, tables)
        for hint in s.hints:
            name, _, rest = hint.partition("(")
            df = df.hint(name, *[x.strip() for x in rest.rstrip(")").split(",") if x.strip()])
        for how, table, on, lateral in s.joins:
            other = self._resolve(table, tables)
            on = F.expr(on) if isinstance(on, str) else on
            if lateral:
                df = df.lateralJoin(other, on, how)
            elif how == "cross":
                df = df.crossJoin(other) if on is None else df.crossJoin(other).filter(on)
            else:
                df = df.join(other, on, how)
        kept = s.where.column()
        if kept is not None:
            df = df.filter(kept)
        df = self._project(df)
        if s.distinct:
            df = df.distinct()
        df = _combined(df, [(op, q) for op, q in s.sets])
        if s.order:
            df = df.orderBy(*s.order)
        if s.offset:
            df = df.offset(s.offset)
        return df if s.limit is None else df.limit(s.limit)

    def _project(self, df: DataFrame) -> DataFrame:
        s = self.state
        columns = [_column(x) for x in s.items]
        grouped = s.groups or s.having or any(isinstance(x, Aggregate) for x in s.items)
        if not grouped:
            if s.distinct_on:
                place = F.row_number().over(Window.partitionBy(*map(col, s.distinct_on)).orderBy(*(s.order or map(col, s.distinct_on))))
                df = df.withColumn("__place", place).filter("__place = 1").drop("__place")
            return df.select(*columns) if columns else df
        keys = [_column(x) for x in s.groups]
        names = {x for x in s.groups if isinstance(x, str)} | {x.rpartition(".")[2] for x in s.groups if isinstance(x, str)}
        is_key = [isinstance(x, str) and x in names for x in s.items]
        outputs, final = [], []
        for x, c, key in zip(s.items, columns, is_key, strict=True):
            if key:
                final.append(F.col(f"`{x.rpartition('.')[2]}`"))
            else:
                name = _name(x)
                outputs.append(c)
                final.append(F.col(f"`{name}`") if name else None)
        aliases = {n for x in s.items if (n := _name(x))}
        hidden, tests = [], Conditions()
        for connector, left, right, operator in s.having:
            if isinstance(left, str) and left in aliases | names:
                tests = tests.add(connector, F.col(left).isNull() if right is ... else condition(left, right, operator))
                continue
            name = f"__having{len(hidden)}"
            if right is ...:
                hidden.append(_column(left).alias(name))
                tests = tests.add(connector, F.col(name))
            else:
                hidden.append(_column(left).alias(name))
                tests = tests.add(connector, condition(name, right, operator))
        aggregated = getattr(df, s.grouping)(*keys).agg(*(outputs + hidden or [F.count(F.lit(1)).alias("__n")]))
        kept = tests.column()
        if kept is not None:
            aggregated = aggregated.filter(kept)
        if not final or any(c is None for c in final):
            return aggregated.drop("__n", *[f"__having{i}" for i in range(len(hidden))])
        return aggregated.select(*final)

    # ---- results

    def as_object(self) -> Query:
        """rows() then gives plain objects with the columns as attributes."""
        return self._with(objects=True)

    def rows(self) -> list[Row] | dict[Any, Row]:
        found = self.get().collect()
        if self.state.objects:
            found = [SimpleNamespace(**r.asDict()) for r in found]
            return found if self.state.index is None else {k: r for r in found if (k := getattr(r, self.state.index)) is not None}
        return found if self.state.index is None else {r[self.state.index]: r for r in found if r[self.state.index] is not None}

    def get_one(self) -> Row | None:
        return self.limit(1).get().first()

    def find_one(self, key: Any, column: str = "id") -> Row | None:
        """The row of a key, or of a dict of columns and values."""
        return self._keyed(key, column).get_one()

    def find_all(self, key: Any = None, column: str = "id") -> list[Row]:
        """The rows of a key, of any of a list of keys, or of a dict; all without one."""
        return self._keyed(key, column).get().collect()

    def _keyed(self, key: Any, column: str) -> Query:
        return self if key is None else self.where(key) if isinstance(key, dict) else self.where_in(column, key) if isinstance(key, (list, tuple)) else self.where(column, key)

    def with_related(self, *paths: str) -> Query:
        """Relations defined by Database.relate(), each as a column; a dotted path goes through relations of the related rows."""
        return self._with(related=(*self.state.related, *paths))

    def get_column(self, name: str | None = None) -> list | dict:
        found = self.rows()
        pick = (lambda r: r[name]) if name else (lambda r: r[0])
        return {k: pick(r) for k, r in found.items()} if isinstance(found, dict) else [pick(r) for r in found]

    def get_value(self) -> Any:
        row = self.get_one()
        return row[0] if row is not None and len(row) == 1 else None

    def first(self, by: Any = "id") -> Row | None:
        return self._with(order=()).order_by(by).get_one()

    def last(self, by: Any = "id") -> Row | None:
        return self._with(order=()).order_by(by, "DESC").get_one()

    def exists(self) -> bool:
        return not self.limit(1).get().isEmpty()

    def not_exists(self) -> bool:
        return not self.exists()

    def count(self) -> int:
        return self._with(order=()).get().count()

    def each(self) -> Iterator[Row]:
        """Rows one by one; the driver holds one partition at a time, and the next one is on its way."""
        return self.get().toLocalIterator(prefetchPartitions=True)

    stream = each

    def batch(self, size: int = 100) -> Iterator[list[Row]]:
        held: list[Row] = []
        for row in self.each():
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def paginate(self, per_page: int = 15, page: int = 1) -> paginate.Page:
        return paginate.paginate(self, per_page, page)

    def simple_paginate(self, per_page: int = 15, page: int = 1) -> paginate.SimplePage:
        return paginate.simple_paginate(self, per_page, page)

    def cursor_paginate(self, per_page: int = 15, cursor: Any = None) -> paginate.CursorPage:
        return paginate.cursor_paginate(self, per_page, cursor)

    # ---- changes: each puts a new version of the table into the catalog and gives it

    def _changed(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if not isinstance(self.state.source, str) or self.state.joins:
            raise ValueError("changes are of one named table; dml.update_join and dml.delete_join take another")
        name = self.state.prefix + self.state.source.split()[0]
        new = change(self.db.frame(name))
        self.db.put(name, new)
        self.db.cache.invalidate_tables(name)
        self.db.events.emit("change", table=name, frame=new)
        return new

    def on_duplicate(self, sets: dict[str, Any] | Iterable[str], keys: Any = "id") -> Query:
        """What a following insert does with rows whose key is there."""
        return self._with(duplicates=(sets, keys))

    def insert(self, rows: Any) -> DataFrame:
        if self.state.duplicates:
            return self._changed(lambda t: dml.upsert(t, rows, *self.state.duplicates))
        return self._changed(lambda t: dml.insert(t, rows))

    insert_multi = insert

    def insert_from(self, source: Any, columns: list[str] | None = None) -> DataFrame:
        found = self.db.frame(source) if isinstance(source, str) else frame_of(source)
        return self._changed(lambda t: dml.insert_from(t, found, columns))

    def replace(self, rows: Any, keys: Any = "id") -> DataFrame:
        return self._changed(lambda t: dml.replace(t, rows, keys))

    replace_multi = replace

    def update(self, sets: dict[str, Any]) -> DataFrame:
        """Rows under the conditions; with limit(), the first in the query's order."""
        return self._changed(lambda t: dml.update(t, sets, self.state.where.column(), self.state.limit, self.state.order))

    def delete(self) -> DataFrame:
        kept = self.state.where.column()
        return self._changed(lambda t: dml.truncate(t) if kept is None else dml.delete(t, kept))

    def truncate(self) -> DataFrame:
        return self._changed(dml.truncate)

    def merge(self, source: Any, keys: Any, when_matched: Any = None, when_not_matched: Any = (), delete_not_matched_by_source: bool = False, matched_if: Any = None) -> DataFrame:
        found = self.db.frame(source) if isinstance(source, str) else frame_of(source)
        return self._changed(lambda t: dml.merge(t, found, keys, when_matched, when_not_matched, delete_not_matched_by_source, matched_if))

    def describe(self) -> list[tuple[str, str, bool]]:
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.get().schema]

    def explain(self, mode: str = "formatted") -> str:
        return self.db.advice.plan(self.get(), mode)

    def explain_analyze(self) -> str:
        """The plan after it has run, as adaptive execution has left it, and what its nodes have counted."""
        frame = self.get()
        counted = self.db.advice.measured(frame)
        return self.db.advice.plan(frame, "formatted") + "\n" + "\n".join(f"{node}: {metric} {value}" for node, metric, value in counted if value > 0)

    def explain_advice(self) -> list:
        return self.db.advice.advise(self.get())

    def to_sql(self) -> str:
        """The analysed plan: queries aren't made of SQL text here."""
        return self.db.advice.plan(self.get(), "extended")


def _items(items: Iterable[Any]) -> list[Any]:
    out: list[Any] = []
    for x in items:
        if isinstance(x, (list, tuple)):
            out += _items(x)
        elif isinstance(x, dict):
            out += [(_column(v).alias(k), k) for k, v in x.items()]
        elif isinstance(x, str):
            out += _split(x)
        else:
            out.append(x)
    return out


def _split(text: str) -> list[str]:
    """Cut at the commas outside parentheses and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in [*out, text[start:].strip()] if x]


def _column(x: Any) -> Column:
    if isinstance(x, tuple):
        return x[0]
    if isinstance(x, (Aggregate, Windowed)):
        return x.column
    if isinstance(x, str):
        return F.col(x) if x.endswith("*") and "(" not in x else F.expr(x)
    if is_query(x):
        return frame_of(x).scalar()
    return col(x)


def _name(x: Any) -> str | None:
    """The name of a selected item if it is known without analysis."""
    if isinstance(x, tuple):
        return x[1]
    if isinstance(x, str):
        words = x.split()
        if len(words) > 2 and words[-2].upper() == "AS":
            return words[-1].strip("`")
        return x.rpartition(".")[2] if x.replace(".", "").replace("_", "").isalnum() else None
    if isinstance(x, Column):
        alias = re.search(r" AS `?(\w+)`?'>$", str(x))
        return alias[1] if alias else None
    return None


def _orders(by: Any, direction: str) -> list[Column]:
    if isinstance(by, dict):
        return [ordering(k, v) for k, v in by.items()]
    if isinstance(by, (list, tuple)):
        return [o for x in by for o in _orders(x, direction)]
    if isinstance(by, str):
        out = []
        for part in _split(by):
            words = part.rsplit(None, 1)
            out.append(ordering(words[0], words[1]) if len(words) == 2 and words[1].upper() in ("ASC", "DESC") else ordering(part, direction))
        return out
    if isinstance(by, (Aggregate, Windowed)):
        by = by.column
    return [ordering(by, direction)]


def _combined(first: DataFrame, sets: list[tuple[str, Any]]) -> DataFrame:
    """Set operations from left to right, INTERSECT before the others."""
    terms, ops = [first], []
    for op, query in sets:
        frame = frame_of(query)
        if op == "intersect":
            terms[-1] = terms[-1].intersect(frame)
        else:
            ops.append(op)
            terms.append(frame)
    out = terms[0]
    for op, frame in zip(ops, terms[1:], strict=True):
        out = out.union(frame) if op == "union_all" else out.union(frame).distinct() if op == "union" else out.subtract(frame)
    return out
