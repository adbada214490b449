"""The condition grammar shared by where, having and aggregate filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as js
from ..functions.aggregate import Aggregate, Windowed, compare
from ..functions.core import _bound, col, value


def frame_of(query: Any) -> DataFrame:
    """The DataFrame of a query, a DataFrame, or a function that gives either."""
    if isinstance(query, DataFrame):
        return query
    return query.get() if isinstance(query, Grammar) else frame_of(query())


def is_query(x: Any) -> bool:
    if isinstance(x, (Column, Aggregate, Windowed)):
        return False
    return isinstance(x, (DataFrame, Grammar)) or callable(x)


def condition(left: Any, right: Any, operator: str) -> Column:
    """One comparison. Right sides may be values, lists, Columns or subqueries."""
    op = " ".join(operator.upper().split())
    x = left.column if isinstance(left, (Aggregate, Windowed)) else col(left)
    if op in ("IN", "NOT IN"):
        if is_query(right):
            found = x.isin(frame_of(right))  # NOT IN of this is null-aware, as in SQL
        else:
            given = list(right)
            if not given:
                return F.lit(op == "NOT IN")
            found = x.isin(*given)
        return found if op == "IN" else ~found
    if op in ("BETWEEN", "NOT BETWEEN"):
        if len(right) != 2:
            raise ValueError("BETWEEN takes two values")
        found = x.between(value(right[0]), value(right[1]))
        return found if op == "BETWEEN" else ~found
    if op in ("LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE"):
        found = x.ilike(right) if "ILIKE" in op else x.like(right)
        return ~found if op.startswith("NOT") else found
    if op in ("EXISTS", "NOT EXISTS"):
        found = frame_of(right).exists()
        return ~found if op.startswith("NOT") else found
    if op in ("IS", "IS NOT") or right is None and op in ("=", "!=", "<>"):
        if right is None:
            return x.isNull() if op in ("IS", "=") else x.isNotNull()
        found = x.eqNullSafe(value(right))
        return found if op == "IS" else ~found
    if is_query(right):
        return compare(x, op, frame_of(right).scalar())
    return compare(x, op, right.column if isinstance(right, Aggregate) else value(right))


@dataclass(frozen=True)
class Conditions:
    """A flat list of conditions with AND or OR before each. AND binds closer, as in SQL text."""

    items: tuple[tuple[str, Column], ...] = field(default=())

    def add(self, connector: str, what: Column) -> Conditions:
        return replace(self, items=(*self.items, (connector, what)))

    def column(self) -> Column | None:
        if not self.items:
            return None
        groups: list[list[Column]] = []
        for connector, what in self.items:
            if connector == "OR" or not groups:
                groups.append([what])
            else:
                groups[-1].append(what)
        return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in groups))


class Grammar:
    """The where methods; a class that has `_where(connector, condition)` gets them all."""

    def _where(self, connector: str, what: Column) -> Any:
        raise NotImplementedError

    def _given(self, connector: str, left: Any, right: Any, operator: str) -> Any:
        if isinstance(left, dict):
            out = self
            for k, v in left.items():
                out = out._where(connector, condition(k, v, "IN" if isinstance(v, (list, tuple)) else "="))
                connector = "AND" if connector == "OR" else connector
            return out
        if callable(left) and not isinstance(left, (Column, Aggregate, Windowed)):
            group = left(Group()).conditions.column()
            return self if group is None else self._where(connector, group)
        if isinstance(left, Column) and right is _UNSET:
            return self._where(connector, left)
        if isinstance(left, str) and right is _UNSET:
            if any(c in left for c in " =<>!("):
                return self._where(connector, F.expr(left))  # raw text
            return self._where(connector, col(left).isNull() if operator == "=" else col(left).isNotNull())
        return self._where(connector, condition(left, right, operator))

    def where(self, left: Any, right: Any = ..., operator: str = "=") -> Any:
        return self._given("AND", left, _UNSET if right is ... else right, operator)

    def and_where(self, left: Any, right: Any = ..., operator: str = "=") -> Any:
        return self.where(left, right, operator)

    def or_where(self, left: Any, right: Any = ..., operator: str = "=") -> Any:
        return self._given("OR", left, _UNSET if right is ... else right, operator)

    def where_raw(self, sql: str, params: dict[str, Any] | None = None) -> Any:
        return self._where("AND", _bound(sql, params) if params else F.expr(sql))

    def where_column(self, a: str, operator: str, b: str, boolean: str = "AND") -> Any:
        return self._where(_connector(boolean), compare(col(a), operator, col(b)))

    def where_exists(self, query: Any) -> Any:
        return self._where("AND", frame_of(query).exists())

    def where_not_exists(self, query: Any) -> Any:
        return self._where("AND", ~frame_of(query).exists())

    def where_json_path(self, column: str, path: js.Path, operator: str, right: Any, boolean: str = "AND") -> Any:
        return self._where(_connector(boolean), js.json_compare(column, path, operator, right))

    def where_json_contains(self, column: str, right: Any, path: js.Path = None, boolean: str = "AND") -> Any:
        return self._where(_connector(boolean), js.json_contains(column, right, path))

    def where_json_exists(self, column: str, path: js.Path, boolean: str = "AND") -> Any:
        return self._where(_connector(boolean), js.json_exists(column, path))


def _connector(boolean: str) -> str:
    if boolean.upper() not in ("AND", "OR"):
        raise ValueError(f"unknown connector {boolean!r}")
    return boolean.upper()


#: The condition that each where_<name> makes of its column and arguments.
_SIMPLE: dict[str, Callable[..., Column]] = {
    "null": lambda c: condition(c, None, "IS"),
    "not_null": lambda c: condition(c, None, "IS NOT"),
    "in": lambda c, values: condition(c, values, "IN"),
    "not_in": lambda c, values: condition(c, values, "NOT IN"),
    "between": lambda c, low, high: condition(c, (low, high), "BETWEEN"),
    "not_between": lambda c, low, high: condition(c, (low, high), "NOT BETWEEN"),
}


def _method(make: Callable[..., Column], fixed: str | None) -> Callable:
    def plain(self: Grammar, column: str, *args: Any, boolean: str = "AND") -> Any:
        return self._where(fixed or _connector(boolean), make(column, *args))

    return plain


for _name, _make in _SIMPLE.items():
    setattr(Grammar, f"where_{_name}", _method(_make, None))
    setattr(Grammar, f"or_where_{_name}", _method(_make, "OR"))
    setattr(Grammar, f"and_where_{_name}", _method(_make, "AND"))
for _prefix, _fixed in (("or", "OR"), ("and", "AND")):
    setattr(Grammar, f"{_prefix}_where_column", _method(lambda a, operator, b: compare(col(a), operator, col(b)), _fixed))

_UNSET = object()


class Group(Grammar):
    """Conditions in parentheses: what a function given to where() fills."""

    def __init__(self, conditions: Conditions | None = None):
        self.conditions = conditions or Conditions()

    def _where(self, connector: str, what: Column) -> Group:
        return Group(self.conditions.add(connector, what))
