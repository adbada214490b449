"""Aggregates, which can be filtered, and window functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .core import col, value

# The comparison operators of conditions.
OPERATORS = ("=", "!=", "<>", "<", ">", "<=", ">=")


def compare(left: Column, operator: str, right: Column) -> Column:
    match operator.strip():
        case "=" | "==":
            return left == right
        case "!=" | "<>":
            return left != right
        case "<":
            return left < right
        case ">":
            return left > right
        case "<=":
            return left <= right
        case ">=":
            return left >= right
    raise ValueError(f"unknown operator {operator!r}")


class Aggregate:
    """An aggregate of a column; filter() restricts the rows it sees."""

    def __init__(self, function, argument: Column, condition: Column | None = None):
        self.function, self.argument, self.condition = function, argument, condition

    def filter(self, column: Any, x: Any = None, operator: str = "=") -> Aggregate:
        """Conditions add up. A single Column is a condition itself."""
        new = column if isinstance(column, Column) and x is None else compare(col(column), operator, value(x)) if x is not None else col(column).isNull() if operator == "=" else col(column).isNotNull()
        return Aggregate(self.function, self.argument, new if self.condition is None else self.condition & new)

    @property
    def column(self) -> Column:
        return self.function(self.argument if self.condition is None else F.when(self.condition, self.argument))

    def alias(self, name: str) -> Column:
        return self.column.alias(name)


def count(x: Any = "*") -> Aggregate:
    return Aggregate(F.count, F.lit(1) if isinstance(x, str) and x == "*" else col(x))


def count_distinct(x: Any) -> Aggregate:
    return Aggregate(F.count_distinct, col(x))


def sum_(x: Any) -> Aggregate:
    return Aggregate(F.sum, col(x))


def avg(x: Any) -> Aggregate:
    return Aggregate(F.avg, col(x))


def min_(x: Any) -> Aggregate:
    return Aggregate(F.min, col(x))


def max_(x: Any) -> Aggregate:
    return Aggregate(F.max, col(x))


def group_concat(x: Any, separator: str = ",", distinct: bool = False) -> Column:
    """Values joined in ascending order, nulls left out, so that the result doesn't depend on the order of rows."""
    values = F.collect_set(col(x).cast("string")) if distinct else F.collect_list(col(x).cast("string"))
    joined = F.array_join(F.sort_array(values), separator)
    return F.when(F.size(values) > 0, joined)


def array_agg(x: Any) -> Column:
    """Keeps nulls, in ascending order, nulls last."""
    held = F.sort_array(F.collect_list(F.struct(col(x).isNull().alias("none"), col(x).alias("v"))))
    return F.transform(held, lambda e: e["v"])


def json_array_agg(x: Any) -> Column:
    return F.to_json(array_agg(x))


def stddev(x: Any) -> Aggregate:
    return Aggregate(F.stddev, col(x))


def variance(x: Any) -> Aggregate:
    return Aggregate(F.variance, col(x))


def approx_count_distinct(x: Any) -> Aggregate:
    return Aggregate(F.approx_count_distinct, col(x))


# ---- windows ------------------------------------------------------------------


def ordering(x: Any, direction: str = "ASC") -> Column:
    """Nulls come last ascending and first descending."""
    if direction.upper() not in ("ASC", "DESC"):
        raise ValueError(f"unknown direction {direction!r}")
    return col(x).asc_nulls_last() if direction.upper() == "ASC" else col(x).desc_nulls_first()


class Windowed:
    """A window function; partition_by() and order_by() and a frame make its OVER clause."""

    def __init__(self, function: Column, partition: tuple = (), order: tuple = (), frame: tuple | None = None):
        self.function, self.partition, self.order, self.frame = function, partition, order, frame

    def partition_by(self, *columns: Any) -> Windowed:
        return Windowed(self.function, tuple(map(col, columns)), self.order, self.frame)

    def order_by(self, column: Any, direction: str = "ASC") -> Windowed:
        return Windowed(self.function, self.partition, (*self.order, column if isinstance(column, Column) else ordering(column, direction)), self.frame)

    def rows(self, start: int | None = None, end: int | None = 0) -> Windowed:
        """None: unbounded; negative: before the current row; 0: it."""
        return Windowed(self.function, self.partition, self.order, ("rows", start, end))

    def range(self, start: int | None = None, end: int | None = 0) -> Windowed:
        return Windowed(self.function, self.partition, self.order, ("range", start, end))

    @property
    def spec(self) -> WindowSpec:
        spec = Window.partitionBy(*self.partition)
        if self.order:
            spec = spec.orderBy(*self.order)
        if self.frame:
            kind, start, end = self.frame
            low, high = Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end
            spec = spec.rowsBetween(low, high) if kind == "rows" else spec.rangeBetween(low, high)
        return spec

    @property
    def column(self) -> Column:
        return self.function.over(self.spec)

    def alias(self, name: str) -> Column:
        return self.column.alias(name)


def row_number() -> Windowed:
    return Windowed(F.row_number())


def rank() -> Windowed:
    return Windowed(F.rank())


def dense_rank() -> Windowed:
    return Windowed(F.dense_rank())


def ntile(n: int) -> Windowed:
    return Windowed(F.ntile(n))


def lag(x: Any, offset: int = 1, default: Any = None) -> Windowed:
    return Windowed(F.lag(col(x), offset, default))


def lead(x: Any, offset: int = 1, default: Any = None) -> Windowed:
    return Windowed(F.lead(col(x), offset, default))


def first_value(x: Any) -> Windowed:
    return Windowed(F.first_value(col(x)))


def last_value(x: Any) -> Windowed:
    """With the default frame, that of the current row's last peer."""
    return Windowed(F.last_value(col(x)))


def nth_value(x: Any, n: int) -> Windowed:
    return Windowed(F.nth_value(col(x), n))


def window_aggregate(function: str, x: Any) -> Windowed:
    return Windowed(F.count(F.lit(1)) if isinstance(x, str) and x == "*" else F.call_function(function, col(x)))
