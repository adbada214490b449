"""How arguments of the helpers become columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Any) -> Column:
    """A string is a column or an expression, a Column itself, anything else a literal."""
    return x if isinstance(x, Column) else F.expr(x) if isinstance(x, str) else F.lit(x)


def value(x: Any) -> Column:
    """Anything but a Column is a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def raw(sql: str, **params: Any) -> Column:
    """An SQL expression; :name in it stands for a parameter, which is bound as a literal."""
    if not params:
        return F.expr(sql)
    return _bound(sql, params)


def _bound(sql: str, params: dict[str, Any]) -> Column:
    import re

    def literal(m: re.Match) -> str:
        if m[1] is None or m[1] not in params:
            return m[0]
        given = params[m[1]]
        if given is None:
            return "NULL"
        if isinstance(given, bool):
            return "TRUE" if given else "FALSE"
        if isinstance(given, (int, float)):
            return repr(given)
        return "'" + str(given).replace("\\", "\\\\").replace("'", "\\'") + "'"

    # Quoted strings and casts (::) stay as they are.
    return F.expr(re.sub(r"'(?:[^'\\]|\\.|'')*'|::|:([A-Za-z_]\w*)", literal, sql))


def as_(x: Any, alias: str) -> Column:
    return col(x).alias(alias)


def escape(text: str) -> Column:
    return F.lit(text)


def null() -> Column:
    return F.lit(None)


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


def default() -> Column:
    """DEFAULT in an update or insert: the column's default, which plain tables don't have, so null."""
    return F.lit(None)
