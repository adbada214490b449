"""Pages of a query: numbered, without a total, and by keyset."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    items: list[Row]
    total: int
    per_page: int
    current_page: int

    @property
    def last_page(self) -> int:
        return max(1, -(-self.total // self.per_page))

    @property
    def first_item(self) -> int | None:
        return (self.current_page - 1) * self.per_page + 1 if self.items else None

    @property
    def last_item(self) -> int | None:
        return self.first_item + len(self.items) - 1 if self.items else None

    @property
    def has_more(self) -> bool:
        return self.current_page < self.last_page

    @property
    def on_first_page(self) -> bool:
        return self.current_page == 1


    def url(self, page: int, path: str = "", **query: Any) -> str:
        return f"{path}?{urlencode(query | {'page': page})}"

    def links(self, path: str = "", **query: Any) -> dict[str, str | None]:
        return {
            "first": self.url(1, path, **query),
            "last": self.url(self.last_page, path, **query),
            "prev": None if self.on_first_page else self.url(self.current_page - 1, path, **query),
            "next": self.url(self.current_page + 1, path, **query) if self.has_more else None,
        }

    def to_dict(self, path: str = "", **query: Any) -> dict[str, Any]:
        meta = {"total": self.total, "per_page": self.per_page, "current_page": self.current_page, "last_page": self.last_page, "from": self.first_item, "to": self.last_item}
        return {"data": [r.asDict(True) for r in self.items], "meta": meta, "links": self.links(path, **query)}


@dataclass(frozen=True)
class SimplePage:
    items: list[Row]
    per_page: int
    current_page: int
    has_more: bool


@dataclass(frozen=True)
class CursorPage:
    items: list[Row]
    per_page: int
    next_cursor: str | None
    previous_cursor: str | None

    @property
    def has_more(self) -> bool:
        return self.next_cursor is not None


def _check(per_page: int, page: int = 1) -> None:
    if per_page < 1 or page < 1:
        raise ValueError("pages and their sizes start at 1")


def paginate(query: Any, per_page: int, page: int) -> Page:
    """The total counts the rows the query gives, grouped or distinct or not."""
    _check(per_page, page)
    total = query._with(limit=None, offset=None).count()
    return Page(query.offset((page - 1) * per_page).limit(per_page).get().collect(), total, per_page, page)


def simple_paginate(query: Any, per_page: int, page: int) -> SimplePage:
    _check(per_page, page)
    found = query.offset((page - 1) * per_page).limit(per_page + 1).get().collect()
    return SimplePage(found[:per_page], per_page, page, len(found) > per_page)


def encode(key: dict[str, Any], back: bool = False) -> str:
    def plain(x: Any) -> Any:
        return {"t": x.isoformat()} if isinstance(x, (datetime, date)) else {"d": str(x)} if isinstance(x, Decimal) else x

    return base64.urlsafe_b64encode(json.dumps({"key": {k: plain(v) for k, v in key.items()}, "back": back}).encode()).decode()


def decode(cursor: str) -> tuple[dict[str, Any], bool]:
    def whole(x: Any) -> Any:
        if isinstance(x, dict):
            return Decimal(x["d"]) if "d" in x else datetime.fromisoformat(x["t"]) if "T" in x["t"] else date.fromisoformat(x["t"])
        return x

    try:
        held = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return {k: whole(v) for k, v in held["key"].items()}, held["back"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e


def keyset(df: DataFrame, order: list[tuple[str, str]], after: dict[str, Any] | None, back: bool = False) -> DataFrame:
    """Rows after the key in the given order (or before it, the nearest first). The key's first column bounds the rest, so it can be pushed to the scan; nulls come last ascending and first descending."""
    ways = [(c, (d == "DESC") != back, back) for c, d in order]

    def beyond(c: str, down: bool, x: Any) -> Column:
        # Forward, nulls are last ascending and first descending; backward it is the other way round, which is the same rule.
        if x is None:
            return F.col(c).isNotNull() if down else F.lit(False)
        return F.col(c) < F.lit(x) if down else (F.col(c) > F.lit(x)) | F.col(c).isNull()

    if after is not None:
        options = []
        for i, (c, down, _) in enumerate(ways):
            same = [F.col(k).eqNullSafe(F.lit(after[k])) for k, _, _ in ways[:i]]
            options.append(reduce(lambda a, b: a & b, [*same, beyond(c, down, after[c])]))
        df = df.filter(reduce(lambda a, b: a | b, options))
    return df.orderBy(*[F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down, _ in ways])


def cursor_paginate(query: Any, per_page: int, cursor: str | None) -> CursorPage:
    """The query's order must be over columns that it selects and that tell all rows apart."""
    _check(per_page)
    order = [parsed_order(o) for o in query.state.order]
    if not order:
        raise ValueError("a keyset needs an order")
    key, back = decode(cursor) if cursor else (None, False)
    found = keyset(query._with(order=()).get(), order, key, back).limit(per_page + 1).collect()
    more, found = len(found) > per_page, found[:per_page]
    found = found[::-1] if back else found
    mark = lambda row, b: encode({c: row[c] for c, _ in order}, b)
    return CursorPage(found, per_page, mark(found[-1], False) if found and (more or back) else None, mark(found[0], True) if found and (more if back else cursor is not None) else None)


def parsed_order(order: Column) -> tuple[str, str]:
    text = order._jc.toString()
    name, _, rest = text.partition(" ")
    return name.rpartition(".")[2].strip("`"), "DESC" if rest.upper().startswith("DESC") else "ASC"
