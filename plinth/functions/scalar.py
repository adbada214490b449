"""String, numeric, date, null, conditional, comparison and type helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, value

# ---- strings ----------------------------------------------------------------


def concat(*args: Any) -> Column:
    """Null if any part is null."""
    return F.concat(*[col(a).cast("string") for a in args])


def upper(x: Any) -> Column:
    return F.upper(col(x))


def lower(x: Any) -> Column:
    return F.lower(col(x))


def trim(x: Any) -> Column:
    return F.trim(col(x))


def ltrim(x: Any) -> Column:
    return F.ltrim(col(x))


def rtrim(x: Any) -> Column:
    return F.rtrim(col(x))


def length(x: Any) -> Column:
    """In characters."""
    return F.char_length(col(x))


def replace(x: Any, search: str, by: str) -> Column:
    return F.replace(col(x), F.lit(search), F.lit(by))


def substring(x: Any, start: int, length: int | None = None) -> Column:
    """From 1-based `start`."""
    return F.substr(col(x), F.lit(start)) if length is None else F.substr(col(x), F.lit(start), F.lit(length))


def left(x: Any, n: int) -> Column:
    return F.left(col(x), F.lit(n))


def right(x: Any, n: int) -> Column:
    return F.right(col(x), F.lit(n))


def position(part: Any, x: Any) -> Column:
    """1-based place of `part` (a literal unless a Column) in `x`; 0 if absent."""
    return F.position(value(part), col(x))


def repeat(x: Any, n: int) -> Column:
    """A plain string is the text to repeat, not a column."""
    return F.repeat(value(x), F.lit(max(n, 0)))


def reverse(x: Any) -> Column:
    return F.reverse(col(x))


def pad_left(x: Any, n: int, pad: str = " ") -> Column:
    return F.lpad(col(x), n, pad)


def pad_right(x: Any, n: int, pad: str = " ") -> Column:
    return F.rpad(col(x), n, pad)


lpad, rpad = pad_left, pad_right


def regexp_match(x: Any, pattern: str) -> Column:
    return F.regexp_like(col(x), F.lit(pattern))


regexp_like = regexp_match


def regexp_replace(x: Any, pattern: str, by: str) -> Column:
    """All matches."""
    return F.regexp_replace(col(x), pattern, by)


def regexp_extract(x: Any, pattern: str, group: int = 0) -> Column:
    """The group of the first match (0: all of it), null without a match."""
    return F.when(F.regexp_like(col(x), F.lit(pattern)), F.regexp_extract(col(x), pattern, group))


def to_char(x: Any, format: str | None = None) -> Column:
    return col(x).cast("string") if format is None else F.to_char(col(x), F.lit(format))


# ---- numbers ----------------------------------------------------------------


def abs_(x: Any) -> Column:
    return F.abs(col(x))


def round_(x: Any, digits: int = 0) -> Column:
    return F.round(col(x), digits)


def ceil(x: Any) -> Column:
    return F.ceil(col(x))


def floor(x: Any) -> Column:
    return F.floor(col(x))


def power(x: Any, exponent: Any) -> Column:
    return F.pow(col(x), col(exponent))


def sqrt(x: Any) -> Column:
    return F.sqrt(col(x))


def exp(x: Any) -> Column:
    return F.exp(col(x))


def ln(x: Any) -> Column:
    return F.ln(col(x))


def log(x: Any, base: Any = None) -> Column:
    """To the base 10 unless a base is given."""
    return F.log10(col(x)) if base is None else F.ln(col(x)) / F.ln(col(base))


def add(a: Any, b: Any) -> Column:
    return col(a) + col(b)


def mod(a: Any, b: Any) -> Column:
    """With the sign of the dividend."""
    return col(a) % col(b)


def trunc(x: Any, digits: int = 0) -> Column:
    """Towards zero. The decimal detour keeps 0.29 * 100 from becoming 28.99…"""
    exact = col(x).cast("decimal(38,12)")
    scale = F.lit(10**digits).cast("decimal(20,0)")
    whole = F.floor(F.abs(exact) * scale).cast("double") / F.lit(float(10**digits))
    return F.signum(col(x)) * whole


def inc(n: int | float = 1) -> tuple[str, int | float]:
    """For update maps: the column plus n."""
    return ("inc", n)


def dec(n: int | float = 1) -> tuple[str, int | float]:
    return ("dec", n)


# ---- dates ------------------------------------------------------------------


def cur_date() -> Column:
    return F.current_date()


def cur_time() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def date(x: Any) -> Column:
    return col(x).cast("date")


def time(x: Any) -> Column:
    return F.date_format(col(x).cast("timestamp"), "HH:mm:ss")


def year(x: Any) -> Column:
    return F.year(col(x))


def month(x: Any) -> Column:
    return F.month(col(x))


def day(x: Any) -> Column:
    return F.dayofmonth(col(x))


def hour(x: Any) -> Column:
    return F.hour(col(x))


def minute(x: Any) -> Column:
    return F.minute(col(x))


def second(x: Any) -> Column:
    return F.second(col(x))


UNITS = ("YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND")


def _interval(amount: Any, unit: str) -> Column:
    unit = unit.upper().removesuffix("S")
    if unit not in UNITS:
        raise ValueError(f"unknown interval unit {unit}")
    return F.make_interval(**{f"{unit.lower()}s" if unit != "MINUTE" and unit != "SECOND" else {"MINUTE": "mins", "SECOND": "secs"}[unit]: F.lit(float(amount) if unit == "SECOND" else int(amount))})


def add_interval(x: Any, amount: Any, unit: str) -> Column:
    """A month added to the last day of January gives the last day of February."""
    return col(x) + _interval(amount, unit)


def sub_interval(x: Any, amount: Any, unit: str) -> Column:
    return col(x) - _interval(amount, unit)


def now(diff: str | None = None, as_timestamp: bool = False) -> Column:
    """The time now, moved by a text such as "+1 DAY"; as epoch seconds if asked for."""
    at = F.current_timestamp()
    if diff:
        m = re.fullmatch(r"\s*([+-]?)\s*(\d+)\s*([A-Za-z]+)\s*", diff)
        if not m:
            raise ValueError(f"not an interval: {diff!r}")
        at = sub_interval(at, m[2], m[3]) if m[1] == "-" else add_interval(at, m[2], m[3])
    return F.unix_timestamp(at.cast("timestamp")) if as_timestamp else at


def ts(diff: str | None = None) -> Column:
    return now(diff, True)


# Format codes of to_ts() and to_date() and their Spark forms, the longer ones first.
FORMATS = {"YYYY": "yyyy", "HH24": "HH", "HH12": "hh", "MON": "MMM", "YY": "yy", "MM": "MM", "DD": "dd", "MI": "mm", "SS": "ss", "AM": "a", "PM": "a"}


def spark_format(text: str) -> str:
    return re.sub("|".join(FORMATS), lambda m: FORMATS[m[0]], text)


def to_ts(x: Any, format: str = "YYYY-MM-DD HH24:MI:SS") -> Column:
    return F.to_timestamp(col(x), spark_format(format))


def to_date(x: Any, format: str = "YYYY-MM-DD") -> Column:
    return F.to_date(col(x), spark_format(format))


# ---- null, conditions, comparisons, types -------------------------------------


def is_null(x: Any) -> Column:
    return col(x).isNull()


def is_not_null(x: Any) -> Column:
    return col(x).isNotNull()


def coalesce(*args: Any) -> Column:
    return F.coalesce(*map(col, args))


def if_null(x: Any, default: Any) -> Column:
    """`default` is a literal unless a Column."""
    return F.coalesce(col(x), value(default))


def null_if(a: Any, b: Any) -> Column:
    return F.nullif(col(a), value(b))


def case(cases: dict[Any, Any] | Iterable[tuple[Any, Any]], otherwise: Any = None) -> Column:
    """The result of the first condition that holds. Results are literals unless Columns."""
    out = None
    for condition, result in cases.items() if isinstance(cases, dict) else cases:
        out = F.when(col(condition), value(result)) if out is None else out.when(col(condition), value(result))
    if out is None:
        return value(otherwise)
    return out.otherwise(value(otherwise))


def like(x: Any, pattern: str) -> Column:
    return col(x).like(pattern)


def ilike(x: Any, pattern: str) -> Column:
    return col(x).ilike(pattern)


def not_(x: Any) -> Column:
    return ~col(x)


def between(x: Any, low: Any, high: Any) -> Column:
    return col(x).between(value(low), value(high))


def not_between(x: Any, low: Any, high: Any) -> Column:
    return ~between(x, low, high)


def in_(x: Any, values: Iterable[Any]) -> Column:
    """False for an empty list."""
    given = list(values)
    return col(x).isin(*given) if given else F.lit(False)


def not_in(x: Any, values: Iterable[Any]) -> Column:
    """True for an empty list; a null in the list makes it unknown, as in SQL."""
    given = list(values)
    return ~col(x).isin(*given) if given else F.lit(True)


def cast(x: Any, kind: str) -> Column:
    return col(x).cast(kind)


def try_cast(x: Any, kind: str) -> Column:
    return col(x).try_cast(kind)


def greatest(*args: Any) -> Column:
    """Nulls are passed over."""
    return F.greatest(*map(col, args))


def least(*args: Any) -> Column:
    return F.least(*map(col, args))


def match(columns: Any, terms: str, mode: str | None = None) -> Column:
    """Full-text search over the words of one or more columns: `&` and blanks mean all, `|` means any, `!` without. In the mode "natural" blanks mean any, and `&`, `|` and `!` mean nothing; "boolean" and no mode are the same."""
    if mode and mode.lower().split()[0] not in ("natural", "boolean"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode and mode.lower().startswith("natural"):
        terms = "|".join(re.findall(r"[^\s&|!]+", terms))
    line = _line(columns)
    # The text is cut into words once (the one-element array binds them), and only if it holds what a match must.
    return _may_match(line, terms) & F.exists(F.array(_cut(line)), lambda found: _matches(found, terms))


def match_rank(columns: Any, terms: str) -> Column:
    """How often the terms (without their signs) occur among the words of the columns, over the number of words; 0 without words."""
    wanted = sorted({t.lower() for t in re.findall(r"[^\s&|!*]+", terms)})
    words = F.filter(_cut(_line(columns)), lambda w: w != "")
    hits = lambda found: F.size(F.filter(found, lambda w: w.isin(*wanted))) / F.greatest(F.size(found), F.lit(1))
    return F.transform(F.array(words), hits)[0].cast("double") if wanted else F.lit(0.0)


def _line(columns: Any) -> Column:
    names = [columns] if isinstance(columns, (str, Column)) else list(columns)
    return F.lower(F.concat_ws(" ", *map(col, names)))


def _cut(line: Column) -> Column:
    return F.split(line, r"[^\p{L}\p{N}]+")


def _may_match(line: Column, terms: str) -> Column:
    """A test by plain search that every match passes: one group of terms has all that it asks for somewhere in the text."""
    some = F.lit(False)
    for group in filter(None, (g.strip() for g in terms.split("|"))):
        asked = [t.rstrip("*").lower() for t in re.split(r"[&\s]+", group) if t and not t.startswith("!")]
        every = F.lit(True)
        for t in asked:
            every = every & F.contains(line, F.lit(t))
        some = some | every
    return some


def _matches(words: Column, terms: str) -> Column:
    def has(term: str) -> Column:
        if term.startswith("!"):
            return ~has(term[1:])
        if term.endswith("*"):
            return F.exists(words, lambda w: w.startswith(term[:-1].lower()))
        return F.array_contains(words, term.lower())

    some = F.lit(False)
    for group in terms.split("|"):
        every = F.lit(True)
        for term in re.split(r"[&\s]+", group.strip()):
            if term:
                every = every & has(term)
        some = some | every if group.strip() else some
    return some
