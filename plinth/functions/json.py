"""JSON helpers over text columns. Paths are dotted strings or lists; digits are places in an array."""

from __future__ import annotations

import json as _json
from collections.abc import Iterable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, value

Path = str | Sequence[str | int] | None


def parts(path: Path) -> list[str]:
    if path is None or path == "":
        return []
    return path.split(".") if isinstance(path, str) else [str(p) for p in path]


def json_path(path: Path) -> str:
    out = "$"
    for p in parts(path):
        out += f"[{p}]" if p.isdigit() else f".{p}" if p.replace("_", "a").isalnum() else f"['{p}']"
    return out


def _at(x: Any, path: Path) -> Column:
    return F.get_json_object(col(x), json_path(path)) if parts(path) else col(x)


def _variant(x: Any, path: Path) -> Column:
    return F.try_variant_get(F.try_parse_json(col(x)), json_path(path), "variant")


def json_get(x: Any, path: Path, as_text: bool = True) -> Column:
    """The value as text (strings without quotes) or as JSON."""
    return _at(x, path) if as_text else F.to_json(_variant(x, path))


json_extract = json_get


def json_compare(x: Any, path: Path, operator: str, right: Any) -> Column:
    """The value at the path against `right`; as a number if that is one."""
    from .aggregate import compare

    found = _at(x, path)
    if isinstance(right, bool):
        return compare(found, operator, F.lit("true" if right else "false"))
    if isinstance(right, (int, float)):
        found = found.try_cast("double")
    return compare(found, operator, value(right))


def json_contains(x: Any, right: Any, path: Path = None) -> Column:
    """Whether the array at the path holds `right`, or all of it if it is a list; a scalar there counts as an array of one."""
    found = F.coalesce(_at(x, path), F.lit(""))
    held = F.coalesce(F.from_json(found, "array<string>"), F.array(found))
    wanted = right if isinstance(right, (list, tuple)) else [right]
    every = F.lit(True)
    for w in wanted:
        every = every & F.array_contains(held, F.lit(w if isinstance(w, str) else _json.dumps(w)))
    return F.coalesce(every & _at(x, path).isNotNull(), F.lit(False))


def json_exists(x: Any, path: Path) -> Column:
    """Whether the path is there, be its value null or not."""
    return F.coalesce(_variant(x, path).isNotNull(), F.lit(False))


def json_length(x: Any, path: Path = None) -> Column:
    """Elements of an array; 0 for anything else."""
    return F.coalesce(F.json_array_length(_at(x, path)), F.lit(0))


def json_keys(x: Any, path: Path = None) -> Column:
    return F.json_object_keys(_at(x, path))


def json_type(x: Any, path: Path = None) -> Column:
    """object, array, string, number, boolean or null; null without the path."""
    kind = F.schema_of_variant(_variant(x, path))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def json_array(*values: Any) -> Column:
    """Literals and columns; columns of several types are written as JSON each."""
    if not any(isinstance(v, Column) for v in values):
        return F.lit(_json.dumps(list(values), ensure_ascii=False))
    return F.concat(F.lit("["), F.concat_ws(",", *[_written(v) for v in values]), F.lit("]"))


def json_object(pairs: dict[str, Any]) -> Column:
    """Literals and columns; a null stays as JSON null."""
    if not any(isinstance(v, Column) for v in pairs.values()):
        return F.lit(_json.dumps(pairs, ensure_ascii=False))
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(_json.dumps(k, ensure_ascii=False) + ":"), _written(v)) for k, v in pairs.items()]), F.lit("}"))


def _written(v: Any) -> Column:
    """A value as JSON text."""
    if not isinstance(v, Column):
        return F.lit(_json.dumps(v, ensure_ascii=False))
    # As the only element of an array a value of any type is written by to_json, a null too.
    return F.regexp_replace(F.to_json(F.array(v), {"ignoreNullFields": "false"}), r"^\[|\]$", "")


def _change(x: Any, path: Path, how: str, new: Any) -> Column:
    """JSON text can't be changed in place by built-in functions: a vectorised function parses, changes and writes it."""
    steps = parts(path)
    if not steps:
        raise ValueError("a path is needed")

    @F.pandas_udf("string")
    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else changed_text(t, steps, how, new), na_action="ignore")

    text = col(x).cast("string")
    # Nothing is there to be replaced or removed in most texts without the path: they don't go to Python.
    return changed(text) if how == "set" else F.when(F.coalesce(_variant(text, path).isNotNull(), F.lit(False)), changed(F.when(_variant(text, path).isNotNull(), text))).otherwise(text)


def changed_text(text: str, steps: Sequence[str], how: str, new: Any = None) -> str:
    """set: put the value, making objects on the way; replace: only where the path is; remove: drop a key, or set null at a place in an array so that the others keep theirs."""
    try:
        root = _json.loads(text)
    except ValueError:
        return text
    node = root
    for step in steps[:-1]:
        below = _child(node, step)
        if below is _MISSING or (how == "set" and not isinstance(below, (dict, list))):
            if how != "set" or not isinstance(node, dict):
                return text
            below = node[step] = {}
        node = below
    last = steps[-1]
    there = _child(node, last) is not _MISSING
    if isinstance(node, dict):
        if how == "remove":
            node.pop(last, None)
        elif how == "set" or there:
            node[last] = new
    elif isinstance(node, list) and last.isdigit():
        if there:
            node[int(last)] = None if how == "remove" else new
        elif how == "set" and int(last) == len(node):
            node.append(new)
    return _json.dumps(root, ensure_ascii=False, separators=(",", ":"))


_MISSING = object()


def _child(node: Any, step: str) -> Any:
    if isinstance(node, dict):
        return node.get(step, _MISSING)
    if isinstance(node, list) and step.isdigit() and int(step) < len(node):
        return node[int(step)]
    return _MISSING


def json_set(x: Any, path: Path, new: Any) -> Column:
    return _change(x, path, "set", new)


def json_replace(x: Any, path: Path, new: Any) -> Column:
    return _change(x, path, "replace", new)


def json_remove(x: Any, path: Path) -> Column:
    return _change(x, path, "remove", None)


def json_order(x: Any, path: Path) -> Column:
    """The value at the path as a number, for sorting; null where it isn't one."""
    return _at(x, path).try_cast("double")


__all__: Iterable[str] = [n for n in dir() if n.startswith("json_")]
