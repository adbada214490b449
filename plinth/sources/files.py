"""Loaders and exporters for CSV, XML and JSON."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _texts(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _not_all_empty(df: DataFrame) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, (F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "" for c in df.columns))) if df.columns else df


#: Lines that the names in a header may fill.
HEAD_LINES = 64


def load_csv(spark: SparkSession, path: str, fields: Sequence[str] | None = None, separator: str = ",", quote: str = '"', skip: int = 0, prefix: str | None = None) -> DataFrame:
    """All columns as text, trimmed.

    Without `fields` the first row of each file that isn't skipped names the columns. Quoted values
    may hold line breaks, so a file is read in one piece, row by row: write large tables as many
    files. Short rows are filled with nulls, long ones cut, blank and all-empty ones dropped; the
    first `skip` rows of each file are passed over. With `prefix` only lines that begin with it
    count, and their values hold no line breaks.
    """
    if prefix:
        return _prefixed_csv(spark, path, fields, separator, quote, skip, prefix)
    reader = spark.read.options(sep=separator, quote=quote, escape=quote, multiLine=True, mode="PERMISSIVE", columnPruning=False)
    names = list(fields or [])
    if not names:
        lines = [r["value"] + "\n" for r in spark.read.text(path).filter(F.trim("value") != "").limit(skip + HEAD_LINES).collect()]
        if len(lines) <= skip:
            return spark.createDataFrame([], _texts([]))
        names = [c.strip() for c in next(csv.reader(lines[skip:], delimiter=separator, quotechar=quote))]
    own = skip + (not fields)
    if own < 2:
        rows = reader.option("header", bool(own)).option("enforceSchema", True).schema(_texts(names)).csv(path)
    else:
        numbered = reader.schema(_texts(names)).csv(path).select(F.struct("*").alias("row"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
        first = numbered.groupBy("file").agg(F.min("place").alias("first"), F.max(F.length(F.to_json("row"))).alias("longest")).select("file", "first")  # one row a file
        rows = numbered.join(first, "file").filter(F.col("place") - F.col("first") >= own).select("row.*")
    return _trimmed(rows, names)


def _trimmed(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return _not_all_empty(rows.select(*[F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names]))


def _prefixed_csv(spark: SparkSession, path: str, fields: Sequence[str] | None, separator: str, quote: str, skip: int, prefix: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: x.startswith(prefix)).alias("lines"))
    lines = lines.select(F.posexplode("lines").alias("place", "line")).select("place", F.substr("line", F.lit(len(prefix) + 1)).alias("line")).filter(F.trim("line") != "")
    names = list(fields or [])
    if not names:
        head = lines.filter(F.col("place") == skip).first()
        if head is None:
            return spark.createDataFrame([], _texts([]))
        names = [c.strip() for c in next(csv.reader([head["line"]], delimiter=separator, quotechar=quote))]
    kept = lines.filter(F.col("place") >= skip + (not fields))
    parsed = kept.select(F.from_csv("line", ", ".join(f"`{n}` string" for n in names), {"sep": separator, "quote": quote, "mode": "PERMISSIVE", "escape": quote}).alias("r"))
    return _trimmed(parsed.select("r.*"), names)


def load_xml(spark: SparkSession, path: str, row_tag: str = "row", skip: int = 0, fields: Sequence[str] | None = None) -> DataFrame:
    """All columns as text: the row's child elements, else its attributes; empty ones are null. `skip` passes over the first rows of a file read in one piece."""
    reader = spark.read.format("xml").option("rowTag", row_tag.strip("<>/ ")).option("inferSchema", False).option("attributePrefix", "@").option("ignoreSurroundingSpaces", True)
    found = reader.schema(_texts(fields)).load(path) if fields else reader.load(path)
    children = [c for c in found.columns if not c.startswith("@")]
    found = found.select(*[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c.lstrip("@")) for c in children or found.columns])
    if skip:
        numbered = found.withColumn("__n", F.monotonically_increasing_id())
        found = numbered.filter(F.col("__n") >= skip).drop("__n")
    return found


def load_json(spark: SparkSession, path: str, columns: Sequence[str] | None = None, format: str = "auto") -> DataFrame:
    """All columns as text, nested values as JSON. An array of objects or one object a line; what isn't an object is passed over. Without `columns` the first object names them."""
    if format == "auto":
        head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        format = "array" if head and head[0]["value"].lstrip().startswith("[") else "lines"
    texts = spark.read.text(path, wholetext=format == "array").select(F.try_parse_json("value").alias("v"))
    if format == "array":
        texts = texts.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
    objects = texts.filter(F.schema_of_variant("v").startswith("OBJECT")).select(F.to_json("v").alias("j"))
    if columns is None:
        first = objects.first()
        columns = list(json.loads(first["j"])) if first else []
    return objects.select(*[F.get_json_object("j", f"$['{c}']").alias(c) for c in columns])


def save_csv(df: DataFrame, path: str, separator: str = ",", quote: str = '"') -> None:
    df.write.option("header", True).option("sep", separator).option("quote", quote).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def save_xml(df: DataFrame, path: str, root: str = "data", item: str = "item") -> None:
    df.write.format("xml").option("rootTag", root).option("rowTag", item).save(path)


# ---- text of rows that are on the driver ---------------------------------------


def to_json(rows: Iterable[dict[str, Any]], pretty: bool = True) -> str:
    return json.dumps(list(rows), ensure_ascii=False, indent=4 if pretty else None, default=str)


def to_csv(rows: Sequence[dict[str, Any]], separator: str = ",", quote: str = '"') -> str:
    """The header from the first row; no rows give no text."""
    if not rows:
        return ""
    out = io.StringIO()
    writer = csv.DictWriter(out, list(rows[0]), delimiter=separator, quotechar=quote, lineterminator="\n", extrasaction="ignore")
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def to_xml(rows: Iterable[dict[str, Any]], root: str = "data", item: str = "item", encoding: str = "UTF-8") -> str:
    def name(text: Any) -> str:
        return re.sub(r"[^a-zA-Z0-9_-]", "_", str(text))

    def element(tag: str, held: Any, depth: int) -> str:
        pad = "  " * depth
        if isinstance(held, dict):
            inner = "".join(element(name(k), v, depth + 1) for k, v in held.items())
        elif isinstance(held, (list, tuple)):
            inner = "".join(element(item, v, depth + 1) for v in held)
        else:
            return f"{pad}<{tag}>{'' if held is None else escape(str(held))}</{tag}>\n"
        return f"{pad}<{tag}>\n{inner}{pad}</{tag}>\n"

    return f'<?xml version="1.0" encoding="{encoding}"?>\n' + element(root, list(rows), 0)


def dump(df: DataFrame, path: str) -> None:
    """Data and schema."""
    df.write.parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
