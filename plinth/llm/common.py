"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import new_folder, remove

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space as the contracts define it.
SPACES = b" \t\n\x0b\x0c\r"
#: With it on, a query's shuffle files go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys with more than this part of all rows are met by a broadcast of fewer than this many rows.
HOT = 1000
#: Bytes of a batch between the JVM and Python, and the setting that limits them with Spark's default.
BATCH_BYTES = 4 << 20
BATCH_LIMIT, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Rows turned into Python objects at a time, so that memory follows a few texts and not a whole Arrow batch.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet under the shared folder and read again: computed once, with no lineage to go back through, and what was shuffled for it can go. forget() removes it; what is left goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = new_folder(spark)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def forget(*frames: DataFrame) -> None:
    """Remove what stored() wrote for frames that nothing will read any more."""
    for df in frames:
        remove(df.sparkSession, df.stored_at)


def meet(rows: DataFrame, values: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """`rows` with what `values` holds for their key, the columns `on`: one row for each key, and in `n` how many of `rows` have it.

    A key of more than a HOT-th of all rows is hot; so there are fewer than HOT, and they go to every
    task, however many rows wait for them. All other rows are shuffled by key. Both frames are read
    more than once and should be stored; keys are not null, and no other column is in both.
    """
    total = values.agg(F.sum(n).alias("n")).first()["n"] or 0
    more = [c for c in values.columns if c not in (*on, n)]
    hot = values.filter(F.col(n) * HOT > total).select(*on, *[F.col(c).alias(f"hot_{c}") for c in more], F.lit(True).alias("is_hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    warm = marked.filter("is_hot").select(*rows.columns, *[F.col(f"hot_{c}").alias(c) for c in more])
    cold = marked.filter("is_hot IS NULL").select(*rows.columns).join(values, on).select(*rows.columns, *more)
    return warm.unionAll(cold)


def meet_in_one(rows: DataFrame, values: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """As meet(), in one pass over `rows`: hot ones, which have got their values by then, are dealt out evenly where the others are shuffled by key. `rows` should be stored: their order deals them."""
    total = values.agg(F.sum(n).alias("n")).first()["n"] or 0
    more = [c for c in values.columns if c not in (*on, n)]
    hot = values.filter(F.col(n) * HOT > total).select(*on, *[F.col(c).alias(f"hot_{c}") for c in more], F.lit(True).alias("is_hot"))
    cold = values.select(*on, *[F.col(c).alias(f"cold_{c}") for c in more], F.lit(0).cast("long").alias("salt"), F.lit(True).alias("is_cold"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("salt", F.when(F.col("is_hot"), F.monotonically_increasing_id() + 1).otherwise(0))
    joined = salted.join(cold, [*on, "salt"], "left").filter("is_hot OR is_cold")
    return joined.select(*rows.columns, *[F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in more])


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _give_back() -> None:
    """Return freed memory to the system: workers are used again, for other operators too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow in small batches, so that neither the JVM nor Python holds tens of megabytes of text at once. The session's own limit stands where it has been changed from Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) == DEFAULT_BATCH:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(whole, schema)


def map_columns(df: DataFrame, function: Callable[[dict], dict], schema: str | StructType, rows: int = SLICE) -> DataFrame:
    """Run `function` over small slices of each partition. It gets and returns a dict of Python lists (or arrays) by column name."""
    target = schema_of(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            out = function(part.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return in_arrow(df, run, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[list], list[bool]], rows: int = SLICE) -> DataFrame:
    """The rows of `df` for whose values of `column` `keep` says so; all columns pass as they are, whatever their names and types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            yield part.filter(pa.array(keep(part.column(column).to_pylist()), pa.bool_()))

    return in_arrow(df, run, df.schema)


def schema_of(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


def unit_draw(text: Column) -> Column:
    """A number in (0, 1), the same on every run: the first 52 bits of the MD5 of `text`."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
