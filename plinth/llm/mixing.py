"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, table, unit_draw

#: Words are weighed in this pattern, the sources ordered by code point and null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix holds this share of all words.
SHARE = 1.5
#: No source and no document is taken more often than this.
CAP = 2.0
#: Documents of one source and like size number themselves in this many groups, so that no task orders a whole source.
DRAW_HEX = 2


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of `sizes` (mix_source string, mix_total long), one row a source.

    Water filling: by weight, but a source stops at `cap` times its size and the others share the
    excess. In the order of cap over weight the full sources come first, so running sums give the
    level at which all others stand. The windows have no partition: they hold one row a source.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    given = sizes.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % n + 1).cast("int")).alias("mix_weight"), place.alias("mix_place"))
    given = given.withColumn("mix_most", F.col("mix_total") * F.lit(cap)).withColumn("mix_ratio", F.col("mix_most") / F.col("mix_weight"))
    order = Window.orderBy("mix_ratio", "mix_place")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("mix_total").over(everything) * F.lit(share) - F.coalesce(F.sum("mix_most").over(before), F.lit(0.0))
    levels = given.withColumn("mix_level", left / F.sum("mix_weight").over(after))
    level = F.min(F.when(F.col("mix_level") < F.col("mix_ratio"), F.struct("mix_ratio", "mix_place", "mix_level"))).over(everything)["mix_level"]
    target = F.least(F.col("mix_most"), F.coalesce(level * F.col("mix_weight"), F.col("mix_most")))
    return levels.select("mix_source", "mix_total", target.alias("mix_target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, size, source_size, target, taken, copies, then the columns named in `carry` as
    one struct `row` (none: no such column). A document's expected copies are its source's target
    over its source's size. Within a source, in the order of size, they are summed up; one offset,
    drawn by hash from `seed` and the source, is added; a copy is emitted at each whole number
    passed. So reruns agree, copies are the expected number rounded down or up, and close sizes
    balance each other. Null and empty texts have size 0 and add nothing, whatever their copies;
    the null source is a source of its own; each of several equal rows counts; a source without
    words has the target 0 and no copies; an empty table gives none.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary"))
    size = F.col("mix_size")
    bits = F.length(F.bin(size))
    band = bits * 16 + F.expr("shiftright(mix_size, greatest(length(bin(mix_size)) - 4, 0))").cast("int")
    rows = df.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("mix_source"), words(F.col(text)).alias("mix_size"), digest.alias("mix_digest"), *([F.struct(*carry).alias("row")] if carry else []))
    rows = rows.withColumns({
        "mix_key": F.coalesce(F.concat(F.lit("s"), F.col("mix_source")), F.lit("n")),
        "mix_band": band,
        "mix_draw": F.substring("mix_digest", 1, DRAW_HEX),
    })
    groups = ["mix_key", "mix_band", "mix_draw"]
    counts = rows.groupBy(*groups).agg(F.first("mix_source").alias("mix_source"), F.count(F.lit(1)).alias("mix_n"), F.sum("mix_size").alias("mix_words"))
    sources = targets(counts.groupBy("mix_key", "mix_source").agg(F.sum("mix_words").alias("mix_total")).select("mix_source", "mix_total"), weights, share, cap)
    sources = sources.withColumn("mix_key", F.coalesce(F.concat(F.lit("s"), F.col("mix_source")), F.lit("n"))).drop("mix_source")
    before = Window.partitionBy("mix_key").orderBy("mix_band", "mix_draw").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_start")).join(sources, "mix_key")
    numbered = rows.withColumn("mix_rank", F.row_number().over(Window.partitionBy(*groups).orderBy("mix_size", "mix_digest")))
    rate = F.when(F.col("mix_total") > 0, F.col("mix_target") / F.col("mix_total")).otherwise(0.0)
    offset = unit_draw(F.concat(F.lit(seed + "|"), F.col("mix_key")))
    at = F.col("mix_start") + F.col("mix_rank")
    copies = (F.floor(rate * at + offset) - F.floor(rate * (at - 1) + offset)).cast("long")
    return numbered.join(starts, groups).select(
        "doc_id", size.alias("size"), F.col("mix_total").alias("source_size"), F.col("mix_target").alias("target"), (copies * size).alias("taken"), copies.alias("copies"), *(["row"] if carry else [])
    )


def emit(df: DataFrame, **given) -> DataFrame:
    """The mix itself: the rows of `df`, each as often as `mix` takes it, with the columns of `df`."""
    mixed = mix(df, carry=df.columns, **given).filter(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS digest
  FROM documents),
 sized AS (
  SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM base GROUP BY source),
 weighed AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[place % 3 + 1] AS weight, total * 2.0::DOUBLE AS most FROM sized),
 levels AS (
  SELECT *, most / weight AS ratio,
    (sum(total) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
 goals AS (
  SELECT source, total, least(most, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level < ratio) * weight, most)) AS target,
    (('0x' || substr(md5('mix|' || coalesce('s' || source, 'n')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS shift
  FROM levels),
 ranked AS (
  SELECT b.doc_id, b.size, g.total, g.target, g.shift, CASE WHEN g.total > 0 THEN g.target / g.total ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY b.source ORDER BY length(bin(b.size)) * 16 + (b.size >> greatest(length(bin(b.size)) - 4, 0)), substr(b.digest, 1, 2), b.size, b.digest) AS place
  FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, total AS source_size, target, copies * size AS taken, copies
FROM (SELECT *, (floor(rate * place + shift) - floor(rate * (place - 1) + shift))::BIGINT AS copies FROM ranked)
"""
