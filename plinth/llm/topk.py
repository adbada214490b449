"""Exact top-k search: tiled matrix products of queries and candidate shards, merged in a tree.

Candidates are dealt once into shards that a task can hold; queries are sent to every shard and
stream past it. Neither side is broadcast or comes to the driver, and the table is read three times
however many queries and shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import in_arrow, schema_of, table

#: Bytes of the vectors of one shard, as doubles. A task holds its shard; queries go past it a tile at a time.
SHARD_BYTES = 64 << 20
#: Queries and candidates of one matrix product.
TILE_QUERIES, TILE_ROWS = 512, 2048
#: Top lists merged by one node of the tree.
FAN_IN = 8
_WHOLE = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantized(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, x as double."""
    return np.floor(vectors.astype(np.float64) * scale)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products. In doubles while no partial sum can pass 2^53, else in Python's integers, held to 64 bits."""
    bound = (np.abs(queries).max(initial=0.0) * np.abs(rows).max(initial=0.0)) * queries.shape[1]
    if bound < _WHOLE:
        return (queries @ rows.T).astype(np.int64)
    big = [[int(x) for x in row] for row in rows]
    return np.array([[min(_MOST, max(_LEAST, sum(a * b for a, b in zip(q, row, strict=True)))) for row in big] for q in ([int(x) for x in v] for v in queries)], dtype=np.int64).reshape(len(queries), len(rows))


class Best:
    """The k best of each query of a block so far: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.score, self.vec = np.empty(0, np.int64), np.empty(0, np.int64), ids[:0]
        self.floor = np.full(len(ids), _LEAST, np.int64)  # a score below it can't be among the best

    def add(self, start: int, scores: np.ndarray, vec: np.ndarray) -> None:
        """scores: of the queries from `start` on, against the rows `vec`."""
        floor = self.floor[start : start + len(scores)]
        other = self.ids[start : start + len(scores), None] != vec[None, :]  # rows with a query's own id are none of its candidates, however many there are
        if scores.shape[1] > 4 * self.k:
            floor = np.maximum(floor, np.partition(np.where(other, scores, _LEAST), -self.k, axis=1)[:, -self.k])
        at, row = np.nonzero((scores >= floor[:, None]) & other)
        held = (self.query >= start) & (self.query < start + len(scores))
        query = np.concatenate([self.query[held], start + at])
        score = np.concatenate([self.score[held], scores[at, row]])
        ids = np.concatenate([self.vec[held], vec[row]])
        order = np.lexsort((ids, ~score, query))  # ~x turns the order around and can't overflow
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]
        keep = rank < self.k
        self.query, self.score, self.vec = (np.concatenate([old[~held], new[keep]]) for old, new in ((self.query, query), (self.score, score), (self.vec, ids)))


def _matrices(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, quantized matrix) for each length of vector."""
    lengths = np.asarray(vectors.value_lengths())
    names = np.array(ids.to_pylist(), str) if pa.types.is_string(ids.type) else np.asarray(ids)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        yield names[own], quantized(np.asarray(vectors.take(pa.array(own)).flatten()).reshape(len(own), int(n)), scale)


def valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def top_k(df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The k best other rows of each row for which `queries` holds, by the inner product of floor(scale * x).

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller id. Ids are whole
    numbers (longs in the result) or text. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; vectors of different lengths don't meet; a
    query has fewer rows where there are fewer candidates and none where there is none; an empty
    table gives none. Rows with a query's own id are no candidates of it; rows that share an id are
    candidates each, and as queries they count once, with their least vector. Scores beyond 64 bits
    are held at the limit. Other columns are not read.
    """
    spark = df.sparkSession
    kind = "string" if df.schema[key].dataType == StringType() else "long"
    own = [F.col(key).cast(kind).alias("vec_id"), F.col(vector).alias("vector")]
    held = F.col("vec_id").isNotNull() & valid(F.col("vector"))
    rows, asked = df.select(*own).filter(held), df.filter(queries).select(*own).filter(held)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    shards = max(spark.sparkContext.defaultParallelism, -(-found["n"] * 8 * max(1, found["width"] or 1) // SHARD_BYTES))
    # By place and not by id: rows of one id may be any share of the table.
    dealt = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "vector")
    sent = asked.groupBy("vec_id").agg(F.min("vector").alias("vector")).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "vector")
    met = dealt.unionByName(sent).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks")
    schema = f"query_id {kind}, shard int, vec_id {kind}, score long"
    return merged(in_arrow(met, _search(k, scale, schema_of(spark, schema)), schema), k, shards)


def _tiles(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Parts put together by their width and cut into tiles."""
    out = []
    for width in {m.shape[1] for _, m in parts}:
        own = [x for x in parts if x[1].shape[1] == width]
        ids, whole = np.concatenate([i for i, _ in own]), np.concatenate([m for _, m in own])
        out += [(ids[at : at + TILE_ROWS], whole[at : at + TILE_ROWS]) for at in range(0, len(ids), TILE_ROWS)]
    return out


def _search(k: int, scale: float, schema: pa.Schema):
    """Over rows sorted by shard, candidates before queries: the top lists of the queries in each shard."""

    def lists(shard: int, asked: pa.RecordBatch, tiles: list) -> Iterator[pa.RecordBatch]:
        for at in range(0, asked.num_rows, TILE_QUERIES):
            part = asked.slice(at, TILE_QUERIES)
            for ids, queries in _matrices(part.column("vec_id"), part.column("vector"), scale):
                best = Best(ids, k)
                for vec, rows in tiles:
                    if rows.shape[1] == queries.shape[1]:
                        best.add(0, products(queries, rows), vec)
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.query], schema.field(0).type), pa.array(np.full(len(best.query), shard, np.int32)), pa.array(best.vec, schema.field(2).type), pa.array(best.score)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tiles = -1, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = np.asarray(batch.column("shard")).astype(np.int64) * 2 + np.asarray(batch.column("asks").cast(pa.int8()))
            edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for a, b in zip(edges, edges[1:], strict=False):
                shard, asks = divmod(int(runs[a]), 2)
                if shard != now:
                    now, parts, tiles = shard, [], []
                own = batch.slice(a, b - a)
                if not asks:
                    parts += _matrices(own.column("vec_id"), own.column("vector"), scale)
                    continue
                if parts:
                    tiles, parts = _tiles(parts), []
                yield from lists(shard, own, tiles)

    return run


def merged(lists: DataFrame, k: int, shards: int) -> DataFrame:
    """Merge the shards' top lists, FAN_IN at a time, and number the last ones."""
    entry = F.struct((-1 - F.col("score")).alias("low"), F.col("vec_id").alias("vec_id"))
    tree = lists.groupBy("query_id", "shard").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("top"))
    while shards > 1:
        shards = -(-shards // FAN_IN)
        tree = tree.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return tree.select("query_id", F.posexplode("top").alias("place", "entry")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("entry.vec_id").alias("vec_id"), (-1 - F.col("entry.low")).alias("score"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
