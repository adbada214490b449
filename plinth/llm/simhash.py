"""SimHash near-duplicates, their fingerprints met through Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments, each padded to the 23 bits of the perfect
Golay code. A word of 23 bits has one codeword within 3 bits; those within 4 bits are that one and,
if it is 3 bits away, five more (its `ball`). Words within 2 bits share a ball member: the codeword
nearest to a word half way lies within 4 bits of both. Words within 1 bit also have each other's
nearest codeword in their balls.

Of 4 differing bits over three segments, either one segment has none and another at most 2, or two
segments have at most 1 each. So two fingerprints at most 4 bits apart share a key
(segment, segment's bits; other segment, ball member) or a key (two segments; nearest codeword of
one, ball member of the other). Rows that share a key are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, in_arrow, map_columns, meet, schema_of, stored, table
from .components import components

SEED = 42
SHINGLE = 4
MOST_BITS = 4
#: The Golay code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key held by a task. Keys with more are dealt out anew by (key, one of five parts of the bits that it doesn't share yet): 4 differing bits leave a part alike.
HELD = 4096
PARTS = MOST_BITS + 1
#: With so few bits left, a key holds no more fingerprints than HELD.
FEW_BITS = 12
#: Pairs compared at once.
BLOCK = 1024


def fingerprint(text: str | None) -> int:
    """Bit j is set if it is set in over half the XXH64 hashes of the text's word shingles; no words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, size = b" ".join(words), max(len(words) - SHINGLE + 1, 1)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: size - 1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[min(SHINGLE, len(words)) - 1 :], strict=True)], np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > size, bitorder="little").view("<u8")[0])


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of h * x^11; for each syndrome, what to add to a word to get at each member of its ball, and the size of the ball."""

    def remainder(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - 11)
        return v

    tops = np.array([remainder(h << 11) for h in range(4096)], np.int64)
    sevens = [c for h in range(4096) if (c := h << 11 | int(tops[h])).bit_count() == 7]
    masks, sizes = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for weight in range(4):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            syndrome = remainder(error)
            masks[syndrome, 0] = error
            if weight == 3:
                masks[syndrome, 1:] = [error ^ c for c in sevens if c & error == error]
                sizes[syndrome] = 6
    return tops, masks, sizes


def balls(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ball members of 23-bit words, the nearest first (n x 6), and which are real."""
    tops, masks, sizes = _golay()
    syndrome = (words & 2047) ^ tops[words >> 11]
    return (words[:, None] ^ masks[syndrome]) >> 11, np.arange(6) < sizes[syndrome][:, None]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows for fingerprints given as uint64."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    ball = [balls(p) for p in parts]
    out, who = [], []

    def put(key: np.ndarray, real: np.ndarray) -> None:
        at = np.nonzero(real)
        out.append(key[at])
        who.append(prints[at[0]])

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                put(np.int64(tag) << 36 | (parts[i] << 12)[:, None] | ball[j][0], ball[j][1])
                tag += 1
    for i, j in combinations(range(3), 2):
        (ci, ri), (cj, rj) = ball[i], ball[j]
        put(np.int64(tag) << 36 | (ci[:, :1] << 12) | cj, rj)
        put(np.int64(tag) << 36 | (ci[:, 1:] << 12) | cj[:, :1], ri[:, 1:])
        tag += 1
    return np.concatenate(out), np.concatenate(who)


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected through at most MOST_BITS differing bits: one for each member of a component but its first."""
    n = len(prints)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            near = np.bitwise_count(prints[a : a + BLOCK, None] ^ prints[None, b : b + BLOCK]) <= MOST_BITS
            if a == b:
                near = np.triu(near, 1)
            at, to = np.nonzero(near)
            at, to = at + a, to + b
            while len(at):  # pairs already joined drop out between one merge and the next pass
                for i, j in zip(at[:BLOCK].tolist(), to[:BLOCK].tolist(), strict=True):
                    p, q = find(i), find(j)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                at, to = at[BLOCK:], to[BLOCK:]
                if len(at):
                    while not np.array_equal(root, root[root]):
                        root = root[root]
                    apart = root[at] != root[to]
                    at, to = at[apart], to[apart]
    while not np.array_equal(root, root[root]):
        root = root[root]
    below = np.flatnonzero(root != np.arange(n))
    return prints[below], prints[root[below]]


_LINKS = "a long, b long, shared long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def parts_of(prints: np.ndarray, shared: int) -> list[int]:
    """The bits outside `shared` as PARTS masks, those that differ most among `prints` spread evenly: more than HELD fingerprints differ in 12 bits at least, so that each part tells them apart."""
    ones = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    free = sorted((b for b in range(64) if not shared >> b & 1), key=lambda b: (-min(int(ones[b]), len(prints) - int(ones[b])), b))
    return [sum(1 << b for b in free[k::PARTS]) for k in range(PARTS)]


def dealt(prints: np.ndarray, key: int, shared: int, parts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, key, shared bits) for another round, one row for each part."""
    keys, masks = [], []
    for k, part in enumerate(parts):
        h = (prints & np.uint64(part)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((key * 0xC2B2AE3D27D4EB4F + k * 0x165667B19E3779F9) & ((1 << 64) - 1))
        keys.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
        masks.append(np.full(len(prints), shared | part, np.uint64))
    return np.tile(prints, PARTS), np.concatenate(keys), np.concatenate(masks)


def _linker(schema: pa.Schema):
    """Over rows (key, fingerprint, bits that all of the key share) sorted by key: links of each run of equal keys. Rows of a run beyond HELD leave as (fingerprint, key, shared bits) for another round.

    A round fixes a fifth of the bits in which they differ, so keys shrink from round to round.
    """

    def links(prints: np.ndarray) -> pa.RecordBatch:
        a, b = forest(np.unique(prints))
        return pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.nulls(len(a), pa.int64())], schema=schema)

    def again(prints: np.ndarray, key: int, shared: int, parts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(x) for x in dealt(prints, key, shared, parts)], schema=schema)

    def too_many(n: int, shared: int) -> bool:
        return n > HELD and 64 - shared.bit_count() > FEW_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, now, shared, parts = [], 0, None, 0, None

        def closed() -> Iterator[pa.RecordBatch]:
            if n > 1:
                yield links(np.concatenate(held))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, prints, masks = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2)).view(np.uint64)
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, lengths = np.concatenate([[0], edges]), np.diff(np.concatenate([[0], edges, [len(key)]]))
            yield from pairs(prints, starts[1:-1], lengths[1:-1])
            # The first run may have begun in an earlier batch, and the last may go on in the next one.
            for k in [0, *(np.flatnonzero(lengths[1:-1] > 2) + 1).tolist(), *([len(starts) - 1] if len(starts) > 1 else [])]:
                a, size = int(starts[k]), int(lengths[k])
                if int(key[a]) != now:
                    yield from closed()
                    held, n, now, shared, parts = [], 0, int(key[a]), int(masks[a]), None
                held.append(prints[a : a + size].copy())
                n += size
                if parts or too_many(n, shared):
                    whole = np.concatenate(held)
                    parts = parts or parts_of(whole, shared)
                    yield again(whole, now, shared, parts)
                    held, n = [], 0
        yield from closed()

    def pairs(prints: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Runs of two, all at once."""
        two = starts[lengths == 2]
        a, b = prints[two], prints[two + 1]
        near = (np.bitwise_count(a ^ b) <= MOST_BITS) & (a != b)
        if near.any():
            yield pa.RecordBatch.from_arrays([_signed(a[near]), _signed(b[near]), pa.nulls(int(near.sum()), pa.int64())], schema=schema)

    return run


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of the column `print`, enough to connect all that are chained by at most MOST_BITS differing bits."""
    spark = prints.sparkSession
    key_schema, link_schema = schema_of(spark, "key long, print long"), schema_of(spark, _LINKS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, own = keys(np.asarray(batch.column(0)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), _signed(own)], schema=key_schema)

    def met(rows: DataFrame, shared: Column) -> DataFrame:
        return stored(in_arrow(rows.repartition("key").sortWithinPartitions("key").select("key", "print", shared.alias("shared")), _linker(link_schema), _LINKS))

    found = met(in_arrow(prints, make, "key long, print long"), F.lit(0).cast("long"))
    out = found.filter("shared IS NULL")
    while not (more := found.filter("shared IS NOT NULL")).isEmpty():
        found = met(more.select(F.col("b").alias("key"), F.col("a").alias("print"), F.col("shared").alias("known")), F.col("known"))
        out = out.unionByName(found.filter("shared IS NULL"))
    return out.select("a", "b")


def _rows(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(doc_id, print) of each row, and the columns `more` (binary)."""
    given = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *[c.alias(f"more_{i}") for i, c in enumerate(more)])

    def run(x: dict) -> dict:
        return x | {"print": np.array([fingerprint(t) for t in x["text"]], np.uint64).view(np.int64)}

    kind = df.schema[key].dataType.simpleString()
    return stored(map_columns(given, run, ", ".join([f"doc_id {kind}, print long", *[f"more_{i} binary" for i in range(len(more))]])))


def _firsts(rows: DataFrame, order: Column) -> DataFrame:
    """(print, n, first, root) of each fingerprint: how many rows have it, the least `order` among them, and the fingerprint that names its component."""
    prints = stored(rows.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")))
    roots = components(links(prints.select("print")))
    return prints.join(roots, prints["print"] == roots["node"], "left").select("print", "n", "first", F.coalesce("root", "print").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links of at most 4 differing bits reach.

    Null, empty and blank texts have the fingerprint zero and link like any other. Equal
    fingerprints are met once, however many rows have them. Rows that share an id are rows each;
    null ids are never a component's id unless it has no other; an empty table gives none. Other
    columns are not read.
    """
    rows = _rows(df, key, text)
    firsts = stored(_firsts(rows, F.col("doc_id")))
    least = stored(firsts.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")))
    classes = stored(meet(firsts, least, ["root"], "members").select("print", "n", "component_id"))
    forget(firsts, least)
    return meet(rows, classes, ["print"]).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one of the least id, null ids last, and of the least digest where rows share that id.

    Rows of null or repeated ids are told apart by a digest of id and text; of rows equal in both,
    which lie in one component, any one stays. Null, empty and blank texts lie in one component. An
    empty table gives none; columns of any name pass.
    """
    same = F.unhex(F.sha2(F.concat_ws("/", F.coalesce(F.sha2(F.col(text), 256), F.lit("")), F.col(key).cast("string")), 256))
    firsts = _firsts(_rows(df, key, text, same), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("more_0").alias("same")))
    kept = firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.same").alias("kept"))
    # Copies of one id go before the shuffle: a window's first places are picked in each partition first.
    place = F.row_number().over(Window.partitionBy("same").orderBy("same"))
    rows = df.select(F.struct("*").alias("row"), same.alias("same")).withColumn("place", place).filter("place = 1")
    return rows.join(kept, F.col("same") == F.col("kept"), "left_semi").select("row.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
