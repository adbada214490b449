"""Removal of passages that occur in earlier documents, behind a count-min prefilter.

Windows of 13 words are too many to be grouped one by one. A first pass adds every window to a
count-min sketch, one for each partition, which is sent as the cells it has met; those of all
partitions are summed up by ranges of cells. A second pass looks every
window up and groups, exactly and by 128-bit digest, only those that the sketch puts into two
documents or more. The sketch only ever overestimates, so no repeated window is lost.

A window enters the sketch under its least inner gram of 5 words. Equal windows have the same
least gram, so the gram's count is no less than the window's; and since neighbouring windows mostly
share theirs, the sketch holds about a fifth of what the windows themselves would take. Counters
stop at 2, which is all that is asked of them, and are kept as two bits in two bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, in_arrow, map_columns, meet_in_one, schema_of, slices, stored, table

WINDOW = 13
GRAM = 5
DEPTH = 2
#: Cells in each row of the sketch: at least four for each least gram of the corpus, a power of two, but never more than this. A fuller sketch lets more windows through to the exact grouping; it loses none.
MOST_CELLS = 1 << 29
LEAST_CELLS = 1 << 18
#: Cells whose counts of all partitions are summed up at once.
CHUNK = 1 << 22
#: Ids of copies are broadcast up to this many; more are met by a shuffle.
BROADCAST_ROWS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b + _ODD + (a << np.uint64(6)))) * _ODD
    return h ^ (h >> np.uint64(29))


#: Bytes whose running sums are held at once.
SPAN = 1 << 20
_BASE = 0x100000001B3  # odd, so that it has an inverse


def _powers(base: int) -> np.ndarray:
    out = np.full(SPAN, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def _scales() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2^64."""
    return _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from differences of running sums. Different words may share one: that only lets more windows through."""
    up, down = _scales()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + SPAN - 1))
        if j == i:  # one word longer than the span
            out[i] = zlib.crc32(line[starts[i] : ends[i]])
            i += 1
            continue
        at = starts[i]
        sums = np.zeros(int(ends[j - 1] - at) + 1, np.uint64)
        np.cumsum((line[at : ends[j - 1]].astype(np.uint64) + np.uint64(1)) * up[: len(sums) - 1], dtype=np.uint64, out=sums[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return out ^ (out >> np.uint64(31))


def least_grams(a: np.ndarray) -> np.ndarray:
    """From the hashes of words, the least hash among the grams of the window that starts at each word."""
    if len(a) < WINDOW:
        return np.empty(0, np.uint64)
    pairs = _mix(a[:-1], a[1:])
    grams = _mix(_mix(pairs[:-3], pairs[2:-1]), a[4:])
    two = np.minimum(grams[:-1], grams[1:])
    four = np.minimum(two[:-2], two[2:])
    return np.minimum(np.minimum(four[:-5], four[4:-1]), grams[8:])


@dataclass
class Layout:
    """The words of several texts in one line, a space after each."""

    line: np.ndarray
    starts: np.ndarray  # of words in the line
    ends: np.ndarray
    first: np.ndarray  # for each window inside a text: its first word
    owner: np.ndarray  # its text
    place: np.ndarray  # its first word, counted in the text


def laid_out(texts: list[str | None]) -> Layout:
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"".join(x for p in parts for x in (p, b"\n")), np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    after_white = np.concatenate([[True], white[:-1]]) if len(raw) else white
    starts, ends = np.flatnonzero(~white & after_white), np.flatnonzero(white & ~after_white)
    words = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)])))
    line = np.where(white, np.uint8(32), raw)[~(white & after_white)]
    lengths = ends - starts
    ends = np.cumsum(lengths + 1) - 1
    sizes = np.maximum(words - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return Layout(line, ends - lengths, ends, place + (np.cumsum(words) - words)[owner], owner, place)


def cells_of(grams: np.ndarray, row: int, cells: int) -> np.ndarray:
    h = (grams ^ _SEEDS[row]) * _ODD
    return (h ^ (h >> np.uint64(32))) & np.uint64(cells - 1)


def added(held: dict[int, tuple[np.ndarray, np.ndarray]], grams: np.ndarray, cells: int) -> None:
    """Add grams to a sketch kept as, for each chunk of cells that it has met, the cells and their counts up to 2."""
    for row in range(DEPTH):
        met, counts = np.unique(cells_of(grams, row, cells), return_counts=True)
        met = met.astype(np.int64) + row * cells
        counts = np.minimum(counts, 2).astype(np.uint8)
        edges = [0, *(np.flatnonzero(np.diff(met // CHUNK)) + 1).tolist(), len(met)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                chunk, own, n = int(met[a] // CHUNK), (met[a:b] % CHUNK).astype(np.uint32), counts[a:b]
                if chunk in held:
                    own, back = np.unique(np.concatenate([held[chunk][0], own]), return_inverse=True)
                    n = np.minimum(np.bincount(back, np.concatenate([held[chunk][1], n]), len(own)), 2).astype(np.uint8)
                held[chunk] = own, n


def twice(bitmaps: np.ndarray, grams: np.ndarray, cells: int) -> np.ndarray:
    """Whether the merged sketch puts a gram into two documents or more."""
    out = np.ones(len(grams), bool)
    for row in range(DEPTH):
        at = cells_of(grams, row, cells)
        out &= (bitmaps[row, at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def merged_sketch(texts: DataFrame, cells: int) -> np.ndarray:
    """The bitmaps of cells that reach 2 in the sum of all partitions' sketches."""
    spark = texts.sparkSession
    schema = "chunk int, cells binary, counts binary"
    arrow = schema_of(spark, schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting, n = [], 0
        for part in slices(batches):
            own = laid_out(part.column(0).to_pylist())
            if not len(own.first):
                continue
            grams, owner = least_grams(word_hashes(own.line, own.starts, own.ends))[own.first], own.owner
            changes = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]))
            grams, owner = grams[changes], owner[changes]
            order = np.lexsort((grams, owner))  # once a document
            grams, owner = grams[order], owner[order]
            waiting.append(grams[np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])])
            n += len(waiting[-1])
            if n > 1_000_000:
                added(held, np.concatenate(waiting), cells)
                waiting, n = [], 0
        if waiting:
            added(held, np.concatenate(waiting), cells)
        for chunk, (own, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([own.tobytes()]), pa.array([counts.tobytes()])], schema=arrow)

    def merge(part: pa.Table) -> pa.Table:
        total = np.zeros(min(CHUNK, DEPTH * cells), np.uint8)
        for own, counts in zip(part["cells"], part["counts"], strict=True):
            at = np.frombuffer(own.as_buffer(), np.uint32)
            total[at] = np.minimum(total[at] + np.frombuffer(counts.as_buffer(), np.uint8), 2)
        return pa.table([part["chunk"][:1], pa.array([np.packbits(total == 2, bitorder="little").tobytes()]), pa.array([b""])], schema=arrow)

    rows = in_arrow(texts, build, schema).groupBy("chunk").applyInArrow(merge, schema).select("chunk", "cells").collect()
    whole = np.zeros(DEPTH * cells // 8, np.uint8)
    for row in rows:
        whole[row["chunk"] * CHUNK // 8 : row["chunk"] * CHUNK // 8 + len(row["cells"])] = np.frombuffer(row["cells"], np.uint8)
    return whole.reshape(DEPTH, -1)


def candidates(texts: DataFrame, sent, cells: int) -> DataFrame:
    """(high, low, doc_id, tag_place) of each window that may be repeated: its 128-bit digest, its document, and tag << 32 | first word."""
    import xxhash

    schema = f"high long, low long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, tag_place long"
    arrow = schema_of(texts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in slices(batches):
            own = laid_out(part.column("text").to_pylist())
            if not len(own.first):
                continue
            may = np.flatnonzero(twice(sent.value, least_grams(word_hashes(own.line, own.starts, own.ends))[own.first], cells))
            if not len(may):
                continue
            first, owner, place = own.first[may], own.owner[may], own.place[may]
            line = own.line.tobytes()
            found = b"".join([digest(line[a:b]) for a, b in zip(own.starts[first].tolist(), own.ends[first + WINDOW - 1].tolist(), strict=True)])
            pairs = np.frombuffer(found, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), part.column("doc_id").take(pa.array(owner)), pa.array(np.asarray(part.column("tag")).astype(np.int64)[owner] << 32 | place)], schema=arrow)

    return in_arrow(texts, run, schema)


def _grouped(rows: DataFrame, *by: str) -> DataFrame:
    """Keys that two documents or more have: with the least id, and how many rows. A null id is greater than all others."""
    found = rows.groupBy(*by).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max(F.col("doc_id").isNull()).alias("none"), F.count(F.lit(1)).alias("n"))
    return found.filter("first_id < last_id OR none AND first_id IS NOT NULL").select(*by, "first_id", "n")


LATER = "doc_id > first_id OR doc_id IS NULL"


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, text, places): each document's windows, by first word, that also start in a document of a smaller id. Copies of a whole text have the one place -1."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    digests = stored(rows.select("doc_id", "tag", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.length("text").alias("chars")))
    groups = stored(_grouped(digests, "digest"))
    copies = stored(meet_in_one(digests, groups, ["digest"]).filter(LATER).select(F.col("doc_id").alias("copy_id"), F.col("tag").alias("copy_tag")).distinct())
    size = digests.agg(F.sum("chars").alias("chars")).first()["chars"] or 0
    is_copy = F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("tag") == F.col("copy_tag"))
    texts = rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, is_copy, "left_anti")
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * size // 30).bit_length()))  # about 6 characters a word, and a new least gram every 5 words
    sent = spark.sparkContext.broadcast(merged_sketch(texts.select("text"), cells))
    met = stored(candidates(texts.select("doc_id", "tag", "text"), sent, cells))
    windows = stored(_grouped(met, "high", "low"))
    hits = meet_in_one(met, windows, ["high", "low"]).filter(LATER).select("doc_id", "tag_place")
    places = stored(hits.groupBy("doc_id", F.shiftright("tag_place", 32).cast("int").alias("tag")).agg(F.collect_list(F.col("tag_place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("places")))
    forget(met, windows, digests, groups)
    marks = places.unionByName(copies.select(F.col("copy_id").alias("doc_id"), F.col("copy_tag").alias("tag"), F.array(F.lit(-1)).alias("places")))
    marks = marks.select(F.col("doc_id").alias("copy_id"), F.col("tag").alias("copy_tag"), "places")
    return rows.join(marks, is_copy, "left").select("doc_id", "tag", "text", "places")


def strip(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space).

    A word goes if it is covered by a window of 13 words that also starts in a document of a smaller
    id. Null texts have no words; texts of fewer than 13 words keep theirs; rows that share an id are
    one document for the comparison and rows each in the result; ids are numbers or text, a null id
    is greater than all others; an empty table gives no rows. Other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    return map_columns(repeated(df, key, text), lambda x: _stripped(x, False), f"doc_id {kind}, n_words long, n_removed long, kept string")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As strip(), but with the SHA-256 of the kept text in its place."""
    kind = df.schema[key].dataType.simpleString()
    return map_columns(repeated(df, key, text), lambda x: _stripped(x, True), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def _stripped(x: dict, digest: bool) -> dict:
    ids, kept, n_words, n_removed = [], [], [], []
    for doc_id, text, places in zip(x["doc_id"], x["text"], x["places"], strict=True):
        words = split(text)
        n = len(words)
        if places and places[0] < 0:  # a copy: all its windows start in the first of its kind
            left = words if n < WINDOW else []
        elif places:
            edges = np.zeros(n + 1, np.int32)
            own = np.array(places)
            np.add.at(edges, own, 1)
            np.add.at(edges, own + WINDOW, -1)
            left = [w for w, c in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not c]
        else:
            left = words
        line = b" ".join(left)
        ids.append(doc_id)
        n_words.append(n)
        n_removed.append(n - len(left))
        kept.append(hashlib.sha256(line).hexdigest() if digest else line.decode("utf-8", "surrogatepass"))
    return {"doc_id": ids, "n_words": n_words, "n_removed": n_removed, "kept_sha256" if digest else "kept": kept}


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
 windows AS (
  SELECT doc_id, place, array_to_string(words[place + 1 : place + 13], ' ') AS line
  FROM (SELECT doc_id, words, unnest(range(len(words) - 12)) AS place FROM base WHERE len(words) >= 13)),
 hits AS (
  SELECT doc_id, place FROM (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY line) AS first_id FROM windows) WHERE doc_id > first_id),
 covered AS (
  SELECT doc_id, list(DISTINCT word) AS gone FROM (SELECT doc_id, unnest(range(place, place + 13)) AS word FROM hits) GROUP BY doc_id),
 kept AS (
  SELECT b.doc_id, len(b.words) AS n_words, coalesce(len(c.gone), 0) AS n_removed, b.words, c.gone FROM base b LEFT JOIN covered c USING (doc_id)),
 word AS (
  SELECT doc_id, words, gone, unnest(range(len(words))) AS place FROM kept WHERE n_removed > 0),
 lines AS (
  SELECT w.doc_id, string_agg(w.words[w.place + 1], ' ' ORDER BY w.place) AS line
  FROM word w LEFT JOIN (SELECT doc_id, unnest(gone) AS place FROM covered) g USING (doc_id, place) WHERE g.doc_id IS NULL GROUP BY w.doc_id)
SELECT k.doc_id, k.n_words, k.n_removed, sha256(CASE WHEN k.n_removed = 0 THEN array_to_string(k.words, ' ') ELSE coalesce(l.line, '') END) AS kept_sha256
FROM kept k LEFT JOIN lines l USING (doc_id)
"""
