"""Document fingerprints from closed syncmers, with DataFrame functions only.

A k-mer of a text's UTF-8 bytes is an anchor (a closed syncmer) if the least hash among its s-mers
is that of its first or last one. Whether it is one depends on its own bytes alone, so a passage has
the same anchors wherever it stands; two of five places are one. The fingerprint keeps, for each of
64 bins of anchor hashes, the anchor of the least value with its first place: as many as fit a row
that is shuffled with its text, whatever the text's length, and drawn alike from any two texts.

Two fingerprints are matched by position: the anchors that both hold are put in the order of the
one text, and those that follow their predecessor in the other text too are matched. Likeness is
the share of matched bins among those that either text has. A passage that has moved as a whole
keeps its matches but for the one at its edge; anchors that meet by chance stand in no order.

Being free of context, anchors also compose: those of an edited text are the anchors inside the
part that is kept, those inside the part that is put in, and the few across the seam. Only the
last are computed anew.

A fingerprint's entries are longs: 6 bits of the bin, 26 of the value, 31 of the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

K, S = 12, 8
BINS = 64
BIN_AT, VALUE_AT = 57, 31
#: Bytes of a text whose places are listed at a time, so that no list of places is as long as a text.
BLOCK = 4096


def is_anchor(octets: Column, at: Column) -> Column:
    """Whether the k-mer at 1-based `at` is a closed syncmer: no inner s-mer hashes lower than both at the edges."""
    hashes = [F.xxhash64(F.substring(octets, at + i, F.lit(S))) for i in range(K - S + 1)]
    return F.least(*hashes[1:-1]) >= F.least(hashes[0], hashes[-1])


def _hash(octets: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(octets, at, F.lit(K)))


def _bin(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BINS - 1))


def _entry(hashed: Column, place: Column) -> Column:
    value = F.shiftleft(F.shiftrightunsigned(hashed, 64 - (BIN_AT - VALUE_AT)), VALUE_AT)
    return F.shiftleft(_bin(hashed), BIN_AT).bitwiseOR(value).bitwiseOR(place.cast("long"))


def _place(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit((1 << VALUE_AT) - 1))


def _let(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.transform(F.array(value), use)[0]


def anchors(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with place (0-based byte) and hash of each anchor of `text`."""
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.octet_length(text) - K) / BLOCK), F.lit(0)).cast("int"))
    cut = _let(F.col(text).cast("binary"), lambda b: F.transform(blocks, lambda j: F.struct((j * BLOCK).alias("start"), F.substring(b, j * BLOCK + 1, F.lit(BLOCK + K - 1)).alias("octets"))))
    pieces = texts.select(*keep, F.explode(cut).alias("piece")).select(*keep, "piece.start", "piece.octets").filter(F.octet_length("octets") >= K)
    places = pieces.select(*keep, "start", "octets", F.explode(F.sequence(F.lit(1), F.octet_length("octets") - (K - 1))).alias("at"))
    found = places.filter(is_anchor(F.col("octets"), F.col("at")))
    return found.select(*keep, (F.col("start") + F.col("at") - 1).alias("place"), _hash(F.col("octets"), F.col("at")).alias("hash"))


def chained(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tag, n), each once, with the n and key of the document before and the one after; the last is before the first.

    Ranges of ids are ordered on their own; the seams are closed through a table of one row a range,
    which is as small as the number of shuffle partitions and so can be broadcast.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("tag")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).select("*", F.spark_partition_id().alias("part")))
    me = F.struct("doc_id", "tag", "n")
    inside = Window.partitionBy("part").orderBy(*order)
    sort_key = F.struct(F.col("doc_id").isNull(), "doc_id", "tag")
    seams = ranged.groupBy("part").agg(F.min_by(me, sort_key).alias("first"), F.max_by(me, sort_key).alias("last"))
    across = Window.orderBy("part")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seams = seams.select(
        F.col("part").alias("seam"),
        F.coalesce(F.lag("last").over(across), F.last("last").over(whole)).alias("before"),
        F.coalesce(F.lead("first").over(across), F.first("first").over(whole)).alias("after"),
    )
    linked = ranged.select("*", F.lag(me).over(inside).alias("prior"), F.lead(me).over(inside).alias("next")).join(F.broadcast(seams), F.col("part") == F.col("seam"))
    return linked.select(F.col("doc_id").alias("own_id"), F.col("tag").alias("own_tag"), "n", F.coalesce("prior", "before").alias("prior"), F.coalesce("next", "after").alias("next"))


def _or_whole(entries: Column, octets: Column) -> Column:
    """A text without anchors has its own hash for the only one."""
    return F.when(F.size(entries) > 0, entries).otherwise(F.array(_entry(F.xxhash64(octets), F.lit(0))))


def joined(kept: Column, given: Column, start: Column, seam: Column, seam_start: Column) -> Column:
    """The entries of two parts put together, the second one beginning at byte `start`; `seam` holds the bytes around the joint from byte `seam_start` on, less than a k-mer from either part."""
    at = F.when(F.octet_length(seam) >= K, F.sequence(F.lit(1), F.octet_length(seam) - (K - 1))).otherwise(F.array().cast("array<int>"))
    across = F.transform(F.filter(at, lambda i: is_anchor(seam, i)), lambda i: _entry(_hash(seam, i), seam_start + i - 1))
    # Sorted by bin, value and place: the first entry of each bin is its least.
    every = F.sort_array(F.concat(kept, F.transform(given, lambda x: x + start), across))
    return _let(every, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.shiftright(x, BIN_AT) != F.shiftright(F.try_element_at(all_, i), BIN_AT))))


def _bins(entries: Column) -> Column:
    """The bins that have an entry, as bits."""
    return F.aggregate(entries, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, BIN_AT).cast("int"))))


def likeness(a: Column, a_bins: Column, b: Column, b_bins: Column) -> Column:
    """The share of bins matched in order among those that either has."""
    pair = lambda x, other, names: F.shiftleft(_place(x), VALUE_AT).bitwiseOR(_place(F.try_element_at(other, F.array_position(names, F.shiftright(x, VALUE_AT)).cast("int"))))
    names = F.transform(b, lambda y: F.shiftright(y, VALUE_AT))
    # Places in either text of what both hold, in the order of the first one.
    met = _let(names, lambda held: F.transform(F.filter(a, lambda x: F.array_contains(held, F.shiftright(x, VALUE_AT))), lambda x: pair(x, b, held)))
    matched = _let(F.sort_array(met), lambda own: F.filter(own, lambda x, i: (i == 0) | (_place(x) > _place(F.try_element_at(own, i)))))
    return (F.size(matched) / F.bit_count(a_bins.bitwiseOR(b_bins))).cast("double")


def written(entries: Column) -> Column:
    """The entries by bin, each as sixteen hex digits."""
    return F.lower(F.array_join(F.transform(F.sort_array(entries), lambda x: F.lpad(F.hex(x), 16, "0")), ""))


NO_ID = "n"


def _id_text(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("i"), key.cast("string")), F.lit(NO_ID))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited forms.

    The edited text has its last floor(n / 4) characters replaced by as many first ones (or all) of
    the next document by id; the last is followed by the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. Null texts count as
    empty; texts shorter than a k-mer or without anchors have the hash of the whole as their only
    one, at place 0; a null id comes last; rows of one id follow each other in the order of a hash of their
    texts; equal rows are one document and each is returned; an empty table gives none. Other
    columns are not read.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    lengths = rows.select("doc_id", "tag", F.char_length("text").alias("n")).distinct()
    chain = stored(chained(lengths))
    # Joined on a key that is never null, and in which a null id is like no text. The texts cross the network here and only here: all that follows keeps to this partitioning.
    keyed = rows.select(_id_text(F.col("doc_id")).alias("id_text"), "tag", "text")
    links = chain.select(_id_text(F.col("own_id")).alias("id_text"), F.col("own_tag").alias("tag"), "n", "prior")
    texts = keyed.join(links.hint("merge"), ["id_text", "tag"])
    start = F.left(F.col("text"), F.col("n") - F.floor(F.col("n") / 4).cast("int"))
    head = F.left(F.col("text"), F.floor(F.col("prior.n") / 4).cast("int"))
    end = F.col("place") + K
    found = anchors(texts.select("id_text", "tag", "text", F.octet_length(start).alias("kept"), F.octet_length(head).alias("asked")), ["id_text", "tag", "kept", "asked"])
    entry = _entry(F.col("hash"), F.col("place"))
    mins = found.groupBy("id_text", "tag", _bin(F.col("hash")).alias("bin")).agg(
        F.min(entry).alias("all"), F.min(F.when(end <= F.col("kept"), entry)).alias("kept"), F.min(F.when(end <= F.col("asked"), entry)).alias("head")
    )
    # One column, and an exchange that the planner may not leave out: both uses below then read the same, and the anchors are looked for once.
    packed = mins.groupBy("id_text", "tag").agg(F.array(F.collect_list("all"), F.collect_list("kept"), F.collect_list("head")).alias("packed")).hint("rebalance", F.col("id_text"), F.col("tag"))
    nothing = F.array().cast("array<bigint>")
    every = texts.join(packed.hint("merge"), ["id_text", "tag"], "left").withColumn("packed", F.coalesce("packed", F.array(nothing, nothing, nothing)))
    whole = _or_whole(F.col("packed")[0], F.col("text").cast("binary"))
    own = every.select("id_text", "tag", "n", "text", start.alias("start"), whole.alias("entries"), F.col("packed")[1].alias("kept"))
    given = every.select(
        _id_text(F.col("prior.doc_id")).alias("id_text"), F.col("prior.tag").alias("tag"), head.alias("head"), F.col("packed")[2].alias("given"), whole.alias("next_entries")
    ).dropDuplicates(["id_text", "tag"])
    both = own.join(given.hint("merge"), ["id_text", "tag"])
    last = F.greatest(F.octet_length("start") - (K - 2), F.lit(1))
    seam = F.concat(F.substring(F.col("start").cast("binary"), last, F.lit(K - 1)), F.substring(F.col("head").cast("binary"), F.lit(1), F.lit(K - 1)))
    edited = F.concat("start", "head").cast("binary")
    doc_id = F.when(F.col("id_text") != NO_ID, F.substr("id_text", F.lit(2))).cast(df.schema[key].dataType).alias("doc_id")
    done = both.select(doc_id, F.col("n").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), "entries", "next_entries", _or_whole(joined(F.col("kept"), F.col("given"), F.octet_length("start"), seam, last - 1), edited).alias("edited_entries"))
    done = done.select("*", *[_bins(F.col(c)).alias(c.replace("entries", "bins")) for c in ("entries", "next_entries", "edited_entries")])
    return done.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("entries")).alias("fingerprint"), written(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("bins"), F.col("edited_entries"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("entries"), F.col("bins"), F.col("next_entries"), F.col("next_bins")).alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
