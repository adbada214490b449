"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, u hashed
from the row's key and the child's name, and the least draw wins: a child wins in proportion to its
weight, and changing one subtree's weight moves rows only into or out of that subtree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, unit_draw

#: Key groups per shard that number their rows independently; the prefix sums over them are broadcast, and this bounds that broadcast.
SLOT_GROUPS = 256
LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    leaves: tuple[Leaf, ...]

    @classmethod
    def balanced(cls, shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> Tree:
        racks = [s // shards_per_rack for s in range(shards)]
        return cls(tuple(Leaf(f"r{k // racks_per_region}", f"k{k}", s) for s, k in enumerate(racks)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, alone in a region of its own: the only subtree whose weight changes is the new one, so rows move only into the new shard."""
        new = max((x.shard for x in self.leaves), default=-1) + 1
        return Tree((*self.leaves, Leaf(f"grown{new}", f"grown{new}", new, weight)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree(tuple(replace(x, weight=weight) if x.shard == shard else x for x in self.leaves))

    def place(self, key: Column) -> Column:
        """The shard of a key; null keys count as the text `null`."""
        if not self.leaves or any(x.weight <= 0 for x in self.leaves):
            raise ValueError("a tree needs leaves, each of a positive weight")
        text = F.coalesce(key.cast("string"), F.lit("null"))

        def nested(leaves: list[Leaf], levels: tuple[str, ...]) -> Column:
            """The children at a level: an array of (name, weight, below), below a shard number or again such an array."""
            if not levels:
                return F.lit(leaves[0].shard)
            groups: dict[str, list[Leaf]] = {}
            for x in leaves:
                groups.setdefault(str(getattr(x, levels[0])), []).append(x)
            return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(sum(x.weight for x in own))).alias("weight"), nested(own, levels[1:]).alias("below")) for name, own in groups.items()])

        def winner(children: Column, level: str) -> Column:
            """What lies below the child of the least draw; the one-element array binds the children once."""
            draw = lambda child, at: F.struct((-F.ln(unit_draw(F.concat(text, F.lit(f"|{level}|"), child["name"]))) / child["weight"]).alias("draw"), at.alias("at"))
            return F.transform(F.array(children), lambda own: F.element_at(own, F.array_min(F.transform(own, draw))["at"] + 1))[0]["below"]

        return winner(winner(winner(nested(list(self.leaves), LEVELS), "region"), "rack"), "shard").cast("int")


def shard(df: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", grown: Tree | None = None) -> DataFrame:
    """Place every row and number the rows of each shard.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard, whatever else `df` has. Null
    texts have size 1 and the CRC of no bytes; null keys are placed as one key; rows of equal texts
    are placed by their keys, so different ones may part; rows with the same key share a shard and get slots of their own; an empty table gives none. Slots run from 0
    without gaps in each shard: each group of keys numbers its own rows, and the groups' counts are
    added up, so that no task sorts a whole shard.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    group = F.pmod(F.crc32(F.concat(F.lit("slot|"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary")), F.lit(SLOT_GROUPS)).cast("int")
    keys = df.select(F.col(key).alias("doc_id"), tree.place(F.col(key)).alias("shard"), group.alias("slot_group"))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        tree.place(F.col(key)).alias("shard"),
        (grown.place(F.col(key)) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        group.alias("slot_group"),
    )
    counts = keys.groupBy("shard", "slot_group").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slot_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("start_shard"), F.col("slot_group").alias("start_group"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "slot_group").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(order))
    placed = numbered.join(F.broadcast(starts), (F.col("shard") == F.col("start_shard")) & (F.col("slot_group") == F.col("start_group")))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Tree.balanced(16)
    return shard(table(spark, sf_dir, "documents"), tree, grown=tree.grown())


def _draw(name: str, level: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|{level}|{name}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}"


def _least(level: str, children: list[tuple[str, int]]) -> str:
    return "list_min([" + ", ".join(f"{{'d': {_draw(name, level, weight)}, 'n': '{name}'}}" for name, weight in children) + "]).n"


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _crc32(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


OP6_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
    {_least('region', [('r0', 8), ('r1', 8)])} AS region,
    {_least('region', [('r0', 8), ('r1', 8), ('grown16', 1)])} AS grown_region,
    {_least('rack', [('k0', 4), ('k1', 4)])} AS k0, {_least('rack', [('k2', 4), ('k3', 4)])} AS k1,
    [{', '.join(_least('shard', [(str(4 * k + s), 1) for s in range(4)]) + '::INTEGER' for k in range(4))}] AS leaf
  FROM documents),
 placed AS (
  SELECT *, leaf[substr(CASE region WHEN 'r0' THEN k0 ELSE k1 END, 2)::INTEGER + 1] AS shard,
    CASE grown_region WHEN 'grown16' THEN 16 ELSE leaf[substr(CASE grown_region WHEN 'r0' THEN k0 ELSE k1 END, 2)::INTEGER + 1] END AS grown_shard,
    {_crc32("'slot|' || coalesce(doc_id::VARCHAR, 'null')")} % {SLOT_GROUPS} AS slot_group,
    {_crc32('text')} AS text_crc32
  FROM base, (SELECT {_CRC_TABLE} AS crc))
SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY slot_group, doc_id, text_crc32) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard
FROM placed
"""
