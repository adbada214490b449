"""Changes of tables, relations, constraints, shards and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import ddl, dml, relations, services
from .catalogue import register


@register("insert_from", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region")
def _(db):
    return dml.insert_from(db.frame("nation").select("n_nationkey", "n_name", "n_regionkey"), db.find("region").select("r_regionkey + 100 AS k", "r_name", "r_regionkey").get(), ["n_nationkey", "n_name", "n_regionkey"])


@register("insert_rows", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'NEW' UNION ALL SELECT 10, NULL")
def _(db):
    return dml.insert(db.frame("region").select("r_regionkey", "r_name"), [{"r_regionkey": 9, "r_name": "NEW"}, {"r_regionkey": 10}])


@register("replace_rows", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'ONE' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'NINE'")
def _(db):
    return dml.replace(db.frame("region").select("r_regionkey", "r_name"), [{"r_regionkey": 1, "r_name": "ONE"}, {"r_regionkey": 9, "r_name": "NINE"}], "r_regionkey")


@register("upsert", "SELECT s_suppkey AS id, CASE WHEN s_suppkey IN (1, 2, 3) THEN round(s_acctbal + 1.5, 4) ELSE round(s_acctbal, 4) END AS v FROM supplier UNION ALL SELECT 100000, 7.0")
def _(db):
    table = db.find("supplier").select({"id": "s_suppkey", "v": "s_acctbal"}).get()
    changed = dml.upsert(table, [{"id": 1, "v": 7.0}, {"id": 2, "v": 7.0}, {"id": 3, "v": 7.0}, {"id": 100000, "v": 7.0}], {"v": fn.inc(1.5)})
    return changed.select("id", F.round("v", 4).alias("v"))


@register("merge", """
SELECT c.c_custkey, CASE WHEN t.o_custkey IS NULL THEN c.c_acctbal ELSE t.total END AS c_acctbal FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) t ON c.c_custkey = t.o_custkey
UNION ALL SELECT 900000 + n_nationkey, 1.0 FROM nation""")
def _(db):
    table = db.frame("customer").select("c_custkey", "c_acctbal")
    best = db.frame("orders").filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    source = best.unionByName(db.frame("nation").select((F.col("n_nationkey") + 900000).cast("long").alias("c_custkey"), F.lit(1.0).alias("c_acctbal")))
    return dml.merge(table, source, "c_custkey", ["c_acctbal"], True)


@register("merge_delete", "SELECT s.s_suppkey, CASE WHEN s.s_acctbal > 0 THEN 0.0 ELSE s.s_acctbal END AS s_acctbal FROM supplier s WHERE s.s_suppkey IN (SELECT n_nationkey FROM nation)")
def _(db):
    source = db.frame("nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"))
    return dml.merge(db.frame("supplier").select("s_suppkey", "s_acctbal"), source, "s_suppkey", {"s_acctbal": 0.0}, (), True, "t.s_acctbal > 0")


@register("update", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN 'big' ELSE p_type END AS p_type FROM part")
def _(db):
    return dml.update(db.frame("part").select("p_partkey", "p_size", "p_type"), {"p_size": fn.inc(1), "p_type": "big"}, "p_size > 25")


@register("update_limit", "SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 3) THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(db):
    return dml.update(db.frame("supplier").select("s_suppkey", "s_acctbal"), {"s_acctbal": 0.0}, "s_acctbal > 0", 3, ["s_suppkey"])


@register("update_join", "SELECT s.s_suppkey, CASE WHEN n.n_regionkey = 2 THEN n.n_name ELSE s.s_name END AS s_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def _(db):
    nations = db.frame("nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return dml.update_join(db.frame("supplier").select("s_suppkey", "s_name", "s_nationkey"), nations, "s_nationkey", {"s_name": F.col("s.n_name")}, "s.n_regionkey = 2").drop("s_nationkey")


@register("delete", "SELECT doc_id, quality FROM labels WHERE NOT coalesce(quality = 1 AND toxic = 1, false)")
def _(db):
    return dml.delete(db.frame("labels"), "quality = 1 AND toxic = 1").select("doc_id", "quality")


@register("delete_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
def _(db):
    return dml.delete_join(db.frame("customer"), db.frame("orders"), "t.c_custkey = s.o_custkey", "s.o_totalprice > 250000").select("c_custkey")


@register("truncate", "SELECT r_regionkey, r_name FROM region WHERE false")
def _(db):
    return dml.truncate(db.frame("region").select("r_regionkey", "r_name"))


# ---- relations


@register("rel_has_many", "SELECT r.r_name, coalesce(string_agg(n.n_name, ',' ORDER BY n.n_name), '') AS nations FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
def _(db):
    found = relations.has_many(db.frame("region"), db.frame("nation"), "n_regionkey", "r_regionkey", "nations", ["n_name"])
    return found.select("r_name", F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("nations"))


@register("rel_has_one", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey) o ON c.c_custkey = o.o_custkey")
def _(db):
    found = relations.has_one(db.frame("customer"), db.frame("orders"), "o_custkey", "c_custkey", "order", ["o_orderdate", "o_orderkey"])
    return found.select("c_custkey", F.col("order.o_orderkey").alias("o_orderkey"))


@register("rel_belongs_to", "SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def _(db):
    return relations.belongs_to(db.frame("supplier"), db.frame("nation"), "s_nationkey", "n_nationkey", "nation").select("s_suppkey", F.col("nation.n_name").alias("n_name"))


@register("rel_through", "SELECT o.o_orderkey, count(DISTINCT p.p_partkey) AS parts, coalesce(sum(DISTINCT p.p_partkey), 0)::BIGINT AS keys FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1")
def _(db):
    found = relations.has_many_through(db.frame("orders").select("o_orderkey"), db.frame("lineitem"), db.frame("part"), "l_orderkey", "l_partkey", "o_orderkey", "p_partkey", "parts", ["p_partkey"])
    return found.select("o_orderkey", F.size("parts").cast("long").alias("parts"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["p_partkey"]).alias("keys"))


@register("row_rules", "SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN CASE WHEN n_chars < 500 THEN 'lang,short' ELSE 'lang' END ELSE 'short' END AS broken FROM documents WHERE lang NOT IN ('en', 'fr') OR n_chars < 500")
def _(db):
    found = relations.violations(db.frame("documents"), {"lang": F.col("lang").isin("en", "fr"), "short": relations.integer("n_chars", 500)})
    return found.select("doc_id", F.array_join("broken_rules", ",").alias("broken"))


@register("check_constraints", "SELECT 'fk' AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 10) UNION ALL SELECT 'uq', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'ck', count(*) FROM orders WHERE NOT o_totalprice < 300000")
def _(db):
    held = ddl.Constraints()
    held.add_foreign_key("fk", "orders", ["o_custkey"], "customer", ["c_custkey"])
    held.add_unique("uq", "orders", ["o_custkey"])
    held.add_check("ck", "orders", "o_totalprice < 300000")
    broken = held.violations("orders", {"orders": db.frame("orders"), "customer": db.frame("customer").filter("c_custkey > 10")})
    out = None
    for name, rows in broken.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


# ---- shards and search


@register("shard_modulo", "SELECT o_orderkey, CAST(o_orderkey % 4 + 1 AS INTEGER) AS shard FROM orders")
def _(db):
    return db.find("orders").select("o_orderkey", {"shard": services.modulo_shard("o_orderkey", 4)})


@register("shard_range", "SELECT o_orderkey, CASE WHEN o_orderkey <= 1000 THEN 'a' ELSE 'b' END AS shard FROM orders")
def _(db):
    return db.find("orders").select("o_orderkey", {"shard": services.range_shard("o_orderkey", [("a", 0, 1000), ("b", 1001, 1 << 60)])})


_CRC = "(SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"
_OCTETS = "list_transform(range(length(o_orderkey::VARCHAR)), lambda i: ascii(substr(o_orderkey::VARCHAR, i + 1, 1))::BIGINT)"


@register("shard_hash", f"SELECT o_orderkey, (xor(list_reduce(list_prepend(4294967295::BIGINT, {_OCTETS}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 4 + 1)::INTEGER AS shard FROM orders, {_CRC}")
def _(db):
    return db.find("orders").select("o_orderkey", {"shard": services.hash_shard("o_orderkey", 4)})


@register("table_search", "SELECT s_suppkey FROM supplier WHERE s_suppkey::VARCHAR LIKE '%12%' OR s_name LIKE '%12%' OR s_nationkey::VARCHAR LIKE '%12%' OR s_acctbal::VARCHAR LIKE '%12%'")
def _(db):
    return services.search(db.frame("supplier"), "12").select("s_suppkey")


@register("ext_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(db):
    from ..streaming import windows

    found = windows.windowed(db.frame("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], measure="value")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
