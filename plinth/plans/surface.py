"""The rest of the API: loaders and exporters, single values, pages, schemas, constraints, services."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import ddl, dml, lifecycle, paginate, relations, services
from ..sources import files
from ..sources.shared import new_folder
from .catalogue import register


def _frame(db, rows, schema: str):
    return db.spark.createDataFrame(rows, schema)


# ---- sources and exporters

_NATION_TEXT = "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"


@register("prefix_table", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(db):
    db.tables["app_nation"] = db.tables["nation"]
    return db.find().prefix("app_").from_("nation").select("n_nationkey", "n_name").where("n_regionkey", 1)


@register("raw_query_one", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def _(db):
    return _frame(db, [db.raw_query_one("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = :k", {"k": 7})], "n_nationkey int, n_name string")


@register("raw_query_value", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000")
def _(db):
    return _frame(db, [(db.raw_query_value("SELECT count(*) FROM orders WHERE o_totalprice > ?", [1000]),)], "n long")


@register("load_csv", _NATION_TEXT)
def _(db):
    path = new_folder(db.spark)
    files.save_csv(db.frame("nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.load_csv(db.spark, path)


@register("load_csv_fields", "SELECT n_nationkey::VARCHAR AS k, n_name AS name FROM nation")
def _(db):
    path = new_folder(db.spark)
    files.save_csv(db.frame("nation").select("n_nationkey", "n_name", "n_regionkey"), path, ";")
    return files.load_csv(db.spark, path, ["k", "name"], ";", skip=1)


@register("csv_multiline", "SELECT c_custkey::VARCHAR AS k, c_name || chr(10) || ' \"' || c_mktsegment || '\", ' || chr(10) || 'end' AS note FROM customer")
def _(db):
    path = new_folder(db.spark)
    note = F.concat("c_name", F.lit('\n "'), "c_mktsegment", F.lit('", \nend'))
    db.frame("customer").select(F.col("c_custkey").alias("k"), note.alias("note")).write.options(header=True, escape='"').csv(path)
    return files.load_csv(db.spark, path)


@register("load_xml", _NATION_TEXT)
def _(db):
    path = new_folder(db.spark)
    files.save_xml(db.frame("nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.load_xml(db.spark, path, "item").select("n_nationkey", "n_name", "n_regionkey")


@register("load_json_lines", _NATION_TEXT)
def _(db):
    path = new_folder(db.spark)
    files.save_json(db.frame("nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.load_json(db.spark, path)


@register("load_json_array", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def _(db):
    path = new_folder(db.spark)
    _frame(db, [(files.to_json([r.asDict() for r in db.find("region").select("r_regionkey", "r_name").rows()]),)], "value string").coalesce(1).write.text(path)
    return files.load_json(db.spark, path, ["r_regionkey", "r_name"], "auto")


@register("to_csv", "SELECT 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey) AS body FROM region")
def _(db):
    return _frame(db, [(files.to_csv([r.asDict() for r in db.find("region").select("r_regionkey", "r_name").order_by("r_regionkey").rows()]),)], "body string")


@register("to_xml", "SELECT '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<data>' || chr(10) || string_agg('  <item>' || chr(10) || '    <r_name>' || r_name || '</r_name>' || chr(10) || '  </item>' || chr(10), '' ORDER BY r_name) || '</data>' || chr(10) AS body FROM region")
def _(db):
    return _frame(db, [(files.to_xml([r.asDict() for r in db.find("region").select("r_name").order_by("r_name").rows()]),)], "body string")


@register("dump_restore", "SELECT s_suppkey, s_name FROM supplier")
def _(db):
    path = new_folder(db.spark)
    db.dump(path, ["supplier", "region"])
    db.restore(path, ["supplier"])
    return db.find("supplier").select("s_suppkey", "s_name")


@register("seed_table", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def _(db):
    db.create_table("copy_of_nation", {"id": "integer", "name": "string"})
    db.seed("copy_of_nation", db.find("nation").select("n_nationkey", "n_name").get())
    return db.find("copy_of_nation")


# ---- projection and single values


@register("as_raw", "SELECT n_name AS name, n_nationkey + 5 AS k FROM nation")
def _(db):
    return db.find("nation").select(fn.as_("n_name", "name"), fn.raw("n_nationkey + :more", more=5).alias("k"))


@register("option_hint", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def _(db):
    return db.find("orders o").option("shuffle_merge(o)").join("customer c", "o.o_custkey = c.c_custkey").select("o.o_orderkey", "c.c_name")


@register("get_one", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def _(db):
    return _frame(db, [db.find("supplier").select("s_suppkey", "s_name").order_by("s_acctbal DESC, s_suppkey ASC").get_one()], "s_suppkey long, s_name string")


@register("get_column", "SELECT n_name FROM nation")
def _(db):
    return _frame(db, [(x,) for x in db.find("nation").select("n_nationkey", "n_name").get_column("n_name")], "n_name string")


@register("get_value", "SELECT max(o_totalprice) AS high FROM orders")
def _(db):
    return _frame(db, [(db.find("orders").select(fn.max_("o_totalprice").alias("high")).get_value(),)], "high double")


@register("index_rows", "SELECT n_regionkey, max(n_nationkey) AS last FROM nation GROUP BY 1")
def _(db):
    found = db.find("nation").order_by("n_nationkey").index("n_regionkey").rows()
    return _frame(db, [(k, r["n_nationkey"]) for k, r in found.items()], "n_regionkey int, last int")


@register("first_last", "SELECT min(n_nationkey) AS low, max(n_nationkey) AS high FROM nation")
def _(db):
    q = db.find("nation").select("n_nationkey")
    return _frame(db, [(q.first("n_nationkey")[0], q.last("n_nationkey")[0])], "low int, high int")


@register("exists_value", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000) AS some, NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS none")
def _(db):
    return _frame(db, [(db.find("orders").where("o_totalprice", 1000, ">").exists(), db.find("orders").where("o_totalprice", 0, "<").not_exists())], "some boolean, none boolean")


@register("find_by_key", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 5, 7)")
def _(db):
    q = db.find("nation").select("n_nationkey", "n_name")
    return _frame(db, [q.find_one(3, "n_nationkey"), *q.find_all([5, 7], "n_nationkey")], "n_nationkey int, n_name string")


@register("find_by_values", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(db):
    return _frame(db, db.find("nation").select("n_nationkey", "n_name").find_all({"n_regionkey": 2}), "n_nationkey int, n_name string")


# ---- conditions


@register("and_variants", "SELECT p_partkey FROM part WHERE p_size > 3 AND p_name IS NOT NULL AND p_size BETWEEN 5 AND 30 AND p_size NOT BETWEEN 10 AND 12 AND p_size IN (5, 6, 7, 20, 21, 11) AND p_size NOT IN (6) AND p_partkey <> p_size")
def _(db):
    q = db.find("part").select("p_partkey").where("p_size", 3, ">").and_where_not_null("p_name").and_where_between("p_size", 5, 30).and_where_not_between("p_size", 10, 12)
    return q.and_where_in("p_size", [5, 6, 7, 20, 21, 11]).and_where_not_in("p_size", [6]).and_where_column("p_partkey", "!=", "p_size")


@register("and_where_null", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 0 AND o.o_orderkey IS NULL AND c.c_nationkey = 3")
def _(db):
    return db.find("customer c").left_join("orders o", "c.c_custkey = o.o_custkey").select("c.c_custkey").where("c.c_acctbal", 0, ">").and_where_null("o.o_orderkey").and_where("c.c_nationkey", 3)


@register("or_where_not_in", "SELECT n_name FROM nation WHERE n_regionkey = 1 OR n_nationkey NOT IN (1, 2, 3) OR n_nationkey = n_regionkey")
def _(db):
    return db.find("nation").select("n_name").where("n_regionkey", 1).or_where_not_in("n_nationkey", [1, 2, 3]).or_where_column("n_nationkey", "=", "n_regionkey")


@register("json_path_condition", "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 70")
def _(db):
    return db.find("events").select("event_id").where(fn.json_compare("props", "k", ">=", 70))


@register("json_object_columns", "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"none\":null,\"one\":1}' AS o, '[' || n_nationkey || ',\"x\",null]' AS a FROM nation")
def _(db):
    empty = F.lit(None).cast("string")
    return db.find("nation").select("n_nationkey", {"o": fn.json_object({"k": F.col("n_nationkey"), "name": F.col("n_name"), "none": empty, "one": 1})}, {"a": fn.json_array(F.col("n_nationkey"), "x", empty)})


@register("to_char", "SELECT o_orderkey, o_orderkey::VARCHAR AS plain, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(db):
    return db.find("orders").select("o_orderkey", {"plain": fn.to_char("o_orderkey"), "month": fn.to_char("o_orderdate", "yyyy-MM")})


@register("cur_time", "SELECT true AS shaped, true AS close")
def _(db):
    now = F.date_format(F.current_timestamp(), "HH:mm:ss")
    return db.spark.range(1).select(F.regexp_like(fn.cur_time(), F.lit("^[0-9]{2}:[0-9]{2}:[0-9]{2}$")).alias("shaped"), (fn.cur_time() == now).alias("close"))


@register("to_ts", "SELECT o_orderkey, o_orderdate AS at FROM orders")
def _(db):
    text = F.date_format("o_orderdate", "yyyy/MM/dd HH.mm.ss")
    return db.frame("orders").select("o_orderkey", fn.to_ts(text, "YYYY/MM/DD HH24.MI.SS").cast("timestamp_ntz").alias("at"))


@register("fulltext_natural", "SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['licensed', 'password'])")
def _(db):
    return db.find("documents").select("doc_id").where(fn.match("text", "licensed password", "natural"))


@register("fulltext_rank", "SELECT doc_id, round(len(list_filter(w, lambda x: x IN ('the', 'token')))::DOUBLE / greatest(len(w), 1), 6) AS rank FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)")
def _(db):
    return db.find("documents").select("doc_id", {"rank": F.round(fn.match_rank("text", "the & token"), 6)})


# ---- pages, batches


@register("simple_page", "SELECT * FROM (SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 6 OFFSET 12), (SELECT true AS more)")
def _(db):
    page = db.find("nation").select("n_nationkey", "n_name").order_by("n_nationkey").simple_paginate(6, 3)
    return _frame(db, [(*r, page.has_more) for r in page.items], "n_nationkey int, n_name string, more boolean")


@register("numbered_page", "SELECT n_nationkey, (SELECT count(*) FROM nation) AS total, 4::BIGINT AS last_page FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 7")
def _(db):
    page = db.find("nation").select("n_nationkey").order_by("n_nationkey").paginate(7, 2)
    return _frame(db, [(r[0], page.total, page.last_page) for r in page.items], "n_nationkey int, total long, last_page long")


@register("cursor_codec", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
def _(db):
    q = db.find("orders").select("o_orderkey", "o_totalprice").order_by("o_totalprice DESC, o_orderkey ASC")
    key, back = paginate.decode(q.cursor_paginate(10).next_cursor)
    return _frame(db, q.cursor_paginate(10, paginate.encode(key, back)).items, "o_orderkey long, o_totalprice double")


@register("batches", "SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) // 4 AS batch, s_suppkey FROM supplier")
def _(db):
    q = db.find("supplier").select("s_suppkey").order_by("s_suppkey")
    return _frame(db, [(k, r[0]) for k, rows in enumerate(q.batch(4)) for r in rows], "batch long, s_suppkey long")


@register("each_stream", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _(db):
    return _frame(db, [*db.find("nation").select("n_nationkey", "n_name").each(), *db.find("region").select("r_regionkey", "r_name").stream()], "n_nationkey int, n_name string")


# ---- changes


@register("update_limit_ties", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderpriority, o_orderkey) <= 7 THEN 'first' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _(db):
    return dml.update(db.frame("orders").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": "first"}, None, 7, ["o_orderpriority"])


@register("update_limit_nulls", "SELECT k, v, row_number() OVER (ORDER BY v DESC NULLS FIRST, k) <= 30 AS hit FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS v FROM supplier)")
def _(db):
    db.put("held", db.find("supplier").select({"k": "s_suppkey", "v": "CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END", "hit": "false"}).get())
    return db.find("held").order_by("v", "DESC").limit(30).update({"hit": True})


@register("merge_small_source", "SELECT o_orderkey, CASE o_orderkey WHEN 3 THEN 0.5 WHEN 7 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT 90000000, 2.5")
def _(db):
    source = [{"o_orderkey": k, "o_totalprice": v} for k, v in ((3, 0.5), (7, 1.5), (90000000, 2.5))]
    return dml.merge(db.frame("orders").select("o_orderkey", "o_totalprice"), source, "o_orderkey", ["o_totalprice"], True)


@register("update_default", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_name END AS s_name FROM supplier")
def _(db):
    return dml.update(db.frame("supplier").select("s_suppkey", "s_name", "s_nationkey"), {"s_name": fn.default()}, "s_nationkey = 3").drop("s_nationkey")


# ---- schemas and constraints


@register("ddl_create_table", "SELECT * FROM (VALUES (1, 'a', 2.50::DECIMAL(10, 2)), (2, NULL, NULL)) t(id, name, price)")
def _(db):
    db.create_table("things", {"id": "primary_key", "name": "string", "price": ddl.ColumnSchema("decimal", 10, 2)})
    db.create_table("things", {"other": "string"}, if_not_exists=True)
    return dml.insert(db.frame("things"), _frame(db, [(1, "a", "2.50"), (2, None, None)], "id int, name string, price string"))


@register("ddl_columns", "SELECT n_nationkey::VARCHAR AS k, n_name, 'new'::VARCHAR AS kind FROM nation")
def _(db):
    db.put("held", db.frame("nation").select("n_nationkey", "n_name", "n_regionkey"))
    db.add_column("held", "kind", ddl.ColumnSchema("string", default="new"))
    db.drop_column("held", "n_regionkey")
    db.alter_column("held", "n_nationkey", "string")
    db.rename_column("held", "n_nationkey", "k")
    return db.find("held")


@register("ddl_tables", "SELECT * FROM (VALUES ('copy', true, 0), ('dropped', false, NULL), ('old', false, NULL), ('renamed', true, 25)) t(name, there, n)")
def _(db):
    for name in ("copy", "old", "dropped"):
        db.put(name, db.frame("nation").select("n_nationkey"))
    db.truncate_table("copy")
    db.rename_table("old", "renamed")
    db.drop_table("dropped")
    db.drop_table("never", if_exists=True)
    return _frame(db, [(t, db.table_exists(t), db.find(t).count() if db.table_exists(t) else None) for t in ("copy", "dropped", "old", "renamed")], "name string, there boolean, n int")


def _held() -> ddl.Constraints:
    held = ddl.Constraints()
    held.add_primary_key("pk", "orders", ["o_orderkey"])
    held.add_unique("uq", "orders", ["o_custkey", "o_orderdate"])
    held.add_check("ck", "orders", "o_totalprice >= 0")
    held.add_foreign_key("fk", "orders", ["o_custkey"], "customer", ["c_custkey"])
    held.create_index("ix", "orders", ["o_orderdate"], where="o_orderstatus = 'F'", include=["o_totalprice"])
    held.create_fulltext_index("ft", "orders", ["o_orderpriority"])
    return held


@register("ddl_constraint_lists", "SELECT * FROM (VALUES ('check', 'ck', ''), ('foreign', 'fk2', 'o_custkey'), ('fulltext', 'ft', 'o_orderpriority'), ('index', 'ix2', 'o_orderdate'), ('primary', 'pk', 'o_orderkey'), ('unique', 'uq', 'o_custkey,o_orderdate')) t(kind, name, columns)")
def _(db):
    held = _held()
    held.rename("ix", "orders", "ix2")
    held.rename("fk", "orders", "fk2")
    return _frame(db, [(k, c.name, ",".join(c.columns)) for k in ("check", "foreign", "fulltext", "index", "primary", "unique") for c in held.listed("orders", k)], "kind string, name string, columns string")


@register("ddl_constraints_dropped", "SELECT * FROM (VALUES ('ck', true, false), ('fk', true, false), ('ix', true, false), ('pk', true, false), ('uq', true, false)) t(name, before, after)")
def _(db):
    held = _held()
    kinds = {"ck": "check", "fk": "foreign", "ix": "index", "pk": "primary", "uq": "unique"}
    before = {n: held.exists(n, "orders", k) for n, k in kinds.items()}
    for n in kinds:
        held.drop(n, "orders")
    return _frame(db, [(n, before[n], held.exists(n, "orders", k)) for n, k in kinds.items()], "name string, before boolean, after boolean")


@register("ddl_primary_key", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(db):
    db.constraints.add_primary_key("pk", "lineitem", ["l_orderkey"])
    return db.violations("lineitem")["pk"]


@register("ddl_partial_unique", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1")
def _(db):
    db.constraints.create_index("uq", "orders", ["o_custkey"], unique=True, where="o_orderstatus = 'P'")
    return db.violations("orders")["uq"]


@register("ddl_layout", "SELECT * FROM (VALUES ('bloom', 'o_orderkey,o_custkey,o_orderdate'), ('sort_by', 'o_orderkey,o_orderdate')) t(what, columns)")
def _(db):
    return _frame(db, [(k, ",".join(v)) for k, v in _held().layout("orders").items()], "what string, columns string")


@register("describe_table", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(name, kind)")
def _(db):
    return _frame(db, [x[:2] for x in db.find("region").select("r_regionkey", "r_name").describe()], "name string, kind string")


# ---- relations, extension, services


@register("rel_nested", "SELECT r.r_name, coalesce(string_agg(n.n_name || ':' || (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey), ',' ORDER BY n.n_nationkey), '') AS nations FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY 1")
def _(db):
    db.relate("region", "nations", "has_many", "nation", foreign_key="n_regionkey", local_key="r_regionkey")
    db.relate("nation", "suppliers", "has_many", "supplier", foreign_key="s_nationkey", local_key="n_nationkey")
    found = db.find("region").with_related("nations.suppliers").get()
    return found.select("r_name", F.array_join(F.transform("nations", lambda n: F.concat(n["n_name"], F.lit(":"), F.size(n["suppliers"]).cast("string"))), ",").alias("nations"))


@register("validators", "SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 'mail' ELSE 'size' END AS broken FROM part WHERE p_size % 3 = 1 OR p_size > 40 AND p_size % 3 = 0 ORDER BY 1")
def _(db):
    mail = "CASE p_size % 3 WHEN 0 THEN 'a.b@c-d.org' WHEN 1 THEN 'no mail' END"
    rows = db.find("part").select("p_partkey", {"mail": mail, "size": "CASE WHEN p_size % 3 = 0 THEN p_size END"}).get()
    return relations.violations(rows, {"mail": relations.email("mail"), "size": relations.integer("size", 1, 40)}).select("p_partkey", F.array_join("broken_rules", ",").alias("broken"))


@register("plugin_macro", "SELECT n_name FROM nation WHERE n_regionkey = 4")
def _(db):
    class Plugin:
        def register(self, own):
            own.macro("of_region", lambda q, k: q.where("n_regionkey", k))

    db.register_plugin(Plugin())
    return db.find("nation").select("n_name").of_region(4)


@register("sql_layout", "SELECT 'SELECT a' || chr(10) || 'FROM t' || chr(10) || 'WHERE a > 1' || chr(10) || '  AND b < 2' AS body")
def _(db):
    from ..functions.sqltext import format_sql

    return _frame(db, [(format_sql("SELECT a FROM t WHERE a > 1 AND b < 2"),)], "body string")


@register("cache_hits", "SELECT 2 AS misses, 2 AS hits, 0 AS entries, (SELECT count(*) FROM nation) AS n")
def _(db):
    q = db.find("nation").select("n_nationkey").cache("all nations", ttl=600)
    q.get()
    n = q.get().count()
    db.find("nation").delete()  # a change of the table makes the result void
    q.get()
    q.get()
    stats = db.cache.stats()
    db.cache.invalidate("all *")
    return _frame(db, [(stats["misses"], stats["hits"], db.cache.stats()["entries"], n)], "misses int, hits int, entries int, n long")


@register("explain_plan", "SELECT true AS filtered, true AS ran, 'full_scan' AS advice")
def _(db):
    q = db.find("orders").select("o_orderkey").where("o_totalprice", 1000, ">")
    advice = [x.kind for x in db.find("orders").select("o_orderkey").explain_advice()]
    return _frame(db, [("PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in q.explain(), "Scan parquet" in q.explain_analyze(), advice[0])], "filtered boolean, ran boolean, advice string")


@register("explain_metrics", "SELECT count(*) AS passed, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 1000)) AS groups FROM orders WHERE o_totalprice > 1000")
def _(db):
    q = db.find("orders").select("o_custkey").where("o_totalprice", 1000, ">").distinct()
    rows = [(node, v) for node, metric, v in db.advice.measured(q.get()) if metric == "numOutputRows"]
    return _frame(db, [(max(v for node, v in rows if node == "Filter"), min(v for node, v in rows if node == "HashAggregate"))], "passed long, groups long")


@register("profiler_counts", "SELECT 'count' AS name, 3 AS runs")
def _(db):
    for _ in range(3):
        with db.profiler.measure("count"):
            db.find("region").count()
    return _frame(db, [(k, int(v["count"])) for k, v in db.profiler.stats().items()], "name string, runs int")


@register("session_option", "SELECT '7' AS value")
def _(db):
    before = db.spark.conf.get("spark.sql.plinth.example", None)
    db.config("spark.sql.plinth.example", 7)
    found = db.spark.conf.get("spark.sql.plinth.example")
    db.spark.conf.unset("spark.sql.plinth.example") if before is None else db.config("spark.sql.plinth.example", before)
    return _frame(db, [(found,)], "value string")


@register("as_object", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1")
def _(db):
    return _frame(db, [(r.n_nationkey, r.n_name) for r in db.find("nation").where("n_regionkey", 1).as_object().rows()], "k int, name string")


@register("transaction", "SELECT s_suppkey, CASE WHEN s_nationkey = 1 THEN 'kept' WHEN s_nationkey = 2 THEN 'point' ELSE s_name END AS s_name FROM supplier")
def _(db):
    with db.transaction():
        db.find("supplier").where("s_nationkey", 1).update({"s_name": "kept"})
        try:
            with db.transaction():
                db.find("supplier").update({"s_name": "lost"})
                raise KeyError
        except KeyError:
            pass
        db.find("supplier").where("s_nationkey", 2).update({"s_name": "point"})
        db.savepoint("a")
        db.find("supplier").update({"s_name": "lost"})
        db.rollback_to("a")
        db.release_savepoint("a")
    return db.find("supplier").select("s_suppkey", "s_name")


@register("migrations", "SELECT * FROM (VALUES ('a1', 1, true), ('a2', 1, true), ('b1', NULL, false)) t(name, batch, kept)")
def _(db):
    steps = db.migrations
    steps.add("a2", lambda d: d.add_column("held", "v", "integer"), lambda d: d.drop_column("held", "v"))
    steps.add("a1", lambda d: d.create_table("held", {"id": "integer"}), lambda d: d.drop_table("held"))
    steps.migrate()
    steps.add("b1", lambda d: d.add_column("held", "w", "integer"), lambda d: d.drop_column("held", "w"))
    steps.migrate()
    steps.down()
    done = dict(steps.history())
    return _frame(db, [(n, done.get(n), n in done) for n in ("a1", "a2", "b1")], "name string, batch int, kept boolean")


@register("events", "SELECT * FROM (VALUES ('begin', 1), ('change', 2), ('commit', 1), ('query', 3)) t(event, n)")
def _(db):
    seen = []
    for event in ("begin", "change", "commit", "query", "rollback"):
        db.events.listen(event, lambda event=event, **_: seen.append(event))
    with db.transaction():
        db.find("region").delete()
        db.find("nation").where("n_nationkey", 1).update({"n_name": "x"})
    for _ in range(3):
        db.find("nation").get()
    return _frame(db, [(e, seen.count(e)) for e in sorted(set(seen))], "event string, n int")


@register("retry", "SELECT 3 AS tries, (SELECT count(*) FROM nation) AS n")
def _(db):
    tries = []

    def action():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return db.find("nation").count()

    n = lifecycle.retry(action, attempts=5, wait=0.0, on=(ConnectionError,))
    return _frame(db, [(len(tries), n)], "tries int, n long")


@register("record_changes", "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'THREE' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 99, 'NEW'")
def _(db):
    db.put("held", db.frame("nation").select("n_nationkey", "n_name"))
    row = db.find_record("held", 3, "n_nationkey")
    row.n_name = "THREE"
    if row.dirty() != {"n_name": "THREE"} or row.save({"n_name": lambda x: x == ""}) or not row.save():
        raise ValueError("a rule that does not hold must keep a row from being written")
    db.find_record("held", 4, "n_nationkey").delete()
    db.record("held", {"n_nationkey": 99, "n_name": "NEW"}, "n_nationkey").save()
    row.refresh()
    return db.find("held")


@register("shard_route", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 37")
def _(db):
    orders = db.frame("orders").select("o_orderkey", "o_custkey")
    number = services.modulo_shard("o_custkey", 3)
    held = services.Sharded(db.spark, "o_custkey", {f"s{k}": orders.filter(number == k) for k in (1, 2, 3)}, "modulo")
    return held.frame(37)


@register("shard_all", "SELECT o_orderkey, CASE WHEN o_custkey <= 50 THEN 'low' ELSE 'high' END AS shard FROM orders")
def _(db):
    orders = db.frame("orders").select("o_orderkey", "o_custkey")
    rule = {"low": (0, 50), "high": (51, 1 << 60)}
    held = services.Sharded(db.spark, "o_custkey", {k: orders.filter(F.col("o_custkey").between(a, b)) for k, (a, b) in rule.items()}, rule)
    return held.frame().select("o_orderkey", held.column().alias("shard"))
