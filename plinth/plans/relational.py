"""Filters, joins, aggregates, windows, set operations, subqueries and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import paginate
from .catalogue import register

# ---- aggregates and having


@register("agg_filter", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS discounted, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 HAVING count(*) > 10""")
def _(db):
    return (
        db.find("lineitem").where("l_shipdate", F.expr("timestamp_ntz'1998-09-02'"), "<=").group_by("l_returnflag", "l_linestatus")
        .select("l_returnflag", "l_linestatus", F.round(fn.sum_("l_quantity").column, 2).alias("sum_qty"), F.round(fn.sum_("l_extendedprice").filter("l_discount", 0.05, ">").column, 2).alias("discounted"), F.round(fn.avg("l_discount").column, 6).alias("avg_disc"), fn.count().alias("n"))
        .having("n", 10, ">").order_by("l_returnflag, l_linestatus")
    )


@register("agg_basic", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def _(db):
    return db.find("orders").group_by("o_orderpriority").select("o_orderpriority", fn.count().alias("n"), F.round(fn.sum_("o_totalprice").column, 2).alias("total"), F.round(fn.avg("o_totalprice").column, 2).alias("mean"), fn.min_("o_totalprice").alias("low"), fn.max_("o_totalprice").alias("high"))


@register("agg_global", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def _(db):
    return db.find("orders").select(fn.count().alias("n"), fn.count_distinct("o_custkey").alias("customers"))


@register("having_aggregate", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 300000 AND count(*) >= 3")
def _(db):
    return db.find("orders").group_by("o_custkey").select("o_custkey", fn.count().alias("n")).having(fn.sum_("o_totalprice"), 300000, ">").having("n", 3, ">=")


@register("having_or", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 20 OR max(o_totalprice) > 400000")
def _(db):
    return db.find("orders").group_by("o_custkey").select("o_custkey", fn.count().alias("n")).having("n", 20, ">").or_having(fn.max_("o_totalprice"), 400000, ">")


@register("group_by_replaced", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(db):
    return db.find("customer").group_by("c_nationkey").group_by("c_mktsegment").select("c_mktsegment", fn.count().alias("n"))


@register("group_by_expression", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1")
def _(db):
    return db.find("orders").group_by({"y": "year(o_orderdate)"}).select("y", fn.count().alias("n"))


@register("group_concat", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, string_agg(DISTINCT n_regionkey::VARCHAR, '|' ORDER BY n_regionkey::VARCHAR) AS keys FROM nation GROUP BY 1")
def _(db):
    return db.find("nation").group_by("n_regionkey").select("n_regionkey", fn.group_concat("n_name", ", ").alias("names"), fn.group_concat("n_regionkey", "|", True).alias("keys"))


@register("array_agg", "SELECT n_regionkey, to_json(list(n_name ORDER BY n_name))::VARCHAR AS names FROM nation GROUP BY 1")
def _(db):
    return db.find("nation").group_by("n_regionkey").select("n_regionkey", F.to_json(fn.array_agg("n_name")).alias("names"))


@register("json_array_agg", "SELECT s_nationkey, to_json(list(s_suppkey ORDER BY s_suppkey))::VARCHAR AS keys FROM supplier GROUP BY 1")
def _(db):
    return db.find("supplier").group_by("s_nationkey").select("s_nationkey", fn.json_array_agg("s_suppkey").alias("keys"))


@register("distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def _(db):
    return db.find("part").select("p_brand, p_size").distinct()


@register("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _(db):
    return db.find("orders").select("o_custkey", "o_orderkey", "o_totalprice").distinct_on("o_custkey").order_by("o_custkey ASC, o_totalprice DESC, o_orderkey ASC")


@register("ext_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)")
def _(db):
    return db.find("nation").rollup("n_regionkey", "n_name").select("n_regionkey", "n_name", fn.count().alias("n"))


@register("ext_cube", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
def _(db):
    return db.find("part").cube("p_brand", "p_size").select("p_brand", "p_size", fn.count().alias("n"))


@register("ext_stddev", "SELECT l_returnflag, round(stddev(l_quantity), 4) AS sd, round(variance(l_quantity), 4) AS v FROM lineitem GROUP BY 1")
def _(db):
    return db.find("lineitem").group_by("l_returnflag").select("l_returnflag", F.round(fn.stddev("l_quantity").column, 4).alias("sd"), F.round(fn.variance("l_quantity").column, 4).alias("v"))


# ---- filters


@register("where_grammar", "SELECT p_partkey FROM part WHERE p_size = 5 OR p_size = 10 AND p_brand = 'Brand#1' OR (p_retailprice > 1500 AND p_size BETWEEN 1 AND 20)")
def _(db):
    return db.find("part").select("p_partkey").where("p_size", 5).or_where("p_size", 10).where("p_brand", "Brand#1").or_where(lambda q: q.where("p_retailprice", 1500, ">").where_between("p_size", 1, 20))


@register("where_dict_raw", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 AND o_custkey % 2 = 0")
def _(db):
    return db.find("orders").select("o_orderkey").where({"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]}).where_raw("o_totalprice > :low", {"low": 100000}).where("o_custkey % 2 = 0")


@register("in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (1, 2)")
def _(db):
    return db.find("nation").select("n_name").where_in("n_regionkey", [1, 3]).where_not_in("n_nationkey", [1, 2])


@register("in_empty", "SELECT n_name FROM nation WHERE 0 = 1")
def _(db):
    return db.find("nation").select("n_name").where_in("n_regionkey", [])


@register("not_in_empty", "SELECT n_name FROM nation WHERE 1 = 1")
def _(db):
    return db.find("nation").select("n_name").where_not_in("n_regionkey", [])


@register("not_in_null", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, NULL)")
def _(db):
    return db.find("nation").select("n_name").where_not_in("n_regionkey", [1, None])


@register("null_tests", "SELECT c.c_custkey, o.o_orderkey IS NULL AS no_order FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL OR o.o_totalprice IS NOT NULL AND c.c_acctbal < 0")
def _(db):
    return db.find("customer c").left_join("orders o", "c.c_custkey = o.o_custkey").select("c.c_custkey", F.col("o.o_orderkey").isNull().alias("no_order")).where_null("o.o_orderkey").or_where_not_null("o.o_totalprice").where("c.c_acctbal", 0, "<")


@register("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1200")
def _(db):
    return db.find("part").select("p_partkey").where_between("p_size", 10, 20).where_not_between("p_retailprice", 1000, 1200)


@register("where_column", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount AND l_partkey <> l_suppkey")
def _(db):
    return db.find("lineitem").select("l_orderkey, l_linenumber").where_column("l_tax", ">", "l_discount").and_where_column("l_partkey", "!=", "l_suppkey")


@register("like_ilike", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_brand ILIKE 'brand#_%' AND NOT p_type LIKE '%ZZZ%'")
def _(db):
    return db.find("part").select("p_partkey").where("p_name", "%a%", "LIKE").where(fn.ilike("p_brand", "brand#_%")).where(fn.not_(fn.like("p_type", "%ZZZ%")))


@register("or_variants", "SELECT n_name FROM nation WHERE n_regionkey = 0 OR n_nationkey IN (7, 8) OR n_nationkey BETWEEN 20 AND 21 OR n_nationkey NOT BETWEEN 1 AND 23 OR n_name IS NULL")
def _(db):
    return db.find("nation").select("n_name").where("n_regionkey", 0).or_where_in("n_nationkey", [7, 8]).or_where_between("n_nationkey", 20, 21).or_where_not_between("n_nationkey", 1, 23).or_where_null("n_name")


# ---- joins


@register("join_inner", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def _(db):
    return db.find("nation n").inner_join("region r", "n.n_regionkey = r.r_regionkey").select("n.n_name", "r.r_name")


@register("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1")
def _(db):
    return db.find("customer c").left_join("orders o", "c.c_custkey = o.o_custkey").group_by("c.c_custkey").select("c.c_custkey", fn.count("o.o_orderkey").alias("n"))


@register("join_right", "SELECT n.n_name, s.s_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def _(db):
    return db.find("supplier s").right_join("nation n", "s.s_nationkey = n.n_nationkey").select("n.n_name", "s.s_name")


@register("join_full", "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM supplier WHERE s_nationkey < 12) s FULL JOIN (SELECT * FROM customer WHERE c_nationkey > 8) c ON s.s_suppkey = c.c_custkey")
def _(db):
    left = db.find("supplier").where("s_nationkey", 12, "<").get().alias("s")
    right = db.find("customer").where("c_nationkey", 8, ">").get().alias("c")
    return db.find(left).full_join(right, "s.s_suppkey = c.c_custkey").select("s.s_suppkey", "c.c_custkey")


@register("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def _(db):
    return db.find("region a").cross_join("region b").select({"a": "a.r_name", "b": "b.r_name"})


@register("join_theta", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(db):
    return db.find("nation a").join("nation b", "a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey").select({"low": "a.n_nationkey", "high": "b.n_nationkey"})


@register("join_self", "SELECT a.s_suppkey, b.s_suppkey AS peer FROM supplier a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def _(db):
    return db.find("supplier a").join("supplier AS b", "a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey").select("a.s_suppkey", {"peer": "b.s_suppkey"})


@register("join_multi", """
SELECT r.r_name, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1""")
def _(db):
    return (
        db.find("lineitem l").join("orders o", "l.l_orderkey = o.o_orderkey").join("customer c", "o.o_custkey = c.c_custkey").join("nation n", "c.c_nationkey = n.n_nationkey").join("region r", "n.n_regionkey = r.r_regionkey")
        .group_by("r.r_name").select("r.r_name", fn.count().alias("n"), F.round(fn.sum_("l.l_extendedprice * (1 - l.l_discount)").column, 2).alias("revenue"))
    )


@register("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def _(db):
    return db.find("customer c").select("c_custkey").where_exists(lambda: db.find("orders o").where("o.o_custkey", F.col("c.c_custkey").outer()).where("o.o_totalprice", 200000, ">"))


@register("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def _(db):
    return db.find("customer c").select("c_custkey").where_not_exists(lambda: db.find("orders o").where("o.o_custkey", F.col("c.c_custkey").outer()))


@register("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(db):
    return db.find("supplier").select("s_suppkey").where_in("s_nationkey", db.find("nation").select("n_nationkey").where("n_regionkey", 1))


@register("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(db):
    return db.find("customer").select("c_custkey").where_not_in("c_custkey", db.find("orders").select("o_custkey"))


@register("semi_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 3)")
def _(db):
    return db.find("customer c").semi_join("orders o", "c.c_custkey = o.o_custkey").anti_join(db.find("supplier").where("s_suppkey", 3, "<").get().alias("s"), "c.c_nationkey = s.s_nationkey").select("c_custkey")


@register("lateral_top1", """
SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c
LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t ON true""")
def _(db):
    best = db.find("orders o").where("o.o_custkey", F.col("c.c_custkey").outer()).order_by("o_totalprice DESC, o_orderkey ASC").limit(1)
    return db.find("customer c").lateral_join(best.select("o_orderkey", "o_totalprice"), alias="t").select("c.c_custkey", "t.o_orderkey", "t.o_totalprice")


@register("lateral_table_function", "SELECT n_nationkey, unnest(range(1, n_regionkey + 2))::INTEGER AS step FROM nation")
def _(db):
    steps = db.spark.tvf.explode(F.sequence(F.lit(1), F.col("n.n_regionkey").outer() + 1)).toDF("step")
    return db.find("nation n").lateral_join(steps, kind="INNER", alias="x").select("n.n_nationkey", "x.step")


# ---- windows


@register("window_ranking", """
SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS INTEGER) AS rn, CAST(rank() OVER (ORDER BY n_regionkey) AS INTEGER) AS rk, CAST(dense_rank() OVER (ORDER BY n_regionkey) AS INTEGER) AS dr, CAST(ntile(3) OVER (ORDER BY n_nationkey) AS INTEGER) AS tile FROM nation""")
def _(db):
    return db.find("nation").select("n_nationkey", fn.row_number().order_by("n_regionkey").order_by("n_nationkey").alias("rn"), fn.rank().order_by("n_regionkey").alias("rk"), fn.dense_rank().order_by("n_regionkey").alias("dr"), fn.ntile(3).order_by("n_nationkey").alias("tile"))


@register("window_lag_lead", "SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER w AS before, lead(o_totalprice, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(db):
    over = lambda f: f.partition_by("o_custkey").order_by("o_orderdate").order_by("o_orderkey")
    return db.find("orders").select("o_orderkey", over(fn.lag("o_totalprice", 1, 0.0)).alias("before"), over(fn.lead("o_totalprice", 2)).alias("after"))


@register("window_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(db):
    over = lambda f: f.partition_by("o_custkey").order_by("o_orderdate").order_by("o_orderkey")
    return db.find("orders").select("o_orderkey", over(fn.first_value("o_orderkey")).alias("f"), over(fn.last_value("o_orderkey")).alias("l"), over(fn.nth_value("o_orderkey", 2)).alias("second"))


@register("window_frame_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM events")
def _(db):
    over = lambda f: f.partition_by("user_id").order_by("ts").order_by("event_id")
    return db.find("events").select("event_id", F.round(over(fn.window_aggregate("sum", "value")).rows(-2, 0).column, 4).alias("moving"), over(fn.window_aggregate("count", "*")).rows(None, None).alias("n"))


@register("window_frame_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part")
def _(db):
    return db.find("part").select("p_partkey", fn.window_aggregate("count", "*").partition_by("p_brand").order_by(F.col("p_size")).range(-3, 3).alias("near"))


@register("window_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running, max(o_totalprice) OVER (PARTITION BY o_custkey) AS high FROM orders")
def _(db):
    return db.find("orders").select("o_orderkey", F.round(fn.window_aggregate("sum", "o_totalprice").partition_by("o_custkey").order_by("o_orderdate").order_by("o_orderkey").column, 2).alias("running"), fn.window_aggregate("max", "o_totalprice").partition_by("o_custkey").alias("high"))


@register("topk_per_group", "SELECT o_custkey, o_orderkey, rn::INTEGER AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def _(db):
    ranked = db.find("orders").select("o_custkey", "o_orderkey", fn.row_number().partition_by("o_custkey").order_by("o_totalprice", "DESC").order_by("o_orderkey").alias("rn"))
    return db.find(ranked).where("rn", 2, "<=")


# ---- order, limits, pages


@register("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(db):
    return db.find("orders").select("o_orderkey, o_totalprice").order_by("o_totalprice DESC, o_orderkey ASC").limit(10)


@register("offset_limit", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7 OFFSET 14")
def _(db):
    return db.find("customer").select("c_custkey").order_by({"c_acctbal": "ASC", "c_custkey": "ASC"}).offset(14).limit(7)


@register("keyset_page", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority < '3-MEDIUM' OR (o_orderpriority = '3-MEDIUM' AND o_orderkey > 100) ORDER BY o_orderpriority DESC, o_orderkey LIMIT 20")
def _(db):
    return paginate.keyset(db.find("orders").select("o_orderkey, o_orderpriority").get(), [("o_orderpriority", "DESC"), ("o_orderkey", "ASC")], {"o_orderpriority": "3-MEDIUM", "o_orderkey": 100}).limit(20)


@register("order_by_json", "SELECT event_id FROM events ORDER BY TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) DESC, event_id LIMIT 15")
def _(db):
    return db.find("events").select("event_id").order_by_json("props", "k", "DESC").order_by("event_id").limit(15)


# ---- set operations


@register("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(db):
    return db.find("customer").select({"k": "c_nationkey"}).union(db.find("supplier").select("s_nationkey"))


@register("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(db):
    return db.find("customer").select({"k": "c_nationkey"}).union_all(db.find("supplier").select("s_nationkey"))


@register("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(db):
    return db.find("customer").select({"k": "c_nationkey"}).intersect(db.find("supplier").select("s_nationkey"))


@register("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def _(db):
    return db.find("nation").select({"k": "n_nationkey"}).except_(db.find("supplier").select("s_nationkey"))


@register("set_mixed", "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey < 5")
def _(db):
    tail = db.find("nation").select("n_nationkey").intersect(db.find("supplier").select("s_nationkey").where("s_suppkey", 5, "<"))
    return db.find("region").select({"k": "r_regionkey"}).union(tail)


# ---- common tables and subqueries


@register("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), top AS (SELECT o_custkey FROM big WHERE total > 500000) SELECT c.c_custkey, c.c_name FROM customer c JOIN top t ON c.c_custkey = t.o_custkey")
def _(db):
    big = db.find("orders").group_by("o_custkey").select("o_custkey", fn.sum_("o_totalprice").alias("total"))
    return db.find("customer c").with_("big", big).with_("top", db.find("big").where("total", 500000, ">").select("o_custkey")).join("top t", "c.c_custkey = t.o_custkey").select("c.c_custkey", "c.c_name")


@register("cte_materialized", "WITH m AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) SELECT a.k, b.n FROM m a JOIN m b ON a.k = b.k")
def _(db):
    return db.find("m a").with_materialized("m", db.find("nation").group_by("n_regionkey").select("n_regionkey", fn.count().alias("n")), ["k", "n"]).join("m b", "a.k = b.k").select("a.k", "b.n")


@register("cte_recursive", "WITH RECURSIVE t(k, depth) AS (SELECT 1, 0 UNION ALL SELECT k * 2, depth + 1 FROM t WHERE depth < 8) SELECT n.n_name, t.depth FROM t JOIN nation n ON n.n_nationkey = t.k")
def _(db):
    return db.find("t").with_recursive("t", "SELECT 1, 0 UNION ALL SELECT k * 2, depth + 1 FROM t WHERE depth < 8", ["k", "depth"]).join("nation n", "n.n_nationkey = t.k").select("n.n_name", "t.depth")


@register("scalar_subquery_select", "SELECT n.n_name, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers FROM nation n")
def _(db):
    return db.find("nation n").select("n.n_name", {"suppliers": db.find("supplier s").where("s.s_nationkey", F.col("n.n_nationkey").outer()).select(fn.count().alias("c"))})


@register("scalar_subquery_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def _(db):
    return db.find("orders").select("o_orderkey").where("o_totalprice", db.find("orders").select((fn.avg("o_totalprice").column * 1.5).alias("a")), ">")


@register("raw_query", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def _(db):
    return db.raw_query("SELECT n_name FROM nation WHERE n_regionkey = :r AND n_nationkey > :k", {"r": 2, "k": 5})


@register("macro_scope", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000 AND o_custkey < 100")
def _(db):
    db.macro("finished", lambda q: q.where("o_orderstatus", "F"))
    db.add_scope("dear", lambda q: q.where("o_totalprice", 150000, ">"))
    db.add_scope("off", lambda q: q.where("o_totalprice", 0, "<"))
    return db.find("orders").select("o_orderkey").finished().scope(lambda q: q.where("o_custkey", 100, "<")).without_global_scope("off")
