"""String, numeric, date, conditional, type, JSON and full-text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .catalogue import register


@register("str_case_trim", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim('  ' || p_name || ' ') AS t, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt, CAST(length(p_name) AS INTEGER) AS n FROM part")
def _(db):
    return db.find("part").select("p_partkey", {"u": fn.upper("p_name"), "l": fn.lower("p_brand"), "t": fn.trim("concat('  ', p_name, ' ')"), "lt": fn.ltrim("concat('  ', p_name)"), "rt": fn.rtrim("concat(p_name, '  ')"), "n": fn.length("p_name")})


@register("str_concat_replace", "SELECT p_partkey, p_brand || '/' || p_size AS c, replace(p_name, 'a', 'A''') AS r FROM part")
def _(db):
    return db.find("part").select("p_partkey", {"c": fn.concat("p_brand", fn.escape("/"), "p_size"), "r": fn.replace("p_name", "a", "A'")})


@register("str_parts", "SELECT p_partkey, substring(p_name, 2, 4) AS s, substring(p_name, 3) AS s2, left(p_name, 3) AS l, right(p_name, 3) AS r, CAST(position('e' IN p_name) AS INTEGER) AS p FROM part")
def _(db):
    return db.find("part").select("p_partkey", {"s": fn.substring("p_name", 2, 4), "s2": fn.substring("p_name", 3), "l": fn.left("p_name", 3), "r": fn.right("p_name", 3), "p": fn.position("e", "p_name")})


@register("str_repeat_reverse_pad", "SELECT n_nationkey, repeat('ab', 3) AS rep, repeat('x', 0) AS none, reverse(n_name) AS rev, lpad(n_name, 12, '*') AS lp, rpad(n_name, 5, '-') AS rp FROM nation")
def _(db):
    return db.find("nation").select("n_nationkey", {"rep": fn.repeat("ab", 3), "none": fn.repeat("x", -1), "rev": fn.reverse("n_name"), "lp": fn.lpad("n_name", 12, "*"), "rp": fn.pad_right("n_name", 5, "-")})


@register("str_regexp", "SELECT page_id, regexp_matches(url, '^https?://') AS m, regexp_replace(url, '[0-9]+', '#', 'g') AS r, CASE WHEN regexp_matches(url, '//([^/]+)/') THEN regexp_extract(url, '//([^/]+)/', 1) END AS host, CASE WHEN regexp_matches(url, 'zzz+') THEN regexp_extract(url, 'zzz+') END AS none FROM pages")
def _(db):
    return db.find("pages").select("page_id", {"m": fn.regexp_match("url", "^https?://"), "r": fn.regexp_replace("url", "[0-9]+", "#"), "host": fn.regexp_extract("url", "//([^/]+)/", 1), "none": fn.regexp_extract("url", "zzz+")})


@register("num_rounding", "SELECT p_partkey, round(p_retailprice, 1) AS r, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, abs(p_size - 20) AS a FROM part")
def _(db):
    return db.find("part").select("p_partkey", {"r": fn.round_("p_retailprice", 1), "c": fn.ceil("p_retailprice"), "f": fn.floor("p_retailprice"), "a": fn.abs_("p_size - 20")})


@register("num_powers", "SELECT p_partkey, power(p_size, 2) AS p, round(sqrt(p_size), 6) AS s, round(exp(p_size / 50.0::DOUBLE), 6) AS e, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10, round(ln(p_size) / ln(2), 6) AS l2 FROM part")
def _(db):
    return db.find("part").select("p_partkey", {"p": fn.power("p_size", 2), "s": fn.round_(fn.sqrt("p_size"), 6), "e": fn.round_(fn.exp("p_size / 50.0D"), 6), "l": fn.round_(fn.ln("p_size"), 6), "l10": fn.round_(fn.log("p_size"), 6), "l2": fn.round_(fn.log("p_size", 2), 6)})


@register("num_mod_add", "SELECT c_custkey, CAST((c_nationkey - 12) % 5 AS INTEGER) AS m, c_nationkey + c_custkey AS a FROM customer")
def _(db):
    return db.find("customer").select("c_custkey", {"m": fn.mod("c_nationkey - 12", 5), "a": fn.add("c_nationkey", "c_custkey")})


@register("num_trunc", "SELECT c_custkey, trunc(CAST(c_acctbal * 10 AS DECIMAL(18,4)))::DOUBLE / 10 AS t1, trunc(c_acctbal) AS t0 FROM customer")
def _(db):
    return db.find("customer").select("c_custkey", {"t1": fn.trunc("c_acctbal", 1), "t0": fn.trunc("c_acctbal")})


@register("date_parts", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS dd FROM orders")
def _(db):
    return db.find("orders").select("o_orderkey", {"d": fn.date("o_orderdate"), "y": fn.year("o_orderdate"), "m": fn.month("o_orderdate"), "dd": fn.day("o_orderdate")})


@register("time_parts", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, strftime(ts, '%H:%M:%S') AS t FROM events")
def _(db):
    return db.find("events").select("event_id", {"h": fn.hour("ts"), "mi": fn.minute("ts"), "s": fn.second("ts"), "t": fn.time("ts")})


@register("date_intervals", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 3 DAY AS d, o_orderdate + INTERVAL 2 HOUR + INTERVAL 30 SECOND AS h, o_orderdate - INTERVAL 1 YEAR AS y FROM orders")
def _(db):
    return db.find("orders").select("o_orderkey", {"m": fn.add_interval("o_orderdate", "1", "MONTH"), "d": fn.sub_interval("o_orderdate", "3", "DAY"), "h": fn.add_interval(fn.add_interval("o_orderdate", 2, "HOUR"), 30, "SECOND"), "y": fn.sub_interval("o_orderdate", "1", "YEAR")})


@register("date_parse", "SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS d FROM orders")
def _(db):
    return db.find("orders").select("o_orderkey", {"d": fn.to_date(F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy"), "DD/MM/YYYY")})


@register("date_now", "SELECT n_nationkey, true AS today, true AS later, true AS epoch FROM nation")
def _(db):
    return db.find("nation").select("n_nationkey", {"today": fn.cur_date() == F.to_date(fn.now()), "later": fn.now("+1 DAY") > fn.now(), "epoch": fn.ts("-1 HOUR") < fn.ts()})


@register("null_functions", "SELECT p_partkey, nullif(p_size, 5) AS n, coalesce(nullif(p_size, 5), -1) AS c, coalesce(nullif(p_size, 7), 0) AS i, nullif(p_size, 5) IS NULL AS isn, nullif(p_size, 5) IS NOT NULL AS notn FROM part")
def _(db):
    return db.find("part").select("p_partkey", {"n": fn.null_if("p_size", 5), "c": fn.coalesce(fn.null_if("p_size", 5), -1), "i": fn.if_null("nullif(p_size, 7)", 0), "isn": fn.is_null(fn.null_if("p_size", 5)), "notn": fn.is_not_null(fn.null_if("p_size", 5))})


@register("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS k, CASE WHEN p_size = 1 THEN 1 END AS one FROM part")
def _(db):
    return db.find("part").select("p_partkey", {"k": fn.case({"p_size < 10": "small", "p_size < 30": "medium"}, "large"), "one": fn.case({"p_size = 1": 1})})


@register("cast_types", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_totalprice AS BIGINT) AS n, TRY_CAST(o_orderpriority AS INTEGER) AS bad, CAST('1' AS INTEGER) AS one FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice, o_orderpriority FROM orders)")
def _(db):
    return db.find("orders").select("o_orderkey", {"s": fn.cast("o_orderkey", "string"), "n": fn.cast("o_totalprice", "bigint"), "bad": fn.try_cast("o_orderpriority", "int"), "one": fn.cast(fn.escape("1"), "int")})


@register("greatest_least", "SELECT p_partkey, greatest(p_size, 20, NULL) AS g, least(p_size, 20, NULL) AS l FROM part")
def _(db):
    return db.find("part").select("p_partkey", {"g": fn.greatest("p_size", 20, fn.null()), "l": fn.least("p_size", 20, fn.null())})


@register("comparison_functions", "SELECT p_partkey, p_size BETWEEN 3 AND 9 AS b, p_size NOT BETWEEN 3 AND 9 AS nb, p_size IN (1, 2) AS i, p_size NOT IN (1, 2) AS ni, false AS e, true AS f FROM part")
def _(db):
    return db.find("part").select("p_partkey", {"b": fn.between("p_size", 3, 9), "nb": fn.not_between("p_size", 3, 9), "i": fn.in_("p_size", [1, 2]), "ni": fn.not_in("p_size", [1, 2]), "e": fn.in_("p_size", []), "f": fn.true()})


# ---- JSON


@register("json_get", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def _(db):
    return db.find("events").select("event_id", {"k": fn.json_get("props", "k"), "none": fn.json_extract("props", ["none"])})


@register("json_select_where", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 OR event_id < 10")
def _(db):
    return db.find("events").select("event_id").select_json("props", "k").where_json_path("props", "k", ">", 50).or_where("event_id", 10, "<")


@register("json_exists", "SELECT event_id FROM events WHERE json_exists(props, '$.k') AND NOT json_exists(props, '$.zz') AND event_id < 500")
def _(db):
    return db.find("events").select("event_id").where_json_exists("props", "k").where(~fn.json_exists("props", "zz")).where("event_id", 500, "<")


_DOC = "'{\"a\":{\"b\":' || n_nationkey || '},\"tags\":[\"x\",\"t' || n_regionkey || '\"],\"z\":null}'"
_SPARK_DOC = "concat('{\"a\":{\"b\":', n_nationkey, '},\"tags\":[\"x\",\"t', n_regionkey, '\"],\"z\":null}')"


@register("json_nested", f"SELECT n_nationkey, CAST(json_extract_string(d, '$.a.b') AS INTEGER) AS b, json_extract_string(d, '$.tags[1]') AS t, CAST(json_array_length(d, '$.tags') AS INTEGER) AS n, 0 AS none, true AS z, false AS y FROM (SELECT n_nationkey, {_DOC} AS d FROM nation)")
def _(db):
    nested = db.find("nation").select("n_nationkey", {"d": _SPARK_DOC})
    return db.find(nested).select("n_nationkey", {"b": fn.cast(fn.json_get("d", "a.b"), "int"), "t": fn.json_get("d", ["tags", 1]), "n": fn.json_length("d", "tags"), "none": fn.json_length("d", "a"), "z": fn.json_exists("d", "z"), "y": fn.json_exists("d", "y")})


@register("json_contains", f"SELECT n_nationkey FROM (SELECT n_nationkey, {_DOC} AS d FROM nation) WHERE json_contains(d -> '$.tags', '\"t1\"') OR n_nationkey = 3")
def _(db):
    nested = db.find("nation").select("n_nationkey", {"d": _SPARK_DOC})
    return db.find(nested).select("n_nationkey").where_json_contains("d", ["x", "t1"], "tags").or_where("n_nationkey", 3)


@register("json_keys_type", f"SELECT n_nationkey, array_to_string(json_keys(d), ',') AS keys, 'object' AS ta, 'array' AS tt, 'null' AS tz, 'number' AS tb, 'string' AS ts FROM (SELECT n_nationkey, {_DOC} AS d FROM nation)")
def _(db):
    nested = db.find("nation").select("n_nationkey", {"d": _SPARK_DOC})
    return db.find(nested).select("n_nationkey", {"keys": F.array_join(fn.json_keys("d"), ","), "ta": fn.json_type("d", "a"), "tt": fn.json_type("d", "tags"), "tz": fn.json_type("d", "z"), "tb": fn.json_type("d", "a.b"), "ts": fn.json_type("d", "tags.0")})


@register("json_change", f"""
SELECT n_nationkey, '{{"a":{{"b":' || n_nationkey || ',"c":1}},"tags":["x","t' || n_regionkey || '"],"z":null}}' AS s,
  '{{"a":{{"b":' || n_nationkey || '}},"tags":[null,"t' || n_regionkey || '"],"z":null}}' AS r, '{{"a":{{"b":9}},"tags":["x","t' || n_regionkey || '"],"z":null}}' AS p, '[1, "a"]' AS arr, '{{"k": 1}}' AS obj FROM nation""")
def _(db):
    nested = db.find("nation").select("n_nationkey", {"d": _SPARK_DOC})
    return db.find(nested).select("n_nationkey", {"s": fn.json_set("d", "a.c", 1), "r": fn.json_remove("d", "tags.0"), "p": fn.json_replace(fn.json_replace("d", "a.b", 9), "a.none", 1), "arr": fn.json_array(1, "a"), "obj": fn.json_object({"k": 1})})


@register("fulltext_match", r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'and') AND NOT list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'idiot') OR list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'licensed')")
def _(db):
    return db.find("documents").select("doc_id").where(fn.match("text", "the & and !idiot | licensed"))
