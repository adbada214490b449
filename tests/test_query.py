"""The query builder on rows with nulls, ties and empty lists."""

import pytest
from plinth import functions as fn
from plinth.database import Database
from plinth.operators.services import Finding
from pyspark.sql import functions as F


@pytest.fixture
def db(spark):
    t = spark.createDataFrame([(1, 10, "a"), (2, None, "b"), (3, 30, "b"), (4, 30, None)], "id int, v int, k string")
    u = spark.createDataFrame([(10, "x"), (30, "y"), (None, "z")], "v int, name string")
    return Database(spark, {"t": t, "u": u})


def ids(query):
    return sorted(r["id"] for r in query.get().collect())


def test_null_shapes(db):
    q = db.find("t").select("id")
    assert ids(q.where("v", None)) == ids(q.where_null("v")) == ids(q.where("v", None, "IS")) == [2]
    assert ids(q.where("v", None, "!=")) == ids(q.where_not_null("v")) == [1, 3, 4]
    assert ids(q.where("v", 10, "!=")) == [3, 4]


def test_lists(db):
    q = db.find("t").select("id")
    assert ids(q.where_in("v", [])) == [] and ids(q.where_not_in("v", [])) == [1, 2, 3, 4]
    assert ids(q.where_not_in("v", [10, None])) == []
    assert ids(q.where_in("v", [10, None])) == [1]
    with pytest.raises(ValueError):
        q.where("v", [1], "BETWEEN")


def test_and_binds_closer_than_or(db):
    q = db.find("t").select("id").where("id", 1).or_where("id", 2).where("v", 9)
    assert ids(q) == [1]
    grouped = db.find("t").select("id").where(lambda g: g.where("id", 1).or_where("id", 2)).where("v", 10)
    assert ids(grouped) == [1]


def test_subqueries_with_nulls(db):
    q = db.find("t").select("id")
    assert ids(q.where_in("v", db.find("u").select("v"))) == [1, 3, 4]
    assert ids(q.where_not_in("v", db.find("u").select("v"))) == []  # the null makes it unknown
    assert ids(q.where_not_exists(lambda: db.find("u").where("u.v", F.col("t.v").outer()))) == [2]
    assert ids(q.where("v", db.find("u").select(fn.max_("v").alias("m")))) == [3, 4]


def test_operators_are_checked(db):
    with pytest.raises(ValueError):
        db.find("t").where("v", 1, "= 1 OR 1 =")
    with pytest.raises(ValueError):
        db.find("t").where_column("v", "~~", "id")
    with pytest.raises(ValueError):
        db.find("t").order_by("v", "DOWN")
    with pytest.raises(ValueError):
        db.find("t").join("u", "true", "SIDEWAYS")


def test_queries_are_immutable(db):
    q = db.find("t")
    q.where("id", 1).limit(1).select("id")
    assert q.count() == 4 and q.get().columns == ["id", "v", "k"]


def test_results(db):
    q = db.find("t").order_by("id")
    assert q.get_one()["id"] == 1 and q.first()["id"] == 1 and q.last()["id"] == 4
    assert q.select("id").get_column() == [1, 2, 3, 4] and q.select("id").get_value() == 1
    assert q.get_value() is None and q.where("id", 99).get_one() is None
    assert set(q.index("k").rows()) == {"a", "b"} and q.index("k").rows()["b"]["id"] == 3
    assert q.index("k").get_column("id") == {"a": 1, "b": 3}
    assert q.exists() and q.where("id", 99).not_exists()
    assert [r["id"] for r in q.each()] == [1, 2, 3, 4] and [len(b) for b in q.batch(3)] == [3, 1]
    assert q.describe()[0] == ("id", "int", True)


def test_nulls_in_order(db):
    assert [r["id"] for r in db.find("t").order_by("v").order_by("id").get().collect()] == [1, 3, 4, 2]
    assert [r["id"] for r in db.find("t").order_by("v DESC, id ASC").get().collect()] == [2, 3, 4, 1]


def test_grouping(db):
    q = db.find("t").group_by("k").select("k", fn.count().alias("n"), fn.sum_("v").filter("id", 2, ">").alias("s"))
    assert {(r["k"], r["n"], r["s"]) for r in q.get().collect()} == {("a", 1, None), ("b", 2, 30), (None, 1, 30)}
    assert {r["k"] for r in q.having("n", 1, ">").get().collect()} == {"b"}
    assert {r["k"] for r in q.having(fn.max_("v"), 10).or_having("n", 2).get().collect()} == {"a", "b"}
    assert db.find("t").group_by("k").count() == 3
    assert db.find("t").select(fn.array_agg("v").alias("a"), fn.group_concat("k", "+").alias("g")).get().first() == ([10, 30, 30, None], "a+b+b")
    assert db.find("t").where("id", 99).select(fn.group_concat("k").alias("g")).get_value() is None


def test_ties_in_windows(db):
    rows = db.find("t").select("id", fn.rank().order_by("v").alias("r"), fn.dense_rank().order_by("v").alias("d"), fn.last_value("id").order_by("v").alias("l"), fn.lag("k", 1, "none").order_by("id").alias("before")).get().collect()
    found = {r["id"]: (r["r"], r["d"], r["before"]) for r in rows}
    assert found == {1: (1, 1, "none"), 3: (2, 2, "b"), 4: (2, 2, "b"), 2: (4, 3, "a")}
    assert {r["l"] for r in rows if r["id"] in (3, 4)} in ({3}, {4})  # both peers see the same last one


def test_pages(spark):
    rows = [(i, i % 3 if i % 7 else None) for i in range(20)]
    db = Database(spark, {"t": spark.createDataFrame(rows, "id int, v int")})
    q = db.find("t").order_by("v DESC, id ASC")
    whole = [r["id"] for r in q.get().collect()]
    page = q.paginate(6, 4)
    assert ([r["id"] for r in page.items], page.total, page.last_page, page.first_item, page.last_item, page.has_more) == (whole[18:], 20, 4, 19, 20, False)
    grouped = db.find("t").group_by("v").select("v", fn.count().alias("n")).order_by("v").paginate(2)
    assert grouped.total == 4 and len(grouped.items) == 2
    simple = q.simple_paginate(6, 3)
    assert simple.has_more and [r["id"] for r in simple.items] == whole[12:18]
    seen, cursor, pages = [], None, []
    while True:
        page = q.cursor_paginate(6, cursor)
        seen += [r["id"] for r in page.items]
        pages.append(page)
        cursor = page.next_cursor
        if cursor is None:
            break
    assert seen == whole and pages[0].previous_cursor is None
    assert [r["id"] for r in q.cursor_paginate(6, pages[2].previous_cursor).items] == whole[6:12]
    with pytest.raises(ValueError):
        q.cursor_paginate(6, "nonsense")


def test_set_operations_group_intersect_first(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "a int")
    db = Database(spark)
    assert sorted(r["a"] for r in db.find(one(1)).union(one(2, 3)).intersect(one(2)).get().collect()) == [1, 2]
    assert sorted(r["a"] for r in db.find(one(1, 2, 2)).except_(one(1)).union_all(one(5)).get().collect()) == [2, 5]


def test_scopes_macros_plugins_prefix(db):
    class Plugin:
        def register(self, db):
            db.macro("small", lambda q, n=15: q.where("v", n, "<"))

    db.register_plugin(Plugin())
    db.name_scope("k", lambda q, k: q.where("k", k))
    assert ids(db.find("t").select("id").small()) == [1] and ids(db.find("t").select("id").scope("k", "b")) == [2, 3]
    db.add_scope("known", lambda q: q.where_not_null("v"))
    assert ids(db.find("t")) == [1, 3, 4] and ids(db.find("t").without_global_scope("known")) == ids(db.find("t").without_global_scopes()) == [1, 2, 3, 4]
    with pytest.raises(AttributeError):
        db.find("t").nothing_like_it()
    other = Database(db.spark, {"app_t": db.tables["t"]}, prefix="app_")
    assert other.find("t").count() == 4


def test_common_tables(db):
    q = db.find("a").with_("a", db.find("t").where("id", 2, ">"), ["x", "y", "z"]).with_("b", "SELECT 1 AS one").cross_join("b")
    assert {(r["x"], r["one"]) for r in q.get().collect()} == {(3, 1), (4, 1)}
    tree = db.spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "n int, parent int")
    db.put("tree", tree)
    down = db.find("d").with_recursive("d", "SELECT n, 0 FROM tree WHERE parent IS NULL UNION ALL SELECT tree.n, depth + 1 FROM tree JOIN d ON tree.parent = d.n", ["n", "depth"])
    assert {(r["n"], r["depth"]) for r in down.get().collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_raw_sql_binds_parameters(db):
    evil = "b' OR '1'='1"
    assert db.raw_query("SELECT * FROM t WHERE k = :k", {"k": evil}).count() == 0
    assert db.raw_query_value("SELECT count(*) FROM t WHERE v > ?", [20]) == 2 and db.raw_query_one("SELECT * FROM t WHERE id = 99") is None
    assert db.find("t").where_raw("k = :k", {"k": evil}).count() == 0
    assert db.find("t").where_raw("k = :k AND v::bigint = :v", {"k": "b", "v": 30}).count() == 1
    assert db.table_exists("t") and not db.table_exists("no_such_table")


def test_cache_profiler_advice(db):
    q = db.find("t").where("id", 1).cache()
    assert q.get() is not None and db.find("t").where("id", 1).cache().get().count() == 1
    assert db.cache.stats() == {"entries": 1, "hits": 1, "misses": 1} and db.cache.invalidate() == 1
    with db.profiler.measure("q"):
        q.no_cache().count()
    assert db.profiler.stats()["q"]["count"] == 1
    cross = db.find("t a").join("t b", "a.id < b.id")
    assert any(isinstance(f, Finding) and "join" in f.kind or f.kind == "cartesian_product" for f in cross.explain_advice())
    assert "Physical Plan" in q.explain() and "Analyzed" in q.to_sql()


def test_changes_through_the_query(db):
    t = db.find("t")
    t.where("v", 30).update({"k": "thirty"})
    assert {r["id"] for r in db.find("t").where("k", "thirty").get().collect()} == {3, 4}
    t.where("v", 10).delete()
    assert ids(db.find("t")) == [2, 3, 4]  # the row with a null stays
    t.insert({"id": 9, "v": 1})
    t.on_duplicate({"v": fn.inc(5)}).insert([{"id": 9, "v": 0}, {"id": 10, "v": 0}])
    assert {(r["id"], r["v"]) for r in db.find("t").where("id", 4, ">").get().collect()} == {(9, 6), (10, 0)}
    t.replace({"id": 10, "k": "new"})
    t.insert_from(db.find("u").select("v + 100", "v", "name").where_not_null("v"))
    t.order_by("id").limit(1).where("id", 100, ">").update({"k": "first"})
    assert {(r["id"], r["k"]) for r in db.find("t").where("id", 9, ">").get().collect()} == {(10, "new"), (110, "first"), (130, "y")}
    t.merge(db.spark.createDataFrame([(2, 7)], "id int, v int"), "id", ["v"], (), True)
    assert [tuple(r) for r in db.find("t").get().collect()] == [(2, 7, "b")]
    t.truncate()
    assert db.find("t").count() == 0
    with pytest.raises(ValueError):
        db.find("t").join("u", "t.v = u.v").delete()


def test_tables_by_name(db):
    db.create_table("made", {"id": "primary_key", "v": "integer"})
    db.create_table("made", {"id": "primary_key"}, if_not_exists=True)
    with pytest.raises(ValueError):
        db.create_table("made", {})
    db.add_column("made", "w", "string")
    db.rename_column("made", "v", "x")
    db.alter_column("made", "x", "big_integer")
    db.rename_table("made", "kept")
    assert db.find("kept").describe() == [("id", "int", False), ("x", "bigint", True), ("w", "string", True)]
    db.drop_column("kept", "w")
    db.truncate_table("kept")
    db.drop_table("kept")
    db.drop_table("kept", if_exists=True)
    with pytest.raises(ValueError):
        db.drop_table("kept")
    db.constraints.add_foreign_key("fk", "t", ["v"], "u", ["v"])
    db.constraints.add_check("ck", "t", "id < 4")
    assert {k: v.count() for k, v in db.violations("t").items()} == {"fk": 0, "ck": 1}


def test_page_links(db):
    page = db.find("t").order_by("id").paginate(3, 2)
    assert page.links("/t", q="x")["prev"] == "/t?q=x&page=1" and page.links()["next"] is None
    assert page.to_dict()["meta"]["from"] == 4 and page.to_dict()["data"] == [{"id": 4, "v": 30, "k": None}]


def test_sql_layout():
    from plinth.functions.sqltext import format_sql

    text = "select a, count(*) from t left join u on t.x = u.x where a in (select b from c where d = 'x AND  y') and e = 1 group by a"
    expected = """SELECT a, count(*)
FROM t
LEFT JOIN u on t.x = u.x
WHERE a in (
  SELECT b
  FROM c
  WHERE d = 'x AND  y'
)
  AND e = 1
GROUP BY a"""
    assert format_sql(text) == expected
