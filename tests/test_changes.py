"""Table changes, relations, constraints, shards, files and streams."""

import pytest
from plinth import functions as fn
from plinth.operators import ddl, dml, relations, services
from plinth.sources import files
from plinth.streaming import windows
from pyspark.sql import functions as F


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 30)], "id int, name string, v int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_insert_and_replace(table):
    assert rows(dml.insert(table, {"id": 4})) == [(1, "a", 10), (2, "b", None), (3, "c", 30), (4, None, None)]
    assert rows(dml.replace(table, [{"id": 1, "name": "z"}, {"id": 9, "v": 9}])) == [(1, "z", None), (2, "b", None), (3, "c", 30), (9, None, 9)]


def test_upsert(table):
    new = [{"id": 1, "name": "n", "v": 1}, {"id": 7, "name": "s", "v": 7}]
    assert rows(dml.upsert(table, new, ["name"])) == [(1, "n", 10), (2, "b", None), (3, "c", 30), (7, "s", 7)]
    assert rows(dml.upsert(table, new, {"v": fn.dec(4)}))[0] == (1, "a", 6)
    assert rows(dml.upsert(table, new, {"v": F.expr("t.v + s.v")}))[0] == (1, "a", 11)


def test_merge(table, spark):
    source = spark.createDataFrame([(1, 5), (4, 6), (None, 7)], "id int, v int")
    assert rows(dml.merge(table, source, "id", ["v"], True)) == [(1, "a", 5), (2, "b", None), (3, "c", 30), (4, None, 6), (None, None, 7)]
    assert rows(dml.merge(table, source, "id", ["v"], (), True)) == [(1, "a", 5)]
    assert rows(dml.merge(table, source, "id", ["v"], (), False, "t.v > 100"))[0] == (1, "a", 10)
    with pytest.raises(Exception, match="more than one source row"):
        dml.merge(table, source.unionAll(source), "id", ["v"]).collect()
    assert rows(dml.merge(table, source.limit(0), "id", ["v"], True)) == rows(table)


def test_update_and_delete_keep_unknown_rows(table, spark):
    assert rows(dml.update(table, {"v": fn.inc(1.0)}, "v > 5")) == [(1, "a", 11), (2, "b", None), (3, "c", 31)]
    assert rows(dml.update(table, {"name": "q"}, "v > 5", 1, ["id"])) == [(1, "q", 10), (2, "b", None), (3, "c", 30)]
    assert rows(dml.delete(table, "v > 5")) == [(2, "b", None)]
    other = spark.createDataFrame([(1, 100), (2, 200)], "id int, w int")
    assert rows(dml.update_join(table, other, "id", {"v": F.col("s.w")}, "s.w > 100")) == [(1, "a", 10), (2, "b", 200), (3, "c", 30)]
    assert rows(dml.delete_join(table, other, ["id"])) == [(3, "c", 30)] and dml.truncate(table).count() == 0
    with pytest.raises(Exception, match="more than one source row"):
        dml.update_join(table, other.unionAll(other), "id", {"v": F.col("s.w")}).collect()


def test_relations(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "cid int, pid int")
    many = {r["id"]: r["children"] for r in relations.has_many(parents, children, "pid").collect()}
    assert [c["cid"] for c in many[1]] == [10, 11] and many[2] == []
    assert {r["id"]: r["child"] and r["child"]["cid"] for r in relations.has_one(parents, children, "pid").collect()} == {1: 10, 2: None}
    assert {r["cid"]: r["parent"] and r["parent"]["id"] for r in relations.belongs_to(children, parents, "pid").collect()} == {10: 1, 11: 1, 12: None}
    pairs = spark.createDataFrame([(1, 10), (1, 10), (2, 12)], "p int, c int")
    through = relations.has_many_through(parents, pairs, children, "p", "c", related_key="cid")
    assert {r["id"]: [c["cid"] for c in r["children"]] for r in through.collect()} == {1: [10], 2: [12]}


def test_update_limit_changes_so_many_rows(spark):
    rows = [(1, "a", None), (2, "a", 5), (3, "a", 5), (3, "a", 5), (4, "b", None)]
    df = spark.createDataFrame(rows, "k int, g string, v int").repartition(3)
    for order, limit, hit in ((["g"], 1, [1]), (["g"], 3, [1, 2, 3]), (["v"], 2, [2, 3]), ([F.col("v").desc_nulls_first()], 2, [1, 4]), (["k"], 9, [1, 2, 3, 3, 4])):
        out = dml.update(df, {"g": "new"}, None, limit, order).collect()
        assert len(out) == 5 and sorted(r["k"] for r in out if r["g"] == "new") == hit
    assert [r["k"] for r in dml.update(df, {"g": "new"}, "g = 'b'", 3, ["k"]).collect() if r["g"] == "new"] == [4]


def test_merge_leaves_a_large_table_where_it_is(spark, sf):
    table = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_quantity")
    source = [{"l_orderkey": 1, "l_quantity": 0.0}, {"l_orderkey": None, "l_quantity": 1.0}]
    merged = dml.merge(table, source, "l_orderkey", ["l_quantity"], True)
    assert merged.count() == table.count() + 1
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("FileScan") == 2  # a broadcast join right above either scan


def test_csv_keeps_line_breaks_and_rows_like_the_header(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text('junk\na,b\n1,"x\ny"\na,b\n\n ,\n2\n3,4,5\n')
    out = files.load_csv(spark, str(tmp_path), skip=1).collect()
    assert sorted(map(tuple, out), key=str) == sorted(2 * [("1", "x\ny"), ("a", "b"), ("2", None), ("3", "4")], key=str)
    assert files.load_csv(spark, str(tmp_path), ["a", "b"], skip=2).count() == 8


def test_row_rules(spark):
    df = spark.createDataFrame([("a@b.com", "5"), ("nope", "x"), (None, None)], "mail string, n string")
    broken = relations.violations(df, {"mail": relations.email("mail"), "n": relations.integer("n", 1, 9), "there": relations.required("n"), "short": relations.string("mail", 0, 10)})
    assert {tuple(r["broken_rules"]) for r in broken.collect()} == {("mail", "n"), ("there",)}  # blank values break required() alone


def test_schemas_and_constraints(spark, table):
    made = ddl.create_table(spark, {"id": "primary_key", "price": ddl.ColumnSchema("decimal", 10, 2).not_null(), "at": "timestamp", "tags": "array:string"})
    assert made.schema.simpleString() == "struct<id:int,price:decimal(10,2),at:timestamp_ntz,tags:array<string>>" and not made.schema["price"].nullable
    changed = ddl.rename_column(ddl.alter_column(ddl.add_column(ddl.drop_column(table, "v"), "w", ddl.ColumnSchema("integer", default=3)), "id", "big_integer"), "name", "title")
    assert changed.schema.simpleString() == "struct<id:bigint,title:string,w:int>" and changed.first()["w"] == 3
    held = ddl.Constraints()
    held.add_primary_key("pk", "t", ["v"])
    held.add_unique("uq", "t", ["v"])
    held.add_check("ck", "t", "v < 20")
    held.add_foreign_key("fk", "t", ["v"], "u", ["x"])
    held.create_index("ix", "t", ["name"])
    broken = held.violations("t", {"t": table, "u": spark.createDataFrame([(10,)], "x int")})
    assert {k: v.count() for k, v in broken.items()} == {"pk": 1, "uq": 0, "ck": 1, "fk": 1}
    held.rename("ix", "t", "ix2")
    held.drop("fk", "t")
    assert held.exists("ix2", "t", "index") and not held.exists("fk", "t") and len(held.listed("t", "unique")) == 1


def test_shards_and_search(spark, table):
    import zlib

    found = table.select("id", services.hash_shard("id", 3).alias("h"), services.modulo_shard("id", 2).alias("m"), services.range_shard("id", [("a", 0, 2), ("b", 2, 9)]).alias("r")).collect()
    assert [(r["h"], r["m"], r["r"]) for r in found] == [(zlib.crc32(str(i).encode()) % 3 + 1, i % 2 + 1, "a" if i <= 2 else "b") for i in (1, 2, 3)]
    with pytest.raises(Exception, match="no shard"):
        table.select(services.range_shard("id", [("a", 0, 1)])).collect()
    assert rows(services.search(table, "3")) == [(3, "c", 30)]


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id, name ,v\n\n4, Dave ,new\n5,"Eve, x"\n6,a,b,c\n , ,\n')
    df = files.load_csv(spark, str(path))
    assert df.columns == ["id", "name", "v"] and rows(df) == [("4", "Dave", "new"), ("5", "Eve, x", None), ("6", "a", "b")]
    plain = tmp_path / "y.csv"
    plain.write_text("skip me\n>4;Dave\n5;Eve\n>6;Fay\n")
    assert rows(files.load_csv(spark, str(plain), ["id", "name"], ";", prefix=">")) == [("4", "Dave"), ("6", "Fay")]
    assert rows(files.load_csv(spark, str(plain), ["id", "name"], ";", skip=1)) == [("5", "Eve"), (">4", "Dave"), (">6", "Fay")]
    files.save_csv(df, str(tmp_path / "out"))
    assert rows(files.load_csv(spark, str(tmp_path / "out"))) == rows(df)
    (tmp_path / "none.csv").write_text("")
    assert files.load_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0


def test_xml_and_json(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<users><user><name>Ann</name><age>3</age></user><user><name>Bob</name><age/></user></users>")
    assert rows(files.load_xml(spark, str(tmp_path / "x.xml"), "<user>", fields=["name", "age"])) == [("Ann", "3"), ("Bob", None)]
    assert rows(files.load_xml(spark, str(tmp_path / "x.xml"), "user", 1, ["name"])) == [("Bob",)]
    (tmp_path / "a.json").write_text('[{"id":1,"t":{"x":[1]}},5,{"id":2,"u":"no"}]')
    (tmp_path / "l.json").write_text('{"id":1,"t":{"x":[1]}}\n\n7\n{"id":2}\n')
    assert rows(files.load_json(spark, str(tmp_path / "a.json"))) == rows(files.load_json(spark, str(tmp_path / "l.json"))) == [("1", '{"x":[1]}'), ("2", None)]
    assert rows(files.load_json(spark, str(tmp_path / "l.json"), ["id"])) == [("1",), ("2",)]


def test_text_of_rows(spark, tmp_path, table):
    assert files.to_csv([{"a": 1, "b": 'x"y'}, {"a": 2, "b": None}]) == 'a,b\n1,"x""y"\n2,\n' and files.to_csv([]) == ""
    assert files.to_json([{"a": "é"}], pretty=False) == '[{"a": "é"}]'
    assert files.to_xml([{"a b": "1<2", "c": [1]}]) == '<?xml version="1.0" encoding="UTF-8"?>\n<data>\n  <item>\n    <a_b>1&lt;2</a_b>\n    <c>\n      <item>1</item>\n    </c>\n  </item>\n</data>\n'
    files.dump(table, str(tmp_path / "d"))
    assert rows(files.restore(spark, str(tmp_path / "d"))) == rows(table)
    files.save_json(table, str(tmp_path / "j"))
    files.save_xml(table, str(tmp_path / "x"))
    ddl.write_laid_out(table, str(tmp_path / "laid"), ["name"], ["id"])
    assert spark.read.parquet(str(tmp_path / "laid")).count() == 3


def test_streams_give_what_batches_give(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = windows.read(spark, str(tmp_path / "events"), events.schema)
    query = windows.windowed(stream, "ts", ["event_type"], late="10000 days").writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("windowed")) == rows(windows.windowed(events, "ts", ["event_type"]))
    assert windows.sessions(events, "ts", ["user_id"]).agg(F.sum("n")).first()[0] == events.count()
