"""Helpers on edge cases."""

import datetime as dt

import pytest
from plinth import functions as fn
from plinth.functions.json import changed_text
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def get(df, column):
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: fn.trunc(F.lit(-2.567), 2), -2.56), (lambda: fn.trunc(F.lit(0.29), 2), 0.29), (lambda: fn.trunc(F.lit(7.9)), 7.0),
        (lambda: fn.concat(F.lit("a"), fn.null()), None), (lambda: fn.repeat("ab", 0), ""), (lambda: fn.pad_left(F.lit("abc"), 2), "ab"),
        (lambda: fn.regexp_extract(F.lit("abc"), "z(.)", 1), None), (lambda: fn.regexp_extract(F.lit("abc"), "b(.)", 1), "c"), (lambda: fn.position("z", F.lit("abc")), 0),
        (lambda: fn.replace(F.lit("it's"), "'", '"'), 'it"s'), (lambda: fn.length(F.lit("épée")), 4), (lambda: fn.left(F.lit("épée"), 2), "ép"), (lambda: fn.mod(F.lit(-7), F.lit(3)), -1),
        (lambda: fn.log(F.lit(100.0)), 2.0), (lambda: fn.greatest(F.lit(1), fn.null(), F.lit(3)), 3), (lambda: fn.in_(F.lit(1), []), False), (lambda: fn.not_in(F.lit(1), [2, None]), None),
        (lambda: fn.null_if(F.lit(1), 1), None), (lambda: fn.case([]), None), (lambda: fn.case({"false": 1}, 2), 2), (lambda: fn.try_cast(F.lit("x"), "int"), None),
        (lambda: fn.add_interval(F.lit(dt.date(2024, 1, 31)), 1, "MONTH"), dt.date(2024, 2, 29)), (lambda: fn.to_date(F.lit("31-01-2024"), "DD-MM-YYYY"), dt.date(2024, 1, 31)),
        (lambda: fn.to_ts(F.lit("2024-01-31 23:59:58")), dt.datetime(2024, 1, 31, 23, 59, 58)), (lambda: fn.match(F.lit("The quick fox"), "quick & !dog"), True), (lambda: fn.match(F.lit("The quick fox"), "slow | qu*"), True), (lambda: fn.match(F.lit("x"), ""), False),
    ],
)
def test_value(one, column, expected):
    found = get(one, column())
    if isinstance(expected, dt.date) and not isinstance(expected, dt.datetime) and isinstance(found, dt.datetime):
        found = found.date()
    assert found == expected


def test_bad_units(one):
    with pytest.raises(ValueError):
        fn.add_interval(F.lit(1), 1, "FORTNIGHT")
    with pytest.raises(ValueError):
        fn.now("tomorrow")


DOC = '{"a":{"b":1},"tags":["x","y"],"z":null,"n":2.5,"t":true}'


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda c: fn.json_get(c, "a.b"), "1"), (lambda c: fn.json_get(c, ["tags", 1]), "y"), (lambda c: fn.json_get(c, "tags", False), '["x","y"]'), (lambda c: fn.json_get(c, "none"), None),
        (lambda c: fn.json_exists(c, "z"), True), (lambda c: fn.json_exists(c, "none"), False), (lambda c: fn.json_length(c, "tags"), 2), (lambda c: fn.json_length(c, "a"), 0), (lambda c: fn.json_length(c, "none"), 0),
        (lambda c: fn.json_keys(c), ["a", "tags", "z", "n", "t"]), (lambda c: fn.json_contains(c, ["x", "y"], "tags"), True), (lambda c: fn.json_contains(c, "q", "tags"), False), (lambda c: fn.json_contains(c, 1, "a.b"), True), (lambda c: fn.json_contains(c, 1, "none"), False),
        (lambda c: fn.json_compare(c, "n", ">", 2), True), (lambda c: fn.json_compare(c, "t", "=", True), True), (lambda c: fn.json_type(c, "z"), "null"), (lambda c: fn.json_type(c, "n"), "number"), (lambda c: fn.json_type(c, "none"), None),
    ],
)
def test_json(one, column, expected):
    assert get(one, column(F.lit(DOC))) == expected


def test_json_changes(spark):
    assert changed_text("[1,2,3]", ["1"], "remove") == "[1,null,3]"
    assert changed_text('{"a":1}', ["b", "c"], "set", 2) == '{"a":1,"b":{"c":2}}'
    assert changed_text('{"a":1}', ["b"], "replace", 2) == '{"a":1}' and changed_text('{"a":1}', ["a"], "replace", None) == '{"a":null}'
    assert changed_text("no json", ["a"], "set", 1) == "no json" and changed_text("[1]", ["5"], "set", 1) == "[1]" and changed_text("[1]", ["1"], "set", 2) == "[1,2]"
    rows = spark.createDataFrame([('{"a":1}',), (None,)], "j string").select(fn.json_set("j", "b", 2).alias("j")).collect()
    assert {r["j"] for r in rows} == {'{"a":1,"b":2}', None}
