"""Related rows beside each row: one join a relation, never one query a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _struct(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns or df.columns)


def has_many(parents: DataFrame, children: DataFrame, foreign_key: str, local_key: str = "id", name: str = "children", columns: Sequence[str] | None = None) -> DataFrame:
    """An array of the children, in the order of their columns; empty if there are none. A parent's children are one value and so meet in one task: relate what is bounded, and join what isn't."""
    packed = F.struct(*_struct(children, columns))
    lists = children.groupBy(F.col(foreign_key).alias("__fk")).agg(F.sort_array(F.collect_list(packed)).alias(name))
    joined = parents.join(lists, F.col(local_key) == F.col("__fk"), "left").drop("__fk")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def has_one(parents: DataFrame, children: DataFrame, foreign_key: str, local_key: str = "id", name: str = "child", order: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """The first child in `order` (its columns if not given) as a struct, null if there is none."""
    first = Window.partitionBy(foreign_key).orderBy(*(order or children.columns))
    ones = children.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(F.col(foreign_key).alias("__fk"), F.struct(*_struct(children, columns)).alias(name))
    return parents.join(ones, F.col(local_key) == F.col("__fk"), "left").drop("__fk")


def belongs_to(children: DataFrame, parents: DataFrame, foreign_key: str, owner_key: str = "id", name: str = "parent", columns: Sequence[str] | None = None) -> DataFrame:
    ones = parents.select(F.col(owner_key).alias("__pk"), F.struct(*_struct(parents, columns)).alias(name))
    return children.join(ones, F.col(foreign_key) == F.col("__pk"), "left").drop("__pk")


def has_many_through(parents: DataFrame, junction: DataFrame, children: DataFrame, parent_key: str, child_key: str, local_key: str = "id", related_key: str = "id", name: str = "children", columns: Sequence[str] | None = None) -> DataFrame:
    """The distinct children that the junction links to each row."""
    pairs = junction.select(F.col(parent_key).alias("__fk"), F.col(child_key).alias("__ck")).distinct()
    packed = children.select(F.col(related_key).alias("__rk"), F.struct(*_struct(children, columns)).alias("__child"))
    lists = pairs.join(packed, F.col("__ck") == F.col("__rk")).groupBy("__fk").agg(F.sort_array(F.collect_list("__child")).alias(name))
    joined = parents.join(lists, F.col(local_key) == F.col("__fk"), "left").drop("__fk")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


KINDS = {"has_many": has_many, "has_one": has_one, "belongs_to": belongs_to}


def loaded(db, table: str, df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """`df`, rows of `table`, with the relations named by dotted paths beside each row, as nested columns. One join a relation."""
    tree: dict[str, list[str]] = {}
    for path in paths:
        name, _, rest = path.partition(".")
        tree.setdefault(name, []).extend([rest] if rest else [])
    for name, below in tree.items():
        if name not in db.relations.get(table, {}):
            raise ValueError(f"no relation {name!r} of {table}")
        kind, other, given = db.relations[table][name]
        related = loaded(db, other, db.frame(other), below)
        if kind == "has_many_through":
            df = has_many_through(df, db.frame(given["junction"]), related, name=name, **{k: v for k, v in given.items() if k != "junction"})
        else:
            df = KINDS[kind](df, related, name=name, **given)
    return df


# ---- row quality ----------------------------------------------------------------


def required(column: str):
    return F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "")


def _blank(column: str):
    """Null and empty values break no rule but required()."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")) == ""


def email(column: str):
    return _blank(column) | F.coalesce(F.regexp_like(F.col(column), F.lit(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")), F.lit(False))


def integer(column: str, low: int | None = None, high: int | None = None):
    number = F.col(column).cast("string").try_cast("long")
    fits = number.isNotNull()
    if low is not None:
        fits = fits & (number >= low)
    if high is not None:
        fits = fits & (number <= high)
    return _blank(column) | F.coalesce(fits, F.lit(False))


def string(column: str, shortest: int = 0, longest: int | None = None):
    n = F.char_length(F.col(column))
    fits = n >= shortest if longest is None else n.between(shortest, longest)
    return _blank(column) | F.coalesce(fits, F.lit(False))


def violations(df: DataFrame, rules: dict) -> DataFrame:
    """The rows that break a rule, with the names of the rules they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)
