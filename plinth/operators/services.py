"""Cache, profiler, plan advice, shard functions and table search."""

from __future__ import annotations

import fnmatch
import re
import time
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager, redirect_stdout
from dataclasses import dataclass
from functools import reduce
from io import StringIO
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.core import col


class Cache:
    """Results kept by Spark, found again by the meaning of their plan or by a key, until their time is up or a table they read is changed."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[DataFrame, float | None, frozenset[str]]] = {}
        self.hits = self.misses = 0

    def keep(self, df: DataFrame, key: str | None = None, ttl: float | None = None, tables: Iterable[str] = ()) -> DataFrame:
        """`ttl` in seconds; `tables`: names whose change invalidates the result."""
        name, now = key or f"plan:{df.semanticHash()}", time.monotonic()
        found = self.kept.get(name)
        if found and (found[1] is None or now < found[1]):
            self.hits += 1
            return found[0]
        if found:
            self.kept.pop(name)[0].unpersist()
        self.misses += 1
        self.kept[name] = (df.persist(StorageLevel.MEMORY_AND_DISK), None if ttl is None else now + ttl, frozenset(tables))
        return self.kept[name][0]

    def _drop(self, names: list[str]) -> int:
        for name in names:
            self.kept.pop(name)[0].unpersist()
        return len(names)

    def invalidate(self, pattern: str = "*") -> int:
        return self._drop(fnmatch.filter(self.kept, pattern))

    def invalidate_tables(self, *tables: str) -> int:
        return self._drop([name for name, (_, _, read) in self.kept.items() if read & set(tables)])

    def stats(self) -> dict[str, int]:
        return {"entries": len(self.kept), "hits": self.hits, "misses": self.misses}


class Profiler:
    """Times of the actions run inside measure()."""

    def __init__(self, slow: float = 1.0) -> None:
        self.slow, self.times = slow, defaultdict(list)

    @contextmanager
    def measure(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.times[name].append(time.perf_counter() - start)

    def stats(self) -> dict[str, dict[str, float]]:
        return {k: {"count": len(t), "total": sum(t), "avg": sum(t) / len(t), "min": min(t), "max": max(t)} for k, t in self.times.items()}

    def slowest(self, n: int = 10) -> list[tuple[str, float]]:
        return sorted(((k, x) for k, t in self.times.items() for x in t if x >= self.slow), key=lambda x: -x[1])[:n]

    def reset(self) -> None:
        self.times.clear()


@dataclass(frozen=True)
class Finding:
    kind: str
    detail: str
    advice: str


class Advice:
    """Reads a physical plan for what costs much at scale."""

    def plan(self, df: DataFrame, mode: str = "formatted") -> str:
        out = StringIO()
        with redirect_stdout(out):
            df.explain(mode)
        return out.getvalue()

    def measured(self, df: DataFrame) -> list[tuple[str, str, int]]:
        """(node, metric, value) of each node of the plan after it has run; its rows stay on the executors."""
        run = df._jdf.queryExecution()
        run.toRdd().count()
        found, waiting = [], [run.executedPlan()]
        while waiting:
            node = waiting.pop()
            name = node.nodeName()
            if name == "AdaptiveSparkPlan":
                waiting.append(node.executedPlan())
                continue
            metrics = node.metrics().iterator()
            while metrics.hasNext():
                one = metrics.next()
                found.append((name, one._1(), one._2().value()))
            if "QueryStage" in name:
                waiting.append(node.plan())
            children = node.children().iterator()
            while children.hasNext():
                waiting.append(children.next())
        return found

    def advise(self, df: DataFrame) -> list[Finding]:
        text = self.plan(df, "simple")
        found = []
        for scan in re.findall(r"FileScan [^\n]*", text):
            where = re.search(r"Location: [^\[]*\[([^\]]*)", scan)
            if "PushedFilters: []" in scan and "PartitionFilters: []" in scan:
                found.append(Finding("full_scan", where[1] if where else scan[:80], "filter on a column of the file, so that row groups can be passed over"))
            columns = re.search(r"ReadSchema: struct<([^>]*)>", scan)
            if columns and columns[1].count(":") > 20:
                found.append(Finding("wide_scan", f"{columns[1].count(':')} columns", "select only what is used"))
        for node, kind, advice in (("CartesianProduct", "cartesian_product", "give the join an equality"), ("BroadcastNestedLoopJoin", "nested_loop_join", "give the join an equality"), ("Exchange SinglePartition", "single_partition", "partition the window or aggregate by a key"), ("BatchEvalPython", "row_at_a_time_python", "use a built-in or vectorised function")):
            if node in text:
                found.append(Finding(kind, node, advice))
        shuffles = len(re.findall(r"Exchange (?:hash|range|round)", text))
        if shuffles > 4:
            found.append(Finding("many_shuffles", str(shuffles), "join and group on shared keys, or bucket the tables"))
        return found


# ---- shards -------------------------------------------------------------------


def hash_shard(key: Any, shards: int) -> Column:
    """1 to shards, by the CRC-32 of the key as text."""
    return (F.crc32(col(key).cast("string").cast("binary")) % shards + 1).cast("int")


def modulo_shard(key: Any, shards: int) -> Column:
    return (col(key).cast("long") % shards + 1).cast("int")


def range_shard(key: Any, ranges: Sequence[tuple[str, Any, Any]]) -> Column:
    """The name of the first range [low, high] that holds the key. A key in none is an error when the row is computed."""
    out: Column | None = None
    for name, low, high in ranges:
        hit = col(key).between(F.lit(low), F.lit(high))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    lost = F.raise_error(F.concat(F.lit("no shard for key "), F.coalesce(col(key).cast("string"), F.lit("null"))))
    return lost if out is None else out.otherwise(lost)


class Sharded:
    """One table in several, a row's shard given by its key: "hash", "modulo" or ranges {name: (low, high)}. A query for one key reads one shard."""

    def __init__(self, spark: SparkSession, key: str, shards: dict[str, DataFrame | str], rule: Any = "hash"):
        self.spark, self.key, self.shards, self.rule = spark, key, shards, rule

    def column(self, key: Any = None) -> Column:
        """The name of a row's shard."""
        names = F.array(*map(F.lit, self.shards))
        if isinstance(self.rule, dict):
            return range_shard(key if key is not None else self.key, [(name, low, high) for name, (low, high) in self.rule.items()])
        number = (hash_shard if self.rule == "hash" else modulo_shard)(key if key is not None else self.key, len(self.shards))
        return F.element_at(names, number)

    def shard_of(self, value: Any) -> str:
        return self.spark.range(1).select(self.column(F.lit(value))).first()[0]

    def frame(self, value: Any = None) -> DataFrame:
        """The rows of a key, read from its shard alone; all shards without a key."""
        held = [self.shards[self.shard_of(value)]] if value is not None else list(self.shards.values())
        found = reduce(DataFrame.unionByName, [x if isinstance(x, DataFrame) else self.spark.read.parquet(x) for x in held])
        return found if value is None else found.filter(F.col(self.key) == F.lit(value))


def search(df: DataFrame, term: str) -> DataFrame:
    """Rows in which any column, as text, contains the term."""
    as_text = lambda f: F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`").cast("string")
    return df.filter(reduce(lambda a, b: a | b, (F.coalesce(F.contains(as_text(f), F.lit(term)), F.lit(False)) for f in df.schema)))


def transform(df: DataFrame, *functions: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(lambda d, f: d.transform(f), functions, df)
