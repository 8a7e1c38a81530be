"""Sequences that come from nothing, and those chosen, repeated or shared on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def return_(spark: SparkSession, **values) -> DataFrame:
    """One row."""
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])


def range_(spark: SparkSession, start: int, count: int, name: str = "value") -> DataFrame:
    return spark.range(start, start + count).select(F.col("id").alias(name))


def repeat_value(spark: SparkSession, value: Any, count: int, name: str = "value") -> DataFrame:
    return spark.range(count).select(F.lit(value).alias(name))


def timer(spark: SparkSession, due: int, period: int = 0, count: int = 1) -> DataFrame:
    """Ticks 0, 1, ...: the first at ``due``, one every ``period`` after it."""
    return spark.range(count).select(F.col("id").alias("tick"), (F.col("id") * period + due).alias("vs"))


def interval(spark: SparkSession, period: int, count: int) -> DataFrame:
    return timer(spark, period, period, count)


def generate(spark: SparkSession, initial: Any, condition: Callable[[Any], bool], iterate: Callable[[Any], Any], result: Callable[[Any], tuple], schema: str, batch: int = 10_000) -> DataFrame:
    """``result`` of each state from ``initial`` on, by ``iterate``, while ``condition`` holds. A loop by nature: one task, which hands on ``batch`` rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(",")]
        for one in batches:
            if not len(one):
                continue
            state, rows = initial, []
            while condition(state):
                rows.append(result(state))
                state = iterate(state)
                if len(rows) == batch:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return spark.range(0, 1, 1, 1).mapInPandas(run, schema)


def case_(key: Any, sources: dict[Any, DataFrame], default: DataFrame) -> DataFrame:
    """The source of the key, or the default."""
    return sources.get(key, default)


def if_(condition: Callable[[], bool], then: DataFrame, otherwise: DataFrame) -> DataFrame:
    return then if condition() else otherwise


def defer(factory: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """A source that is made anew each time it is asked for."""
    return lambda: factory()


def copies(source: DataFrame, n: int, part: str = "part") -> DataFrame:
    """The sequence ``n`` times; ``part`` numbers the copies."""
    parts = F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")
    return source.withColumn(part, F.explode(parts))


def while_(condition: Callable[[int], bool], source: DataFrame, part: str = "part", most: int = 1_000_000) -> DataFrame:
    """The sequence as often as ``condition`` (of the number of copies so far) holds before it."""
    n = 0
    while n < most and condition(n):
        n += 1
    return copies(source, n, part)


def do_while(source: DataFrame, condition: Callable[[int], bool], part: str = "part", most: int = 1_000_000) -> DataFrame:
    """Once, and then as often as ``condition`` holds after it."""
    n = 1
    while n < most and condition(n):
        n += 1
    return copies(source, n, part)


def for_(items: Iterable[Any], selector: Callable[[Any], DataFrame], part: str = "part") -> DataFrame:
    """The sequences that ``selector`` makes of the items, one after the other."""
    out = None
    for i, item in enumerate(items):
        now = selector(item).withColumn(part, F.lit(i))
        out = now if out is None else out.unionByName(now)
    if out is None:
        raise ValueError("no items")
    return out


@dataclass
class Connectable:
    """A source that several readers share: once connected it is worked out a single time, and its rows are kept by the executors until it is released. A lost one's rows are worked out again."""

    source: DataFrame
    connected: bool = False

    def connect(self) -> Connectable:
        if not self.connected:
            self.source = self.source.persist(StorageLevel.MEMORY_AND_DISK)
            self.connected = True
        return self

    def release(self) -> None:
        if self.connected:
            self.source.unpersist()
            self.connected = False

    def multicast(self, selector: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return selector(self.source)

    def replay(self, n: int, order: list[str]) -> DataFrame:
        """What a late reader sees: the last ``n`` rows."""
        from tidemark.operators.sequence import take_last

        return take_last(self.source, n, order)


def publish(df: DataFrame) -> Connectable:
    return Connectable(df)


def memoize(df: DataFrame) -> Connectable:
    """Connected at once: what a first reader worked out, others read."""
    return Connectable(df).connect()
