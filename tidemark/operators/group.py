"""Operators on groups: split by key, map and reduce, choose among keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frame import VE, VS, col


def partition(df: DataFrame, by: dict[str, str | Column]) -> DataFrame:
    """Named key columns; operators keep them apart, and the first that needs it shuffles by them."""
    return df.withColumns({n: col(c) for n, c in by.items()})


def map_reduce(df: DataFrame, map_: Callable[[DataFrame], DataFrame], by: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Map rows, then aggregate those of equal ``by`` and lifetime; Spark combines before the shuffle."""
    return map_(df).groupBy(*by, VS, VE).agg(*[c.alias(n) for n, c in aggregates.items()])


def spray(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Deal rows to ``n`` partitions, by key if keys are given."""
    return df.repartition(n, *by) if by else df.repartition(n)


def group_union(*groups: DataFrame) -> DataFrame:
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    return out


def count_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def reduce_two(left: DataFrame, right: DataFrame, by: Sequence[str], aggregates: dict[str, Column], right_aggregates: dict[str, Column]) -> DataFrame:
    """Reduce two mapped inputs together: aggregates of both for each group and lifetime that either has; each side is reduced before they meet."""
    at = [*by, VS, VE]
    a = left.groupBy(*at).agg(*[c.alias(n) for n, c in aggregates.items()])
    b = right.groupBy(*at).agg(*[c.alias(n) for n, c in right_aggregates.items()]).withColumnsRenamed({c: f"__{c}" for c in at})
    cond = F.lit(True)
    for c in at:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    some = F.col(VS).isNotNull()
    return a.join(b, cond, "full").select(*[F.when(some, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in at], *aggregates, *right_aggregates)


def shufflecast(df: DataFrame, n: int) -> DataFrame:
    """Every row to each of ``n`` partitions, with ``shard``, its number."""
    return df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartitionById(n, F.col("shard"))


@dataclass(frozen=True)
class Sharded:
    """A relation dealt to shards, each a partition; queries run on all shards alike."""

    df: DataFrame
    n: int

    def query(self, f: Callable[[DataFrame], DataFrame]) -> Sharded:
        """A query that works on single rows; the rows stay in their shards."""
        return replace(self, df=f(self.df))

    def redistribute(self, n: int) -> Sharded:
        """Deal anew, evenly."""
        return Sharded(self.df.drop("shard").repartition(n).withColumn("shard", F.spark_partition_id()), n)

    def rekey(self, *by: str) -> Sharded:
        """Rows of equal keys into one shard."""
        return shard(self.df.drop("shard"), self.n, by)

    def cache(self) -> Sharded:
        return replace(self, df=self.df.persist())

    def unshard(self) -> DataFrame:
        return self.df.drop("shard")


def shard(df: DataFrame, n: int, by: Sequence[str]) -> Sharded:
    """Rows of equal ``by`` into one of ``n`` shards."""
    return Sharded(df.withColumn("shard", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")).repartitionById(n, F.col("shard")), n)
