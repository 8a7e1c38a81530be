"""Connected components of a link table by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) to (node, root): each linked node with the smallest node that it reaches.

    Each round points every node's larger neighbours, then its smaller ones,
    at the smallest neighbour; the number of links never grows, and stars are
    reached in a logarithmic number of rounds. Rounds are cut by tables in the
    shared folder. A hub's links are rows like any other, its smallest
    neighbour is pre-aggregated, and the join back is one that adaptive
    execution can split.
    """
    now = scratch.save(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = signature(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        # Large star: for each u, every neighbour v > u is linked to the least of u and its neighbours.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        # Small star: for each u, its smaller neighbours and u itself are linked to the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).distinct()
        then = scratch.save(small)
        scratch.drop(now)
        now, before, mark = then, mark, signature(then)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def signature(links: DataFrame) -> tuple[int, int, int]:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return row[0], row[1] or 0, row[2] or 0
