"""Interval relations as plain rows, edges and files."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.frame import INF, VE, VS, Props, TemporalFrame


def start_rows(df: DataFrame) -> DataFrame:
    """Payloads with the time they start at."""
    return df.drop(VE)


def edges(df: DataFrame) -> DataFrame:
    """A row for each start and one for each end that is not open: ``time``, ``is_end`` and the payload."""
    payload = [c for c in df.columns if c not in (VS, VE)]
    start = F.struct(F.col(VS).alias("time"), F.lit(False).alias("is_end"))
    end = F.struct(F.col(VE).alias("time"), F.lit(True).alias("is_end"))
    both = F.when(F.col(VE) == INF, F.array(start)).otherwise(F.array(start, end))
    return df.select(*payload, F.inline(both))


def reshape(edge_rows: DataFrame, payload: list[str], policy: str = "none") -> DataFrame:
    """Edges as they are (``none``), or each start with its end as one interval (``coalesce``)."""
    from tidemark.sources.ingress import from_edges

    if policy == "none":
        return edge_rows
    if policy == "coalesce":
        return from_edges(edge_rows, "time", "is_end", payload).select(*payload, VS, VE)
    raise ValueError(f"no policy {policy!r}")


def payloads(df: DataFrame) -> DataFrame:
    return df.drop(VS, VE)


def state_at(df: DataFrame, time: int | None = None) -> DataFrame:
    """Payloads valid at ``time``, or at the latest start."""
    if time is None:
        time = df.agg(F.max(VS)).first()[0]
    return df.filter((F.col(VS) <= F.lit(time)) & (F.col(VE) > F.lit(time))).drop(VS, VE)


def write_relation(frame: TemporalFrame, path: str, mode: str = "errorifexists") -> None:
    """The rows as Parquet; keys and promises go with them as the metadata of ``vs``."""
    note = {"relation": json.dumps({"keys": list(frame.keys), "props": asdict(frame.props)})}
    frame.df.withColumn(VS, F.col(VS).alias(VS, metadata=note)).write.mode(mode).parquet(path)


def read_relation(spark: SparkSession, path: str) -> TemporalFrame:
    df = spark.read.parquet(path)
    note = json.loads(df.schema[VS].metadata.get("relation", '{"keys": [], "props": {}}'))
    return TemporalFrame(df, tuple(note["keys"]), Props(**note["props"]))
