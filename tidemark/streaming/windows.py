"""Structured Streaming forms of the lifetime windows, joins and late-data policies.

Streams carry an event-time column of type timestamp. A result is final, and written in append mode, once the
watermark has passed it; update mode gives early results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ms(n: int) -> str:
    return f"{n} milliseconds"


def with_lateness(df: DataFrame, time: str, latency: int) -> DataFrame:
    """Rows more than ``latency`` ms behind the newest are late; stateful operators leave them out."""
    return df.withWatermark(time, ms(latency))


def hopping(df: DataFrame, time: str, size: int, period: int, aggregates: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """At each hop b (every ``period`` ms), aggregates of the rows in (b - size, b], valid ``[b, b + period)`` in ms, as the batch operator.

    Spark's windows are [start, start + size); one ms later they are (b - size, b].
    """
    window = F.window(time, ms(size), ms(period), ms(1)).alias("window")
    out = df.groupBy(*keys, window).agg(*[c.alias(n) for n, c in aggregates.items()])
    hop = F.unix_millis(F.col("window.end").cast("timestamp")) - 1
    return out.select(*keys, hop.alias("vs"), (hop + period).alias("ve"), *aggregates)


def tumbling(df: DataFrame, time: str, size: int, aggregates: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates of the rows in (b - size, b], valid ``[b, b + size)``."""
    return hopping(df, time, size, size, aggregates, keys)


def session(df: DataFrame, time: str, timeout: int, aggregates: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Aggregates of runs of rows that are less than ``timeout`` ms apart; a run ends ``timeout`` after its last row.

    Spark merges rows that are just its gap apart, so its gap is one ms less.
    """
    window = F.session_window(time, ms(timeout - 1)).alias("window")
    out = df.groupBy(*keys, window).agg(*[c.alias(n) for n, c in aggregates.items()])
    start, end = (F.unix_millis(F.col(f"window.{side}").cast("timestamp")) for side in ("start", "end"))
    return out.select(*keys, start.alias("vs"), (end + 1).alias("ve"), *aggregates)


def distinct(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """First row of each value; the state of a value lasts as long as the watermark allows."""
    return df.dropDuplicatesWithinWatermark(list(by))


def followed_within(left: DataFrame, right: DataFrame, left_time: str, right_time: str, within: int, keys: Sequence[str], how: str = "inner", prefix: str = "r_") -> DataFrame:
    """Pairs of rows of equal keys where right comes after left by less than ``within`` ms; both need ``with_lateness``."""
    r = right.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    after = F.col(f"{prefix}{right_time}")
    cond = (after > F.col(left_time)) & (after < F.col(left_time) + F.expr(f"INTERVAL {within / 1000} SECONDS"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"{prefix}{k}"))
    return left.join(r, cond, how)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all there is to Parquet, and stop; the next call goes on from the checkpoint."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Hand each batch's rows to ``write`` (with the batch's number, for writing once)."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
