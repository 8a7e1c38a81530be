"""Plain rows as interval relations: times from columns, edges, ordinals or the clock, and what is done with late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.frame import INF, VE, VS, col, over, valid
from tidemark.operators.running import BUCKETS, bucketed


def from_start(df: DataFrame, start: str | Column) -> DataFrame:
    """Each row is valid from ``start`` on."""
    return df.withColumns({VS: col(start).cast("long"), VE: F.lit(INF)})


def from_interval(df: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Each row is valid in ``[start, end)``; a null end is open, and empty intervals vanish."""
    return valid(df.withColumns({VS: col(start).cast("long"), VE: F.coalesce(col(end).cast("long"), F.lit(INF))}))


def from_edges(df: DataFrame, time: str, is_end: str | Column, payload: Sequence[str]) -> DataFrame:
    """Rows that start or end a payload, as intervals: the n-th start of a payload is closed by its n-th end, or open without one."""
    by = [*payload, "__end"]
    edges = df.withColumn("__end", col(is_end)).withColumn("__n", F.row_number().over(over(by, time)))
    agg = [F.min(F.when(~F.col("__end"), F.col(time))).alias(VS), F.coalesce(F.min(F.when(F.col("__end"), F.col(time))), F.lit(INF)).alias(VE)]
    return valid(edges.groupBy(*payload, "__n").agg(*agg).drop("__n").filter(F.col(VS).isNotNull()))


def sequence_timeline(df: DataFrame, order: str, sample: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Rows without a time, numbered by ``order`` (an integer without ties); time moves on by one every ``sample`` rows."""
    cut = bucketed(df, order, (), buckets)
    sizes = cut.groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(order)) - 1
    vs = F.floor((F.col("__before") + F.col("__rank")) / sample).cast("long")
    out = cut.withColumn("__rank", rank).join(carry, "bucket").withColumns({VS: vs})
    return out.withColumn(VE, F.col(VS) + 1).select(*df.columns, VS, VE)


def clock_timeline(df: DataFrame) -> DataFrame:
    """Rows without a time, at the time at which the query starts."""
    now = F.unix_millis(F.current_timestamp())
    return df.withColumns({VS: now, VE: now + 1})


def with_progress(df: DataFrame, arrival: str, latency: int = 0, keys: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Adds ``progress``: the highest ``vs`` of all rows that arrived before, less ``latency``; null for the first."""
    cut = bucketed(df, arrival, keys, buckets)
    by = [*keys, "bucket"]
    chain = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.orderBy("bucket")
    tops = cut.groupBy(*by).agg(F.max(VS).alias("__top"))
    carry = tops.select(*[F.col(k).alias(f"__k_{k}") for k in by], F.max("__top").over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.max(VS).over(Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return cut.withColumn("__in", inside).join(carry, same, "left").select(*df.columns, (F.greatest("__in", "__before") - latency).alias("progress"))


def disorder(df: DataFrame, arrival: str, policy: str = "throw", latency: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """What arrives later than ``latency`` after newer rows: an error (``throw``), left out (``drop``) or moved to the progress (``adjust``).

    ``arrival`` is the integer order of arrival. An adjusted row whose end is not after the progress is left out.
    """
    seen = with_progress(df, arrival, latency, keys)
    late = F.coalesce(F.col(VS) < F.col("progress"), F.lit(False))
    match policy:
        case "throw":
            checked = F.when(late, F.raise_error(F.concat(F.lit("late row at "), F.col(VS).cast("string")))).otherwise(F.col(VS)).cast("long")
            return seen.withColumn(VS, checked).drop("progress")
        case "drop":
            return seen.filter(~late).drop("progress")
        case "adjust":
            return valid(seen.withColumn(VS, F.when(late, F.col("progress")).otherwise(F.col(VS)))).drop("progress")
    raise ValueError(f"no policy {policy!r}")


def late_rows(df: DataFrame, arrival: str, policy: str = "drop", latency: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """The late rows as they came, with ``moved_by``: how far ``adjust`` moves them, null if they are left out."""
    seen = with_progress(df, arrival, latency, keys).filter(F.col(VS) < F.col("progress"))
    stays = (F.lit(policy) == "adjust") & (F.col("progress") < F.col(VE))
    return seen.withColumn("moved_by", F.when(stays, F.col("progress") - F.col(VS))).drop("progress")


def punctuations(df: DataFrame, arrival: str, period: int, keys: Sequence[str] = ()) -> DataFrame:
    """The progress marks of a periodic policy: where a row's time reaches a later multiple of ``period`` than all before it, that multiple, with the row's ``arrival``."""
    seen = with_progress(df, arrival, 0, keys)
    reached = F.col(VS) - F.pmod(F.col(VS), F.lit(period))
    before = F.col("progress") - F.pmod(F.col("progress"), F.lit(period))
    return seen.filter(F.coalesce(reached > before, F.lit(True))).select(*keys, arrival, reached.alias("mark"))


def flushed(df: DataFrame, arrival: str, marks: DataFrame, policy: str = "on_punctuation", batch: int = 80_000) -> DataFrame:
    """Adds ``flush``: the arrival at which a row leaves the system. ``on_punctuation``: with the first mark that follows it; ``on_batch``: with the last row of its batch; ``none``: at the end (null)."""
    match policy:
        case "none":
            return df.withColumn("flush", F.lit(None).cast("long"))
        case "on_batch":
            return df.withColumn("flush", (F.floor(F.col(arrival) / batch) + 1) * batch - 1)
        case "on_punctuation":
            both = df.withColumn("__mark", F.lit(0)).unionByName(marks.select(F.col(arrival), F.lit(1).alias("__mark")), allowMissingColumns=True)
            cut = bucketed(both, arrival, ())
            later = F.min(F.when(F.col("__mark") == 1, F.col(arrival)))
            inside = later.over(Window.partitionBy("bucket").orderBy(arrival).rangeBetween(1, Window.unboundedFollowing))
            firsts = cut.groupBy("bucket").agg(later.alias("__first"))
            carry = firsts.select(F.col("bucket").alias("__bucket"), F.min("__first").over(Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
            met = cut.withColumn("__in", inside).join(carry, F.col("bucket") == F.col("__bucket"), "left").filter("__mark = 0")
            return met.select(*df.columns, F.coalesce("__in", "__after").alias("flush"))
    raise ValueError(f"no policy {policy!r}")


def completed(df: DataFrame, progress: int, policy: str = "end_of_stream") -> DataFrame:
    """The results that a query gives when its input ends at ``progress``: only those that were final (``none``), those that had begun, cut at the progress (``flush``), or all (``end_of_stream``)."""
    match policy:
        case "none":
            return df.filter(F.col(VE) <= progress)
        case "flush":
            return valid(df.filter(F.col(VS) < progress).withColumn(VE, F.least(F.col(VE), F.lit(progress))))
        case "end_of_stream":
            return df
    raise ValueError(f"no policy {policy!r}")


def route(df: DataFrame, routes: dict[str, Column]) -> dict[str, DataFrame]:
    """Rows by the first of the conditions that they meet; what meets none is under ``""``."""
    place = F.lit("")
    for name, condition in reversed(routes.items()):
        place = F.when(condition, F.lit(name)).otherwise(place)
    routed = df.withColumn("__route", place)
    return {name: routed.filter(F.col("__route") == name).drop("__route") for name in (*routes, "")}
