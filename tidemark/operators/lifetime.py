"""Operators on lifetimes: alter, window, clip, cut and merge."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.frame import INF, VE, VS, col, over, plus, valid


def snap_down(t: Column, period: int, offset: int = 0) -> Column:
    """The last point of the grid ``offset + k * period`` at or before t."""
    return t - F.pmod(t - offset, F.lit(period))


def snap_up(t: Column, period: int, offset: int = 0) -> Column:
    return snap_down(t + (period - 1), period, offset)


def alter_lifetime(df: DataFrame, start: str | Column, duration: str | Column | int) -> DataFrame:
    """New start, and duration from it; both may use any column, vs and ve too."""
    length = F.lit(duration) if isinstance(duration, int) else col(duration)
    return valid(df.withColumns({VS: col(start), VE: plus_from(col(start), length)}))


def plus_from(start: Column, length: Column) -> Column:
    return F.when(length >= F.lit(INF) - F.greatest(start, F.lit(0)), F.lit(INF)).otherwise(start + length)


def alter_duration(df: DataFrame, duration: str | Column | int) -> DataFrame:
    return alter_lifetime(df, F.col(VS), duration)


def shift(df: DataFrame, by: int | str | Column) -> DataFrame:
    d = F.lit(by) if isinstance(by, int) else col(by)
    return df.withColumns({VS: F.col(VS) + d, VE: plus(F.col(VE), d)})


def hopping(df: DataFrame, size: int, period: int, offset: int = 0) -> DataFrame:
    """Starts move up to the next hop; a result at hop b then covers starts in (b - size, b].

    Where hops are farther apart than the size, starts that no window covers are dropped.
    """
    start = snap_up(F.col(VS), period, offset)
    if period > size:
        df = df.filter(start - F.col(VS) < size)
    end = start + size if size % period == 0 else snap_up(F.col(VS) + size, period, offset)
    return valid(df.withColumns({"__s": start, "__e": end}).withColumns({VS: F.col("__s"), VE: F.col("__e")}).drop("__s", "__e"))


def tumbling(df: DataFrame, size: int, offset: int = 0) -> DataFrame:
    return hopping(df, size, size, offset)


def chop(df: DataFrame, period: int, offset: int = 0) -> DataFrame:
    """Cut lifetimes at the beats ``offset + k * period``. Open ends can't be cut into finitely many pieces and stay whole from their last beat."""
    first = snap_down(F.col(VS), period, offset)
    beats = F.when(F.col(VE) == INF, F.array(first)).otherwise(F.sequence(first, F.col(VE) - 1, F.lit(period)))
    cut = df.withColumn("__beat", F.explode(beats))
    end = F.when(F.col(VE) == INF, F.lit(INF)).otherwise(F.least(F.col(VE), F.col("__beat") + period))
    return cut.withColumns({"__s": F.greatest(F.col(VS), F.col("__beat")), "__e": end}).withColumns({VS: F.col("__s"), VE: F.col("__e")}).drop("__s", "__e", "__beat")


def repetitive_hopping(df: DataFrame, size: int, period: int, offset: int = 0) -> DataFrame:
    """Hopping windows as one copy for each hop."""
    return chop(hopping(df, size, period, offset), period, offset)


def quantize(df: DataFrame, size: int, period: int, offset: int = 0, progress: int | None = None) -> DataFrame:
    """Starts go down and ends up to the windows they touch; ``progress`` (a divisor of period) gives early results on a finer grid of starts."""
    t = F.greatest(plus(F.col(VE), period - 1), F.col(VS) + size)
    end = F.when(F.col(VE) == INF, F.lit(INF)).otherwise(t - F.pmod(t - (offset + size), F.lit(period)))
    start = snap_down(F.col(VS), progress or period, offset)
    return valid(df.withColumns({"__s": start, "__e": end}).withColumns({VS: F.col("__s"), VE: F.col("__e")}).drop("__s", "__e"))


def progressive_quantize(df: DataFrame, size: int, period: int, progress: int, offset: int = 0) -> DataFrame:
    return quantize(df, size, period, offset, progress)


def session(df: DataFrame, timeout: int, max_duration: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Every event of a session gets the session's end: ``timeout`` after its last event.

    A gap of ``timeout`` or more closes a session; so does, with
    ``max_duration``, the grid point that its start sets: then boundaries depend
    on earlier ones, and each key's events are gone through in order.
    """
    w = over(keys, VS)
    if not max_duration:
        gap = F.col(VS) - F.lag(VS).over(w) >= timeout
        number = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0))
        whole = Window.partitionBy(*[F.col(k) for k in keys], F.col("__session"))
        return df.withColumn("__session", number).withColumn(VE, F.max(VS).over(whole) + timeout).drop("__session")

    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(VS, kind="stable")
        starts, ends = groups[VS].tolist(), [0] * len(groups)
        begin, cap, last = 0, None, None
        for i, t in enumerate(starts):
            if last is not None and (t >= last + timeout or t >= cap):
                for j in range(begin, i):
                    ends[j] = min(last + timeout, cap)
                begin, last = i, None
            if last is None:
                cap = t - t % max_duration + (1 if t % max_duration == 0 else 2) * max_duration
            last = t
        for j in range(begin, len(starts)):
            ends[j] = min(last + timeout, cap)
        groups[VE] = ends
        return groups

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def clip(df: DataFrame, limit: int) -> DataFrame:
    """Lifetimes of ``limit`` at most."""
    return df.withColumn(VE, F.least(F.col(VE), F.col(VS) + limit))


def clip_by(df: DataFrame, other: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """End at the first start of ``other``, of equal keys (null equals null), that is later than one's own."""
    left = df.withColumns({"__t": F.col(VS), "__side": F.lit(0)})
    right = other.select(*keys, F.col(VS).alias("__t")).distinct().withColumn("__side", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True)
    # Rows of one time look beyond it, so a frame of later times gives the first later start.
    later = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("__t").rangeBetween(1, Window.unboundedFollowing)
    first = F.min(F.when(F.col("__side") == 1, F.col("__t"))).over(later)
    return valid(both.withColumn("__end", first).filter("__side = 0").withColumn(VE, F.least(F.col(VE), F.coalesce("__end", F.lit(INF)))).drop("__t", "__side", "__end"))


def clip_self(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """End at the next later start of the same keys: the value as of any time."""
    times = df.select(*keys, VS).distinct()
    after = times.withColumn("__next", F.lead(VS).over(over(keys, VS)))
    cond = F.col(VS) == F.col("__vs")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    names = after.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(VS).alias("__vs"), "__next")
    return valid(df.join(names, cond, "left").withColumn(VE, F.least(F.col(VE), F.coalesce("__next", F.lit(INF)))).select(*df.columns))


def extend(df: DataFrame, by: int) -> DataFrame:
    """Later ends; a negative ``by`` shrinks, and rows no longer than that vanish."""
    return valid(df.withColumn(VE, plus(F.col(VE), by)))


def point_at_end(df: DataFrame) -> DataFrame:
    """A point at each end; an open end has none."""
    return df.filter(F.col(VE) != INF).withColumns({VS: F.col(VE), VE: F.col(VE) + 1})


def payload_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (VS, VE)]


def stitch(df: DataFrame) -> DataFrame:
    """Join equal payloads where one ends as the other starts.

    Copies that overlap stay chains of their own: the n-th end at a time meets
    the n-th start. A point with as many ends as starts is passed through; only
    what starts or ends beyond that shows. So chains are paired in order from
    the surplus starts and surplus ends of each time.
    """
    payload = payload_of(df)
    edges = df.select(*payload, F.col(VS).alias("t"), F.lit(1).alias("d")).union(df.select(*payload, F.col(VE).alias("t"), F.lit(-1).alias("d")))
    net = edges.groupBy(*payload, "t").agg(F.sum("d").alias("d")).filter("d <> 0")
    each = net.withColumn("__n", F.explode(F.sequence(F.lit(1), F.abs("d"))))
    ranked = each.withColumn("__rank", F.row_number().over(Window.partitionBy(*payload, F.signum("d")).orderBy("t", "__n")))
    keys = [F.col(c) for c in payload]
    return ranked.groupBy(*keys, "__rank").agg(F.min("t").alias(VS), F.max("t").alias(VE)).drop("__rank")


def stitch_aggregate(df: DataFrame, aggregates: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregate each chain of abutting events of the same keys, whatever their payload."""
    w = over(keys, VS, VE)
    chained = df.withColumn("__new", F.coalesce((F.lag(VE).over(w) != F.col(VS)), F.lit(True)).cast("int"))
    chains = chained.withColumn("__chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chains.groupBy(*keys, "__chain").agg(F.min(VS).alias(VS), F.max(VE).alias(VE), *[c.alias(n) for n, c in aggregates.items()]).drop("__chain")

