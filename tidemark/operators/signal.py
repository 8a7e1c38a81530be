"""Periodic signals: rows (vs, ve, val) of keys, on a grid of a period, with gaps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.operators.aggregate import attach_aggregate
from tidemark.operators.frame import VE, VS, col, over
from tidemark.operators.running import neighbours, ordinals

#: Threshold factors that the peak detector tries (fixed values).
FACTORS = (1.05, 1.10, 1.15, 1.20, 1.25, 1.30, 1.40, 1.50, 1.60, 1.70, 1.80, 1.90, 2.00, 2.10, 2.20, 2.50, 3.00, 4.00)
#: Samples that a task filters at a time.
FILTER_BLOCK = 200_000


def with_next(df: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """Adds next_vs (and next_<column>): the following sample of the keys."""
    if keys:
        w = over(keys, VS)
        return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in (VS, *more)})
    return neighbours(df, VS, [VS, *more]).drop("prev_vs", *[f"prev_{c}" for c in more])


def normalize(df: DataFrame, window: int, keys: Sequence[str] = (), ddof: int = 0, value: str = "val") -> DataFrame:
    """z-scores within tumbling windows [k * window, (k + 1) * window); null where the deviation is 0. ``ddof`` 1 takes that of a sample."""
    spread = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    out = attach_aggregate(df, window, {"__avg": F.avg(value), "__std": spread}, keys)
    return out.withColumn(value, (F.col(value) - F.col("__avg")) / F.nullif(F.col("__std"), F.lit(0.0))).drop("__avg", "__std")


def chop_gaps(df: DataFrame, period: int, gap_tol: int, keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Grid points from each sample up to the next one, if that is within the tolerance; else the sample's own only. ``source`` is the sample's time."""
    tol = max(period, gap_tol)
    ahead = with_next(df, keys)
    gap = F.col("next_vs") - F.col(VS)
    length = F.when(gap <= tol, gap).otherwise(F.lit(period))
    points = ahead.withColumn("source", F.col(VS)).withColumn("__t", F.explode(F.sequence(F.col(VS), F.col(VS) + length - 1, F.lit(period))))
    return points.withColumns({VS: F.col("__t"), VE: F.col("__t") + period}).drop("__t", "next_vs")


def fill_const(df: DataFrame, period: int, gap_tol: int, fill: float, keys: Sequence[str] = (), value: str = "val") -> DataFrame:
    """Missing grid points within the tolerance get ``fill``."""
    return chop_gaps(df, period, gap_tol, keys).withColumn(value, F.when(F.col(VS) == F.col("source"), F.col(value)).otherwise(F.lit(fill))).drop("source")


def fill_mean(df: DataFrame, window: int, period: int, gap_tol: int, keys: Sequence[str] = (), value: str = "val") -> DataFrame:
    """Missing grid points get the mean of the tumbling window of the sample before the gap."""
    out = chop_gaps(attach_aggregate(df, window, {"__avg": F.avg(value)}, keys), period, gap_tol, keys)
    return out.withColumn(value, F.when(F.col(VS) == F.col("source"), F.col(value)).otherwise(F.col("__avg"))).drop("source", "__avg")


def mask(df: DataFrame, period: int, gap_tol: int, keys: Sequence[str] = (), value: str = "val") -> DataFrame:
    """True at the grid points that are missing."""
    return chop_gaps(df, period, gap_tol, keys).withColumn(value, F.col(VS) != F.col("source")).drop("source")


def resample(df: DataFrame, period: int, new_period: int, gap_tol: int | None = None, keys: Sequence[str] = (), offset: int = 0, value: str = "val") -> DataFrame:
    """Linear interpolation between neighbours at ``offset + k * new_period``; the last sample has no right neighbour and gives nothing.

    Across a gap beyond the tolerance only the first ``period`` is kept
    (``gap_tol`` None: nothing at all unless the samples abut).
    """
    pair = with_next(df, keys, value).filter(F.col("next_vs").isNotNull())
    gap = F.col("next_vs") - F.col(VS)
    if gap_tol is None:
        pair = pair.filter(gap <= period)
        end = F.col("next_vs")
    else:
        end = F.when(gap > max(gap_tol, period), F.col(VS) + period).otherwise(F.col("next_vs"))
    first = F.col(VS) + F.pmod(offset - F.col(VS), F.lit(new_period))
    points = pair.withColumns({"__first": first, "__end": end}).filter("__first < __end").withColumn("__t", F.explode(F.sequence(F.col("__first"), F.col("__end") - 1, F.lit(new_period))))
    line = (F.col(f"next_{value}") - F.col(value)) * (F.col("__t") - F.col(VS)) / gap + F.col(value)
    return points.withColumn(value, line).withColumns({VS: F.col("__t"), VE: F.col("__t") + new_period}).drop("__t", "__first", "__end", "next_vs", f"next_{value}")


def pairs(df: DataFrame, gap_tol: int, keys: Sequence[str] = (), value: str = "val") -> DataFrame:
    """Each sample with the next one if that is within the tolerance: valid until it."""
    return with_next(df, keys, value).filter(F.col("next_vs") - F.col(VS) <= gap_tol).withColumn(VE, F.col("next_vs")).drop("next_vs")


def clip_to_next(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each sample lives until the next; the last as before."""
    return with_next(df, keys).withColumn(VE, F.coalesce("next_vs", VE)).drop("next_vs")


def index(df: DataFrame, gap_tol: int, keys: Sequence[str] = ()) -> DataFrame:
    """Stretches of coverage without a gap beyond the tolerance."""
    w = over(keys, VS)
    new = F.coalesce(F.col(VS) - F.lag(VS).over(w) > gap_tol, F.lit(True)).cast("int")
    numbered = df.withColumn("__new", new).withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__i").agg(F.min(VS).alias(VS), F.max(VE).alias(VE)).drop("__i")


def alter_period(df: DataFrame, period: int, offset: int = 0) -> DataFrame:
    """Keep the samples on a coarser grid."""
    return df.filter(F.pmod(F.col(VS) - offset, F.lit(period)) == 0).withColumn(VE, F.col(VS) + period)


def chop_grid(df: DataFrame, period: int) -> DataFrame:
    """Repeat a row on every grid point of its lifetime."""
    return df.withColumn("__t", F.explode(F.sequence(F.col(VS), F.col(VE) - 1, F.lit(period)))).withColumns({VS: F.col("__t"), VE: F.col("__t") + period}).drop("__t")


def grid_aggregate(df: DataFrame, window: int, aggregates: dict[str, Column], keys: Sequence[str] = (), offset: int = 0) -> DataFrame:
    """Aggregates of [k * window, (k + 1) * window); empty windows give nothing."""
    start = F.col(VS) - F.pmod(F.col(VS) - offset, F.lit(window))
    out = df.withColumn("__w", start).groupBy(*keys, "__w").agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("__w").alias(VS), (F.col("__w") + window).alias(VE), *aggregates)


def grid_hopping(df: DataFrame, window: int, period: int, aggregates: dict[str, Column], keys: Sequence[str] = (), offset: int = 0) -> DataFrame:
    """At each hop that has samples of its own: aggregates of the trailing window that ends with the hop."""
    hop = F.col(VS) - F.pmod(F.col(VS) - offset, F.lit(period))
    spread = df.withColumn("__hop", hop).withColumn("__b", F.explode(F.sequence(F.col("__hop"), F.col("__hop") + (window - period), F.lit(period))))
    own = F.max((F.col("__b") == F.col("__hop")).cast("int")).alias("__own")
    out = spread.groupBy(*keys, "__b").agg(own, *[c.alias(n) for n, c in aggregates.items()]).filter("__own = 1")
    return out.select(*keys, F.col("__b").alias(VS), (F.col("__b") + period).alias(VE), *aggregates)


def grid_join(left: DataFrame, right: DataFrame, right_period: int, keys: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    """Samples of the left that fall into a slot of the coarser right signal, with its value: a plain equi-join on the slot."""
    slot = F.col(VS) - F.pmod(F.col(VS), F.lit(right_period))
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(VS).alias("__slot"), *[F.col(c).alias(f"{prefix}{c}") for c in right.columns if c not in (VS, VE, *keys)])
    cond = slot == F.col("__slot")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(r, cond).drop("__slot", *[f"__{k}" for k in keys])


def transform(df: DataFrame, window: int, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str] = ()) -> DataFrame:
    """A user's function over the samples of each window and key, in time order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return f(group.sort_values(VS, kind="stable").drop(columns="__w"))

    return df.withColumn("__w", F.floor(F.col(VS) / window)).groupBy(*keys, "__w").applyInPandas(run, schema)


def band_pass_taps(period: int, low: float, high: float, order: int = 150) -> np.ndarray:
    """Windowed-sinc (Hamming) taps for a period in milliseconds and corner frequencies in Hz."""
    rate = 1000 / period
    n = np.arange(order + 1) - order / 2
    top = min(high, 0.499 * rate)
    taps = 2 * top / rate * np.sinc(2 * top / rate * n) - 2 * low / rate * np.sinc(2 * low / rate * n)
    return taps * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(order + 1) / order))


def band_pass(df: DataFrame, period: int, low: float, high: float, keys: Sequence[str] = (), order: int = 150, value: str = "val") -> DataFrame:
    """Causal FIR over the samples of each key in their order: y(i) = sum of taps(j) * x(i - j), before the first sample 0.

    Samples are numbered and dealt to blocks of ``FILTER_BLOCK``, each with the
    ``order`` samples before it, so neither a hot key nor a signal without keys
    is one task, and a state crosses windows without a loop. A null counts as 0.
    """
    taps, names = band_pass_taps(period, low, high, order), df.columns
    numbered = ordinals(df, [VS], keys, "__n")
    block = F.floor(F.col("__n") / FILTER_BLOCK)
    ahead = F.pmod(F.col("__n"), F.lit(FILTER_BLOCK)) >= FILTER_BLOCK - order
    dealt = numbered.withColumn("__block", F.explode(F.when(ahead, F.array(block, block + 1)).otherwise(F.array(block)))).withColumn("__own", F.col("__block") == block)
    schema = StructType([f if f.name != value else StructField(value, DoubleType()) for f in df.schema.fields])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__n", kind="stable")
        x = group[value].to_numpy(np.float64, na_value=0.0)
        group[value] = np.convolve(np.nan_to_num(x), taps)[: len(x)]
        return group.loc[group["__own"], names]

    return dealt.groupBy(*keys, "__block").applyInPandas(run, schema)


def above_mean_runs(df: DataFrame, period: int, factor: str | Column | float, window: int, keys: Sequence[str], value: str = "val") -> DataFrame:
    """Samples above factor * mean of (t - window, t + window], with the number of their run of neighbours on the grid."""
    level = F.lit(factor) if isinstance(factor, (int, float)) else col(factor)
    w = over(keys, VS)
    high = df.withColumn("__mean", F.avg(value).over(w.rangeBetween(-window + 1, window))).filter(F.col(value) > level * F.col("__mean")).drop("__mean")
    new = F.coalesce(F.col(VS) - F.lag(VS).over(w) > period, F.lit(True)).cast("int")
    return high.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def peaks(df: DataFrame, period: int, factor: float, window: int = 400, keys: Sequence[str] = (), value: str = "val") -> DataFrame:
    """The greatest sample of each run above ``factor`` times the centred mean; the earliest of equals."""
    runs = above_mean_runs(df, period, factor, window, keys, value)
    best = runs.groupBy(*keys, "run").agg(F.min_by(F.struct(VS, VE, value), F.struct((-F.col(value)).alias("v"), F.col(VS))).alias("top"))
    return best.select(*keys, "top.*")


def peaks_rr(df: DataFrame, period: int, rr_window: int, mean_window: int = 400, bpm_min: float = 40, bpm_max: float = 180, keys: Sequence[str] = (), factors: Sequence[float] = FACTORS, value: str = "val", gap_tol: int | None = None) -> DataFrame:
    """Peaks under the factor whose intervals deviate least in each window (b - rr_window, b].

    For every factor, peaks and their intervals to the next peak (those of
    ``gap_tol`` at most, if it is given) are found; windows count with a sample
    deviation over 0.1 and a plausible rate. Of the factors the one with the
    least deviation is chosen (the last of equals), among windows that the first
    factor has. Peaks stay whose interval is near the window's mean, and the
    peak that ends the last interval; only those before b, as a sample at b lies
    in no common lifetime. The factors are a constant array: samples are
    repeated by them, not joined.
    """
    many = df.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    by = [*keys, "factor"]
    w = over(by, VS)
    rr = peaks_with(many, period, mean_window, by, value).withColumn("__to", F.lead(VS).over(w)).withColumn("rr", F.col("__to") - F.col(VS)).filter("rr is not null")
    if gap_tol is not None:
        rr = rr.filter(F.col("rr") <= gap_tol)
    rr = rr.withColumn("__b", F.col(VS) + F.pmod(-F.col(VS), F.lit(rr_window)))
    stats = rr.groupBy(*by, "__b").agg(F.stddev_samp("rr").alias("std"), F.avg("rr").alias("mean"), F.count(F.lit(1)).alias("n"))
    fit = stats.filter((F.col("std") > 0.1) & (F.col("n") * 60000.0 / rr_window).between(bpm_min, bpm_max))
    seeded = fit.groupBy(*keys, "__b").agg(F.min_by(F.struct("factor", "mean"), F.struct(F.col("std"), (-F.col("factor")).alias("later"))).alias("best"), F.min("factor").alias("first")).filter(F.col("first") == float(factors[0]))
    chosen = seeded.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__window"), F.col("best.factor").alias("__factor"), F.col("best.mean").alias("__mean"))
    cond = (F.col("__b") == F.col("__window")) & (F.col("factor") == F.col("__factor"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    picked = rr.join(chosen, cond).select(*keys, F.col(VS).alias("__at"), "__to", "rr", "__b", "__mean")
    near = F.abs(F.col("rr") - F.col("__mean")) < F.greatest(F.col("__mean") * 0.3, F.lit(300.0))
    kept = picked.filter(near).select(*keys, "__at", "__b").union(picked.groupBy(*keys, "__b").agg(F.max("__to").alias("__at")).select(*keys, "__at", "__b")).filter("__at < __b").distinct()
    names = kept.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.col(VS) == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(names, same).select(*keys, VS, F.least(F.col(VS) + period, F.col("__b")).alias(VE), value)


def peaks_with(df: DataFrame, period: int, window: int, by: Sequence[str], value: str) -> DataFrame:
    runs = above_mean_runs(df, period, "factor", window, by, value)
    return runs.groupBy(*by, "run").agg(F.min_by(F.struct(VS, VE, value), F.struct((-F.col(value)).alias("v"), F.col(VS))).alias("top")).select(*by, "top.*")


def end_to_end(slow: DataFrame, fast: DataFrame, slow_period: int, fast_period: int, window: int, gap_tol: int, keys: Sequence[str] = ()) -> DataFrame:
    """Fill and resample the slow signal to the fast one's rate, fill the fast one, normalise both, join."""
    s = normalize(resample(fill_mean(slow, window, slow_period, gap_tol, keys), slow_period, fast_period, gap_tol, keys), window, keys)
    f = normalize(fill_mean(fast, window, fast_period, gap_tol, keys), window, keys)
    return grid_join(f, s, fast_period, keys)
