"""Joins over time: rows meet while both are alive."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.frame import INF, VE, VS, over, valid

#: A side is broadcast only if the optimiser's own estimate is below its threshold; nothing here forces it.


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keys})


def key_match(keys: Sequence[str], right: str = "__r_") -> Column:
    """Null keys match null keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{right}{k}"))
    return cond


#: Buckets of time that a lifetime spans at most, and those that lifetimes which would span more are dealt to.
SPAN, COARSE = 512, 128


@dataclass(frozen=True)
class Grid:
    """Widths of the buckets of time that an interval join deals rows to: ``fine`` for short lifetimes, ``coarse`` for those that span more than SPAN of these."""

    fine: int
    coarse: int
    last: int
    has_long: bool
    left_short: bool
    all_open: bool
    sizes: tuple[int, int]


def grid_of(left: DataFrame, right: DataFrame, share: float = 2) -> Grid:
    """From one pass over both sides (a row to the driver): the mean closed lifetime times ``share``, and the range of time in COARSE buckets."""
    both = left.select(VS, VE, F.lit(True).alias("__left")).union(right.select(VS, VE, F.lit(False)))
    closed = F.col(VE) != INF
    row = both.agg(
        F.avg(F.when(closed, F.col(VE) - F.col(VS))).alias("mean"), F.max(F.when(closed, F.col(VE) - F.col(VS))).alias("most"), F.min(VS).alias("low"),
        F.max(F.greatest(F.col(VS), F.when(closed, F.col(VE)).otherwise(F.col(VS)))).alias("top"), F.bool_or(~closed).alias("open"),
        F.min(F.when(closed & F.col("__left"), F.col(VE) - F.col(VS))).alias("least"), F.count_if("__left").alias("n"), F.count("*").alias("all"),
    ).first()
    low, top = row["low"] or 0, row["top"] or 0
    coarse = max(1, (top - low) // COARSE + 1)
    fine = min(coarse, max(1, int(share * row["mean"]))) if row["mean"] else coarse
    return Grid(fine, coarse, top, bool(row["open"]) or (row["most"] or 0) > SPAN * fine, row["least"] is not None and row["least"] <= SPAN * fine, bool(row["open"]) and row["mean"] is None, (row["n"], row["all"] - row["n"]))


def spanned(df: DataFrame, width: int, last: int) -> DataFrame:
    """A row for each bucket of time that a lifetime touches; an open end goes to ``last``."""
    end = F.when(F.col(VE) == INF, F.lit(last)).otherwise(F.col(VE) - 1)
    return df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(VS) / width), F.floor(F.greatest(end, F.col(VS)) / width))))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, last: int) -> DataFrame:
    """Pairs of rows that are alive together; a pair counts in the bucket where its common lifetime starts, once."""
    rb = prefixed(spanned(right, width, last), "__r_", ()).withColumnsRenamed({f"__r_{VS}": "__rvs", f"__r_{VE}": "__rve"})
    overlap = (F.col(VS) < F.col("__rve")) & (F.col("__rvs") < F.col(VE))
    here = F.col("__bucket") == F.floor(F.greatest(F.col(VS), F.col("__rvs")) / width)
    return spanned(left, width, last).join(rb, (F.col("__bucket") == F.col("__r___bucket")) & key_match(keys) & overlap & here).drop("__bucket", "__r___bucket")


def starting(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, last: int) -> DataFrame:
    """The same pairs; the row that starts later goes to the bucket of its start alone, so hardly a pair that doesn't overlap is looked at."""
    r = prefixed(right, "__r_", ()).withColumnsRenamed({f"__r_{VS}": "__rvs", f"__r_{VE}": "__rve"})
    rb = prefixed(spanned(right, width, last), "__r_", ()).withColumnsRenamed({f"__r_{VS}": "__rvs", f"__r_{VE}": "__rve"})
    overlap = (F.col(VS) < F.col("__rve")) & (F.col("__rvs") < F.col(VE)) & (F.col("__bucket") == F.col("__r___bucket")) & key_match(keys)
    first = left.withColumn("__bucket", F.floor(F.col(VS) / width)).join(rb, overlap & (F.col(VS) >= F.col("__rvs")))
    second = spanned(left, width, last).join(r.withColumn("__r___bucket", F.floor(F.col("__rvs") / width)), overlap & (F.col(VS) < F.col("__rvs")))
    return first.unionByName(second).drop("__bucket", "__r___bucket")


#: Cells that pairs of open rows are dealt to, as far as a cell's side keeps within SIDE rows; tasks have four cells.
CELLS, SIDE, CELL_TASKS = 512, (500, 8192), 10_000


def crossed(left: DataFrame, right: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """All pairs of open rows, which need no time: both sides are cut into parts, and each two parts meet in a cell of their own, so tasks are even."""
    side = min(max(math.isqrt(sizes[0] * sizes[1] // CELLS), SIDE[0]), SIDE[1])
    a, b = (max(1, -(-n // side)) for n in sizes)
    tasks = min(-(-a * b // 4), CELL_TASKS)
    alive = (F.col(VE) == INF) & F.coalesce(F.col(VS) < INF, F.lit(True))
    hashed = lambda df: [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    part = lambda df, n: F.pmod(F.xxhash64(*hashed(df)), F.lit(n))
    ld = left.filter(alive).withColumn("__cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda j: part(left, a) * b + j)))
    rd = right.filter(alive).withColumn("__cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(a - 1)), lambda i: i * b + part(right, b))))
    rd = prefixed(rd.repartition(tasks, "__cell"), "__r_", ()).withColumnsRenamed({f"__r_{VS}": "__rvs", f"__r_{VE}": "__rve"})
    return ld.repartition(tasks, "__cell").join(rd, F.col("__cell") == F.col("__r___cell")).drop("__cell", "__r___cell")


def join(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), condition: Column | None = None, prefix: str = "r_", width: int | None = None) -> DataFrame:
    """Pairs of equal keys, valid while both are; right payload columns get ``prefix``. ``condition`` may use both sides.

    Both sides are dealt to buckets of time within the keys, so a hot key is
    many tasks and gives few pairs that don't overlap. Lifetimes that are open,
    or far longer than the mean, are dealt to wider buckets of their own, so
    no row spans more than ``SPAN`` of them. Without keys, pairs are far more
    than rows: buckets are narrower, and rows meet where the later one starts;
    if all rows are open, all pairs count and none is looked for by time.
    """
    grid = grid_of(left, right, 2 if keys else 0.25)
    meet = overlapping if keys else starting
    fine = width or grid.fine
    if grid.all_open and not keys:
        pairs = crossed(left, right, grid.sizes)
    elif not grid.has_long:
        pairs = meet(left, right, keys, fine, grid.last)
    else:
        is_long = (F.col(VE) == INF) | (F.col(VE) - F.col(VS) > SPAN * fine)
        pairs = starting(left.filter(is_long), right, keys, grid.coarse, grid.last)
        if width or grid.left_short:
            short = meet(left.filter(~is_long), right.filter(~is_long), keys, fine, grid.last)
            pairs = short.unionByName(pairs).unionByName(starting(left.filter(~is_long), right.filter(is_long), keys, grid.coarse, grid.last))
    payload = [c for c in right.columns if c not in (VS, VE) and c not in keys]
    out = pairs.select(
        *[c for c in left.columns if c not in (VS, VE)], F.greatest(F.col(VS), F.col("__rvs")).alias(VS), F.least(F.col(VE), F.col("__rve")).alias(VE), *[F.col(f"__r_{c}").alias(f"{prefix}{c}") for c in payload]
    )
    return out.filter(condition) if condition is not None else out


def fixed_interval_join(left: DataFrame, right: DataFrame, left_duration: int, right_duration: int, keys: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    """The join of relations whose rows all live equally long: starts less than a duration apart, so each row touches two buckets at most and no statistics are read."""
    width = max(left_duration, right_duration)
    pairs = overlapping(left, right, keys, width, 0)
    payload = [c for c in right.columns if c not in (VS, VE) and c not in keys]
    return pairs.select(
        *[c for c in left.columns if c not in (VS, VE)], F.greatest(F.col(VS), F.col("__rvs")).alias(VS), F.least(F.col(VE), F.col("__rve")).alias(VE), *[F.col(f"__r_{c}").alias(f"{prefix}{c}") for c in payload]
    )


def hinted_join(left: DataFrame, right: DataFrame, hint: str, keys: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    """The join with a promise about its sides: ``increasing`` (both sorted: merged, not hashed), ``start_edges`` (no row ends), ``none``."""
    match hint:
        case "none":
            return join(left, right, keys, None, prefix)
        case "increasing":
            return join(left, right.hint("merge"), keys, None, prefix)
        case "start_edges":
            return start_edge_join(left, right, keys, prefix)
    raise ValueError(f"no hint {hint!r}")


def cover(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal stretches in which any row of the keys is alive."""
    w = over(keys, VS, VE)
    before = F.max(VE).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.select(*keys, VS, VE).withColumn("__new", F.coalesce(F.col(VS) > before, F.lit(True)).cast("int"))
    numbered = islands.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__i").agg(F.min(VS).alias(VS), F.max(VE).alias(VE)).drop("__i")


def greatest(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The greatest ``value`` alive at every instant, as maximal stretches of keys, vs, ve and ``__most``."""
    from tidemark.operators.lifetime import stitch
    from tidemark.operators.ranked import snapshot_ranked

    most = snapshot_ranked(df.filter(F.col(value).isNotNull()), value, {"__most": ("discrete", 1.0)}, keys)
    return stitch(most).select(*keys, VS, VE, "__most")


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), condition: Column | None = None, prefix: str = "r_", less: tuple[str, str] | None = None) -> DataFrame:
    """Left rows for the times at which no right row of equal keys (that meets ``condition``) is alive; a row may come in pieces.

    The right side is reduced to its cover, whose stretches don't touch; a left
    row meets those that it overlaps. Each stretch leaves the gap up to the next
    one, which a window over the row's own stretches finds; no list is gathered.
    With a condition the cover is that of each left row's own matches. The
    condition ``less``, that a left column is less than a right one, holds for
    some right row if it holds for the greatest, so only that of each instant is met.
    """
    only = None
    payload = [c for c in left.columns if c not in (VS, VE)]
    counted = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("__times"))
    if less:
        stretches, only = greatest(right, less[1], keys), F.col(less[0]) < F.col("__x__most")
        by = list(keys)
    elif condition is None:
        stretches = cover(right, keys)
        by = list(keys)
    else:
        matched = join(left.distinct(), right, keys, condition, prefix).select(*payload, VS, VE)
        by = payload
        stretches = cover(matched, by)
    met = join(counted.withColumns({"__from": F.col(VS), "__until": F.col(VE)}), stretches.withColumns({"__cs": F.col(VS), "__ce": F.col(VE)}), by, only, prefix="__x")
    own = [*payload, "__from", "__until", "__times"]
    hits = met.select(*own, F.col("__x__cs").alias("__cs"), F.col("__x__ce").alias("__ce"))
    # A stretch before all others stands for the start of the row.
    starts = counted.select(*payload, F.col(VS).alias("__from"), F.col(VE).alias("__until"), "__times", F.lit(None).cast("long").alias("__cs"), F.col(VS).alias("__ce"))
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in own]).orderBy(F.col("__cs").asc_nulls_first())
    gaps = hits.unionByName(starts).withColumn("__next", F.lead("__cs").over(w))
    start, end = F.greatest(F.col("__from"), F.col("__ce")), F.least(F.col("__until"), F.coalesce("__next", F.lit(INF)))
    pieces = gaps.select(*payload, start.alias(VS), end.alias(VE), "__times").filter(F.col(VS) < F.col(VE))
    return pieces.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*left.columns)


def left_outer_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), condition: Column | None = None, prefix: str = "r_", less: tuple[str, str] | None = None) -> DataFrame:
    """Pairs, and left rows alone for the times without a partner; ``less`` names a left and a right column, the first less than the second."""
    if less:
        pairs = join(left, right, keys, F.col(less[0]) < F.col(f"{prefix}{less[1]}"), prefix)
        return pairs.unionByName(anti_join(left, right, keys, less=less), allowMissingColumns=True)
    return join(left, right, keys, condition, prefix).unionByName(anti_join(left, right, keys, condition, prefix), allowMissingColumns=True)


def full_outer_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    alone = anti_join(right, left, keys)
    alone = alone.withColumnsRenamed({c: f"{prefix}{c}" for c in right.columns if c not in (VS, VE) and c not in keys})
    return left_outer_join(left, right, keys, None, prefix).unionByName(alone, allowMissingColumns=True)


def semi_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Left rows for the times at which some right row of equal keys is alive."""
    return join(left, cover(right, keys), keys).select(*left.columns)


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    """Each left row with the latest right row that starts no later than it; null if there is none. One shuffle by key, no pairs."""
    payload = [c for c in right.columns if c not in (VS, VE) and c not in keys]
    r = right.select(*keys, F.col(VS).alias("__t"), F.struct(*payload, F.col(VS).alias("__from")).alias("__row"), F.lit(0).alias("__side"))
    l = left.select("*", F.col(VS).alias("__t"), F.lit(1).alias("__side"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    w = over(keys, "__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__got", F.last("__row", ignorenulls=True).over(w)).filter("__side = 1")
    return found.select(*left.columns, *[F.col(f"__got.{c}").alias(f"{prefix}{c}") for c in payload], F.col("__got.__from").alias(f"{prefix}{VS}"))


def start_edge_join(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "r_") -> DataFrame:
    """Join of relations whose rows never end: an equi-join, valid from the later start."""
    r = prefixed(right, "__r_", ())
    pairs = left.join(r, key_match(keys))
    payload = [c for c in right.columns if c not in (VS, VE) and c not in keys]
    return pairs.select(*[c for c in left.columns if c not in (VS, VE)], F.greatest(F.col(VS), F.col(f"__r_{VS}")).alias(VS), F.lit(INF).alias(VE), *[F.col(f"__r_{c}").alias(f"{prefix}{c}") for c in payload])


def sessionize(df: DataFrame, is_start: Column, is_end: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Each start event lives until the next end event of its keys; without one its end stays open."""
    w = over(keys, VS).rangeBetween(1, Window.unboundedFollowing)
    ended = df.withColumns({"__end": F.min(F.when(is_end, F.col(VS))).over(w), "__start": is_start})
    return valid(ended.filter("__start").withColumn(VE, F.coalesce("__end", F.lit(INF))).drop("__end", "__start"))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both."""
    return left.unionByName(right)


def multi_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o)
    return first


def distinct(df: DataFrame, selector: dict[str, Column] | None = None) -> DataFrame:
    """Each payload once at every instant; lifetimes are split where its multiplicity changes."""
    from tidemark.operators.aggregate import snapshot_sums

    if selector:
        df = df.select(VS, VE, *[c.alias(n) for n, c in selector.items()])
    payload = [c for c in df.columns if c not in (VS, VE)]
    return snapshot_sums(df, {}, payload).drop("count").select(*df.columns)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Payloads alive on both sides."""
    payload = [c for c in left.columns if c not in (VS, VE)]
    return join(cover(left, payload), cover(right, payload), payload).select(*left.columns)


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    """Payloads alive on the left but not on the right."""
    payload = [c for c in left.columns if c not in (VS, VE)]
    return anti_join(left, right, payload)

