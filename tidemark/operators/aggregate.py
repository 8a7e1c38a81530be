"""Aggregates at every instant, over windows, and by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.frame import INF, VE, VS, col
from tidemark.operators.lifetime import snap_up
from tidemark.operators.running import running_sums

#: Ends of all intervals may be open: they change nothing at INF.


def snapshot_sums(df: DataFrame, sums: dict[str, str | Column], keys: Sequence[str] = (), keep: bool = False) -> DataFrame:
    """``count`` and sums at every instant, as maximal stretches between changes; empty ones have no row.

    A sweep: values come at vs and go at ve, so each change is a difference
    and the state a running sum. Equal times are added up first, and the order
    is cut into buckets, so neither a long timeline nor a hot key is one task.

    Nulls count for nothing: a sum is null where no value is alive. Sums of
    floating-point columns, which differences would leave inexact, are added up
    anew for each stretch from O(log n) partial sums (see ``snapshot_partials``).
    """
    values = {n: col(c) for n, c in sums.items()}
    types = df.select(*[c.alias(n) for n, c in values.items()]).dtypes if values else []
    inexact = [n for n, t in types if t in ("double", "float")]
    if inexact:
        exact = snapshot_sums(df, {n: c for n, c in sums.items() if n not in inexact}, keys, keep)
        again = snapshot_partials(df, {n: ("sum", sums[n]) for n in inexact}, keys).drop(VE)
        again = again.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(VS).alias("__at"), *inexact)
        return exact.join(again, _equal(keys) & (F.col(VS) == F.col("__at")), "left").select(*keys, VS, VE, "count", *sums)
    there = {f"{n}__there": F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for n, c in values.items()}
    rows = df.select(*keys, VS, VE, F.lit(1).alias("count"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in values.items()], *[c.alias(n) for n, c in there.items()])
    moving = ["count", *values, *there]
    come = rows.select(*keys, F.col(VS).alias("t"), *moving)
    go = rows.filter(F.col(VE) != INF).select(*keys, F.col(VE).alias("t"), *[(-F.col(n)).alias(n) for n in moving])
    changes = come.unionByName(go).groupBy(*keys, "t").agg(*[F.sum(n).alias(n) for n in moving])
    swept = running_sums(changes, "t", {n: n for n in moving}, keys)
    out = swept.select(*keys, F.col("t").alias(VS), F.coalesce("next", F.lit(INF)).alias(VE), "count", *[F.when(F.col(f"{n}__there") > 0, F.col(n)).alias(n) for n in values])
    return out if keep else out.filter("count > 0")


def _equal(keys: Sequence[str]) -> Column:
    """Null keys match null keys; the other side's have two underscores before them."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return cond


def numbered_stretches(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns ``__<key>``, ``__t``, ``__n``, ``next``: the number of the stretch that starts at each start or end."""
    times = df.select(*keys, F.col(VS).alias("t")).union(df.filter(F.col(VE) != INF).select(*keys, F.col(VE).alias("t"))).distinct().withColumn("one", F.lit(1))
    numbered = running_sums(times, "t", {"number": "one"}, keys)
    return numbered.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("t").alias("__t"), F.col("number").cast("long").alias("__n"), "next")


def placed_rows(df: DataFrame, stretches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the numbers of the first and last stretch that they are alive in: ``__from`` and ``__to``."""

    def number_of(time: str, out: str, frame: DataFrame) -> DataFrame:
        names = stretches.select(*[f"__{k}" for k in keys], "__t", F.col("__n").alias(out))
        return frame.join(names, _equal(keys) & (F.col(time) == F.col("__t")), "left").drop("__t", *[f"__{k}" for k in keys])

    placed = number_of(VE, "__end", number_of(VS, "__from", df))
    last = stretches.groupBy(*[f"__{k}" for k in keys]).agg(F.max("__n").alias("__last"))
    if keys:
        placed = placed.join(last, _equal(keys), "left").drop(*[f"__{k}" for k in keys])
    else:
        placed = placed.join(F.broadcast(last))  # one row
    return placed.withColumn("__to", F.coalesce(F.col("__end") - 1, "__last")).drop("__end", "__last")


#: How partial results of a kind are added up, and those whose rows are simply counted.
KINDS = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}


def snapshot_partials(df: DataFrame, aggregates: dict[str, tuple[str, str | Column]], keys: Sequence[str] = ()) -> DataFrame:
    """Least, greatest, sums or counts (name -> kind, column) at every instant, from O(log n) rows for each row and stretch.

    The stretches a row covers are cut into nodes of a binary tree over their
    numbers; rows are reduced by node, and a stretch adds up the nodes above it.
    """
    stretches = numbered_stretches(df, keys)
    rows = df.select(*keys, VS, VE, *[col(c).alias(n) for n, (_, c) in aggregates.items()])
    placed = placed_rows(rows, stretches, keys)

    def nodes(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.floor((F.col("__from") + size - 1) / size), F.floor((F.col("__to") + 1) / size)
        inside = low < high
        left = F.when(inside & (low % 2 == 1), F.struct(level.alias("level"), low.alias("node")))
        right = F.when(inside & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("node")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("__to") - F.col("__from") + 2)).cast("int"))
    covered = F.filter(F.flatten(F.transform(levels, nodes)), lambda n: n.isNotNull())
    dealt = placed.withColumn("__node", F.explode(covered))
    first = {n: F.count(n) if kind == "count" else KINDS[kind](n) for n, (kind, _) in aggregates.items()}
    partial = dealt.groupBy(*keys, F.col("__node.level").alias("level"), F.col("__node.node").alias("node")).agg(*[c.alias(n) for n, c in first.items()])
    top = stretches.agg(F.max("__n")).first()[0] or 0
    above = F.transform(F.sequence(F.lit(0), F.lit(int(top).bit_length())), lambda k: F.struct(k.alias("l"), F.call_function("shiftright", F.col("__n"), k).alias("m")))
    wanted = stretches.withColumn("__above", F.explode(above))
    met = wanted.join(partial, _equal(keys) & (F.col("__above.l") == F.col("level")) & (F.col("__above.m") == F.col("node")))
    out = met.groupBy(*[f"__{k}" for k in keys], "__t", "next").agg(*[KINDS[kind](n).alias(n) for n, (kind, _) in aggregates.items()])
    return out.select(*[F.col(f"__{k}").alias(k) for k in keys], F.col("__t").alias(VS), F.coalesce("next", F.lit(INF)).alias(VE), *aggregates)


def snapshot(df: DataFrame, aggregates: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Any aggregates at every instant: rows meet the stretches that they are alive in.

    A row is dealt to the stretches it covers by their numbers, which are
    equi-joined: no range join. The output of this join is the sum of all
    stretches' sizes, which holistic aggregates (percentiles, lists) read by
    definition; use ``snapshot_sums`` and ``snapshot_partials`` for the others.
    """
    stretches = numbered_stretches(df, keys)
    each = placed_rows(df, stretches, keys).withColumn("__number", F.explode(F.sequence("__from", "__to")))
    found = each.drop(VS, VE, "__from", "__to").groupBy(*keys, "__number").agg(*[c.alias(n) for n, c in aggregates.items()])
    return found.join(stretches, _equal(keys) & (F.col("__number") == F.col("__n"))).select(*keys, F.col("__t").alias(VS), F.coalesce("next", F.lit(INF)).alias(VE), *aggregates)


def snapshot_start_edges(df: DataFrame, aggregates: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates at every instant of rows that never end: those of all rows so far, valid until the next start."""
    stretch = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(VS)
    upto = stretch.rangeBetween(Window.unboundedPreceding, 0)
    ahead = df.select(*keys, VS).distinct().withColumn("__next", F.lead(VS).over(stretch)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(VS).alias("__at"), "__next")
    out = df.withColumns({f"__{n}": c.over(upto) for n, c in aggregates.items()}).select(*keys, VS, *[F.col(f"__{n}").alias(n) for n in aggregates]).distinct()
    return out.join(ahead, _equal(keys) & (F.col(VS) == F.col("__at"))).select(*keys, VS, F.coalesce("__next", F.lit(INF)).alias(VE), *aggregates)


def binary_aggregate(left: DataFrame, right: DataFrame, sums: dict[str, str | Column], right_sums: dict[str, str | Column], keys: Sequence[str] = ()) -> DataFrame:
    """Counts and sums of two relations at every instant of either; ``left_count`` and ``right_count`` beside the sums."""
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    l = left.select(*keys, VS, VE, one.alias("left_count"), none.alias("right_count"), *[col(c).alias(n) for n, c in sums.items()])  # noqa: E741
    r = right.select(*keys, VS, VE, none.alias("left_count"), one.alias("right_count"), *[col(c).alias(n) for n, c in right_sums.items()])
    names = ["left_count", "right_count", *sums, *right_sums]
    out = snapshot_sums(l.unionByName(r, allowMissingColumns=True), {n: n for n in names}, keys)
    return out.drop("count").fillna(0, ["left_count", "right_count"])


def tumbling_aggregate(df: DataFrame, size: int, aggregates: dict[str, Column], keys: Sequence[str] = (), offset: int = 0) -> DataFrame:
    """Aggregates of the starts in (b - size, b], valid [b, b + size)."""
    bucket = snap_up(F.col(VS), size, offset)
    out = df.withColumn("__b", bucket).groupBy(*keys, "__b").agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("__b").alias(VS), (F.col("__b") + size).alias(VE), *aggregates)


def hopping_aggregate(df: DataFrame, size: int, period: int, aggregates: dict[str, Column], keys: Sequence[str] = (), offset: int = 0) -> DataFrame:
    """Aggregates at each hop of the starts in (b - size, b]; each row goes to the size / period hops that see it."""
    first = snap_up(F.col(VS), period, offset)
    hops = df.withColumn("__b", F.explode(F.sequence(first, F.col(VS) + (size - 1), F.lit(period))) if size >= period else first)
    if size < period:
        hops = hops.filter(F.col("__b") - F.col(VS) < size)
    out = hops.groupBy(*keys, "__b").agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("__b").alias(VS), (F.col("__b") + period).alias(VE), *aggregates)


def group_aggregate(df: DataFrame, by: Sequence[str | Column], aggregates: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates of equal lifetimes and group keys: after a window operator this is the windowed group aggregate."""
    return df.groupBy(*keys, *by, VS, VE).agg(*[c.alias(n) for n, c in aggregates.items()])


def group_apply(df: DataFrame, by: Sequence[str], query, merge: dict[str, Column] | None = None) -> DataFrame:
    """Run a sub-query with the group's columns as its keys, then derive merged columns."""
    out = query(df, tuple(by))
    return out.withColumns(merge) if merge else out


def top_k_rows(df: DataFrame, order: str | Column, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of rank k or better (ties share a rank, all stay) among those of equal keys and lifetime, with their rank."""
    w = Window.partitionBy(*[F.col(x) for x in (*keys, VS, VE)]).orderBy(col(order).desc())
    return df.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= k)


def attach_aggregate(df: DataFrame, size: int, aggregates: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Each event with the aggregates of its own tumbling window [k * size, (k + 1) * size)."""
    w = Window.partitionBy(*[F.col(k) for k in keys], F.floor(F.col(VS) / size))
    return df.withColumns({n: c.over(w) for n, c in aggregates.items()})
