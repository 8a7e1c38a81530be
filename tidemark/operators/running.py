"""Running and neighbour values in an order, without one task for the whole order.

A window over a long order without keys, or with a hot key, would put it all
into one task. Here the order is cut into buckets by value; each bucket is a
window of its own, and what passes from bucket to bucket (sums, last and first
values) is a small table with one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets that an order is cut into.
BUCKETS = 256


def cuts_of(df: DataFrame, order: str, buckets: int = BUCKETS) -> list:
    """Approximate quantiles of ``order``, sorted and distinct (they go to the driver)."""
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(order, shares, 10 * buckets).alias("cuts")).first()
    return sorted(set(row["cuts"] or ()))


def placed(value: Column, cuts: list) -> Column:
    """The number of cuts that are less than a value, by halving: no row meets them all."""

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(cuts[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    return place(0, len(cuts)).cast("long")


def bucketed(df: DataFrame, order: str, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``bucket``: cut at approximate quantiles of ``order``, so a burst is as many buckets as its rows need."""
    return df.withColumn("bucket", placed(F.col(order), cuts_of(df, order, buckets)))


def ordinals(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "number", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``name``: the number of each row from 0 by ``order`` within the keys.

    If the first of ``order`` is an integer, its range is cut into buckets that
    are numbered by themselves; else a key's rows are one task.
    """
    kind = dict(df.dtypes)[order[0]]
    if kind not in ("int", "bigint", "smallint", "tinyint"):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)) - 1)
    cut = bucketed(df, order[0], keys, buckets)
    by = [*keys, "bucket"]
    chain = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.orderBy("bucket")
    sizes = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    carry = sizes.select(*[F.col(k).alias(f"{k}__c") for k in by], F.coalesce(F.sum("__size").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return cut.withColumn("__inside", inside).join(carry, _same(by), "left").select(*df.columns, (F.col("__before") + F.col("__inside")).cast("long").alias(name))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], keys: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """``sums``: output name -> column, summed over all rows up to this one's value of ``order`` (distinct within the keys).

    Also adds ``next``: the following value of ``order``. An output replaces a column of its name.
    """
    df = bucketed(df, order, keys, buckets)
    by = [*keys, "bucket"]
    inside = Window.partitionBy(*by).orderBy(order)
    totals = df.groupBy(*by).agg(*[F.sum(c).alias(f"{n}__total") for n, c in sums.items()], F.min(order).alias("first__order"))
    chain = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.orderBy("bucket")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, *[F.coalesce(F.sum(f"{n}__total").over(before), F.lit(0)).alias(f"{n}__carry") for n in sums], F.lead("first__order").over(chain).alias("next__order"))
    out = df.withColumns({f"{n}__in": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()} | {"next__in": F.lead(order).over(inside)})
    joined = out.join(carry.withColumnsRenamed({k: f"{k}__c" for k in by}), _same(by), "left")
    final: dict[str, Column] = {n: F.col(f"{n}__in") + F.col(f"{n}__carry") for n in sums}
    return joined.select(*df.drop("bucket", *sums).columns, *[v.alias(n) for n, v in final.items()], F.coalesce("next__in", "next__order").alias("next"))


def _same(names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in names:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}__c"))
    return cond


def neighbours(df: DataFrame, order: str, value: Sequence[str], keys: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Adds ``next_<column>`` and ``prev_<column>`` for each of ``value``, by ``order`` within the keys (ties by the values themselves)."""
    df = bucketed(df, order, keys, buckets)
    by = [*keys, "bucket"]
    sort = [order, *[c for c in value if c != order]]
    inside = Window.partitionBy(*by).orderBy(*sort)
    edge = F.struct(*sort)
    ends = df.groupBy(*by).agg(F.min(edge).alias("first__row"), F.max(edge).alias("last__row"))
    chain = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.orderBy("bucket")
    carry = ends.select(*by, F.lead("first__row").over(chain).alias("after__row"), F.lag("last__row").over(chain).alias("before__row")).withColumnsRenamed({k: f"{k}__c" for k in by})
    out = df.withColumns({"next__row": F.lead(edge).over(inside), "prev__row": F.lag(edge).over(inside)}).join(carry, _same(by), "left")
    after, before = F.coalesce("next__row", "after__row"), F.coalesce("prev__row", "before__row")
    return out.select(*df.drop("bucket").columns, *[after[c].alias(f"next_{c}") for c in value], *[before[c].alias(f"prev_{c}") for c in value])
