"""Operators on ordered sequences: the order is a column (or several) that has no ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.frame import over
from tidemark.operators.running import ordinals


def scan(df: DataFrame, aggregates: dict[str, Column], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Running aggregates up to each row."""
    w = over(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: c.over(w) for n, c in aggregates.items()})


def distinct_until_changed(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose value differs from that of the row before; the first of each key stays."""
    w = over(keys, *order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("__new", changed).filter("__new").drop("__new")


def buffer(df: DataFrame, value: str, size: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Lists of ``size`` values in order; the last may be shorter."""
    numbered = _numbered(df, order, keys).withColumn("__i", F.col("__n") - 1).drop("__n")
    item = F.struct("__i", F.col(value).alias("v"))
    out = numbered.groupBy(*keys, F.floor(F.col("__i") / size).alias("buffer")).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    return out.withColumn("items", F.transform("__items", lambda s: s["v"])).drop("__items")


def pairwise(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each value but the first with the one before it."""
    w = over(keys, *order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).filter("__n > 1").drop("__n")


def take(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows. Without keys Spark keeps the ``n`` best of each task and sorts those."""
    if not keys:
        return df.orderBy(*order).limit(n)
    return _numbered(df, order, keys).filter(F.col("__n") <= n).drop("__n")


def skip(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return _numbered(df, order, keys).filter(F.col("__n") > n).drop("__n")


def take_while(df: DataFrame, condition: Column, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows before the first that fails."""
    failed = F.max((~F.coalesce(condition, F.lit(False))).cast("int")).over(over(keys, *order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__f", failed).filter("__f = 0").drop("__f")


def skip_while(df: DataFrame, condition: Column, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The first row that fails, and all after it."""
    failed = F.max((~F.coalesce(condition, F.lit(False))).cast("int")).over(over(keys, *order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__f", failed).filter("__f = 1").drop("__f")


def zip_(left: DataFrame, right: DataFrame, order: Sequence[str], keys: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    """The n-th row of one with the n-th of the other, within the keys."""
    a, b = _numbered(left, order, keys), _numbered(right, order, keys)
    b = b.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__n").alias("__m"), *[F.col(c).alias(f"{prefix}{c}") for c in right.columns if c not in keys])
    cond = F.col("__n") == F.col("__m")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return a.join(b, cond).drop("__n", "__m", *[f"__k_{k}" for k in keys])


def throttle(df: DataFrame, quiet: int, time: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows that no other row follows within ``quiet``."""
    after = F.lead(time).over(over(keys, time, *order))
    return df.withColumn("__next", after).filter(F.col("__next").isNull() | (F.col("__next") - F.col(time) > quiet)).drop("__next")


def combine_latest(left: DataFrame, right: DataFrame, time: str, value: str, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """At each row of either side, the latest value of both; rows before both have one are left out. Ties by ``order``, then left first."""
    both = left.withColumns({"__l": F.col(value), "__side": F.lit(0)}).unionByName(right.withColumns({"__r": F.col(value), "__side": F.lit(1)}), allowMissingColumns=True)
    w = over(keys, time, *order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    latest = both.withColumns({"left_value": F.last("__l", ignorenulls=True).over(w), "right_value": F.last("__r", ignorenulls=True).over(w)})
    return latest.filter("left_value is not null and right_value is not null").drop("__l", "__r", "__side")


def _numbered(df: DataFrame, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Adds ``__n`` from 1; a sequence without keys is numbered in buckets of its order."""
    if not keys:
        return ordinals(df, order, (), "__n").withColumn("__n", F.col("__n") + 1)
    return df.withColumn("__n", F.row_number().over(over(keys, *order)))


def _backwards(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def take_last(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    if not keys:
        return df.orderBy(*_backwards(order)).limit(n)
    return df.withColumn("__n", F.row_number().over(over(keys, *_backwards(order)))).filter(F.col("__n") <= n).drop("__n")


def skip_last(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    if not keys:
        return _numbered(df, order, ()).filter(F.col("__n") <= df.count() - n).drop("__n")
    return df.withColumn("__n", F.row_number().over(over(keys, *_backwards(order)))).filter(F.col("__n") > n).drop("__n")


def element_at(df: DataFrame, i: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The row number ``i``, from 0; none if the sequence is shorter."""
    return _numbered(df, order, keys).filter(F.col("__n") == i + 1).drop("__n")


def first(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """First row of each key, without sorting: the least struct."""
    return _extreme(df, F.min, order, keys)


def last(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return _extreme(df, F.max, order, keys)


def _extreme(df: DataFrame, pick, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))
    best = df.groupBy(*keys).agg(pick(row).alias("__best")).filter("__best is not null")
    return best.select(*keys, "__best.row.*").select(*df.columns)


def single(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The only row of each key; a key with more is an error."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(F.struct(*rest)).alias("__row")).filter("__n > 0")
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit(0)).cast("int")
    return one.withColumn("__check", checked).filter("__check = 0").select(*keys, "__row.*").select(*df.columns)


def all_(df: DataFrame, condition: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``all``: no row fails; true without rows."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True)).alias("all"))


def any_(df: DataFrame, condition: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``any``: a row holds (or there is one); false without rows."""
    holds = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(holds), F.lit(False)).alias("any"))


def contains(df: DataFrame, column: str, value, keys: Sequence[str] = ()) -> DataFrame:
    return any_(df, F.col(column).eqNullSafe(F.lit(value)), keys).withColumnRenamed("any", "contains")


def is_empty(df: DataFrame) -> DataFrame:
    return any_(df).select((~F.col("any")).alias("is_empty"))


def count(df: DataFrame, condition: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.lit(True) if condition is None else condition).alias("count"))


def min_by(df: DataFrame, by: str, keys: Sequence[str] = ()) -> DataFrame:
    """All rows that have the least ``by`` of their key."""
    return _all_extreme(df, F.min(by), by, keys)


def max_by(df: DataFrame, by: str, keys: Sequence[str] = ()) -> DataFrame:
    return _all_extreme(df, F.max(by), by, keys)


def _all_extreme(df: DataFrame, best: Column, by: str, keys: Sequence[str]) -> DataFrame:
    bests = df.groupBy(*keys).agg(best.alias("__best")).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__best")
    cond = F.col(by) == F.col("__best")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(bests, cond, "left_semi")


def distinct_by(df: DataFrame, by: Sequence[str], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The first row of each value of ``by``."""
    return first(df, order, [*keys, *by])


def default_if_empty(df: DataFrame, **values) -> DataFrame:
    """The rows, or one row of ``values`` (null where not given) if there are none."""
    spark = df.sparkSession
    one = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    some = df.limit(1).select(F.lit(1).alias("__some"))
    return df.union(one.join(some, F.lit(True), "left_anti"))


def concat(df: DataFrame, *others: DataFrame, part: str = "part") -> DataFrame:
    """One sequence after the other; ``part`` goes before the order of the rows."""
    out = df.withColumn(part, F.lit(0))
    for i, o in enumerate(others, 1):
        out = out.unionByName(o.withColumn(part, F.lit(i)))
    return out


def append(df: DataFrame, part: str = "part", **values) -> DataFrame:
    one = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return concat(df, one, part=part)


def prepend(df: DataFrame, part: str = "part", **values) -> DataFrame:
    return append(df, part, **values).withColumn(part, -F.col(part))


def repeat(df: DataFrame, n: int, part: str = "part") -> DataFrame:
    """The sequence ``n`` times."""
    return df.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn(part, F.lit(0)).filter("false")


def reverse(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn(order, -F.col(order))


def sequence_equal(left: DataFrame, right: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """``equal``: both have the same values in the same order."""
    a, b = (_numbered(d, order, ()).select("__n", F.struct(F.col(value).alias("v")).alias(n)) for d, n in ((left, "a"), (right, "b")))
    return a.join(b, "__n", "full").agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("equal"))


def sliding_buffer(df: DataFrame, value: str, size: int, step: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Lists of ``size`` values that start every ``step`` rows; those at the end are shorter."""
    w = over(keys, *order).rowsBetween(0, size - 1)
    item = F.struct(F.col(value).alias("v"))
    out = _numbered(df, order, keys).withColumn("__items", F.collect_list(item).over(w)).filter((F.col("__n") - 1) % step == 0)
    return out.select(*keys, F.floor((F.col("__n") - 1) / step).alias("buffer"), F.transform("__items", lambda s: s["v"]).alias("items"))


def time_buffer(df: DataFrame, value: str, span: int, time: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Lists of the values of each ``span`` of time, in order."""
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([time, *order])], F.col(value).alias("v"))
    out = df.groupBy(*keys, F.floor(F.col(time) / span).alias("buffer")).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    return out.select(*keys, "buffer", F.transform("__items", lambda s: s["v"]).alias("items"))


def sample(df: DataFrame, span: int, time: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The last row of each ``span`` of time."""
    return last(df.withColumn("__span", F.floor(F.col(time) / span)), [time, *order], [*keys, "__span"]).drop("__span")


def delay(df: DataFrame, by: int, time: str) -> DataFrame:
    return df.withColumn(time, F.col(time) + by)


def time_interval(df: DataFrame, time: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``interval``: the time since the row before; null for the first."""
    return df.withColumn("interval", F.col(time) - F.lag(time).over(over(keys, time, *order)))


def timeout(df: DataFrame, limit: int, time: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows before the first gap of more than ``limit``, where the sequence times out."""
    gap = F.max(F.coalesce(F.col("interval") > limit, F.lit(False)).cast("int")).over(over(keys, time, *order).rowsBetween(Window.unboundedPreceding, 0))
    return time_interval(df, time, order, keys).withColumn("__gap", gap).filter("__gap = 0").drop("__gap", "interval")


def take_until(df: DataFrame, condition: Column, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows up to the first that holds, which is kept."""
    before = F.max(F.coalesce(condition, F.lit(False)).cast("int")).over(over(keys, *order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__f", F.coalesce(before, F.lit(0))).filter("__f = 0").drop("__f")


def skip_until(df: DataFrame, other: DataFrame, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows after the first of ``other``."""
    return _against_first(df, other, time, keys).filter(F.col(time) > F.col("__first")).drop("__first")


def take_until_other(df: DataFrame, other: DataFrame, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows before the first of ``other``."""
    return _against_first(df, other, time, keys).filter(F.col("__first").isNull() | (F.col(time) < F.col("__first"))).drop("__first")


def _against_first(df: DataFrame, other: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    firsts = other.groupBy(*keys).agg(F.min(time).alias("__first")).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__first")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(firsts, cond, "left").drop(*[f"__k_{k}" for k in keys])


def with_latest_from(left: DataFrame, right: DataFrame, time: str, value: str, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Each row of ``left`` with the latest ``right_value`` at it; rows before the first are left out."""
    both = left.withColumn("__side", F.lit(1)).unionByName(right.select(*{time: 0, **dict.fromkeys(keys, 0), **dict.fromkeys(order, 0)}, F.struct(F.col(value).alias("v")).alias("__r")).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = over(keys, time, "__side", *order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__latest", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1 and __latest is not null").select(*left.columns, F.col("__latest.v").alias("right_value"))


def merge(df: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        df = df.unionByName(o)
    return df


def switch(df: DataFrame, source: str, time: str, order: Sequence[str]) -> DataFrame:
    """Rows of the source that began last: once a source has begun, those that began before it end.

    The time alone ends a source: its rows of that time are out, whatever their
    ``order``, which only tells which of the sources that begin at once is the last.
    Rows without a time begin nothing; a source that has no other rows comes last, ends none and isn't ended.
    """
    first = F.min(F.when(F.col(time).isNotNull(), F.struct(F.col(time), *order)))
    begun = df.groupBy(source).agg(first.alias("__begin"))
    ends = begun.withColumn("__end", F.lead(F.col("__begin")[time]).over(Window.orderBy(F.col("__begin").asc_nulls_last()))).drop("__begin").withColumnRenamed(source, "__source")
    return df.join(ends, F.col(source).eqNullSafe(F.col("__source"))).filter(F.col("__end").isNull() | (F.col(time) < F.col("__end"))).drop("__source", "__end")


def amb(df: DataFrame, source: str, time: str, order: Sequence[str]) -> DataFrame:
    """Rows of the source that has the first row of all."""
    winner = df.agg(F.min_by(F.struct(source), F.struct(F.col(time), *order)).alias("__w")).select(F.col(f"__w.{source}").alias("__source"))
    return df.join(F.broadcast(winner), F.col(source).eqNullSafe(F.col("__source")), "left_semi")


def group_join(left: DataFrame, right: DataFrame, by: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Each row of ``left`` with aggregates of all rows of ``right`` that have its key (null like null); the right is reduced before the join."""
    groups = right.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()]).withColumnsRenamed({k: f"__k_{k}" for k in by})
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(groups, cond, "left").drop(*[f"__k_{k}" for k in by])


def materialize(df: DataFrame, order: str) -> DataFrame:
    """Rows as notifications ``next``, and ``completed`` at the end."""
    nexts = df.select(F.lit("next").alias("kind"), F.col(order).cast("long").alias("ord"), F.struct(*df.columns).alias("value"))
    value = nexts.schema["value"].dataType
    end = df.agg((F.coalesce(F.max(order), F.lit(-1)) + 1).cast("long").alias("ord")).select(F.lit("completed").alias("kind"), "ord", F.lit(None).cast(value).alias("value"))
    return nexts.union(end)


def dematerialize(df: DataFrame) -> DataFrame:
    """Rows of the notifications before the first that ends the sequence."""
    end = df.filter("kind <> 'next'").agg(F.min("ord").alias("__end"))
    return df.join(F.broadcast(end), F.lit(True)).filter("kind = 'next' and (__end is null or ord < __end)").select("value.*")


def ignore_elements(df: DataFrame) -> DataFrame:
    return df.filter("false")


def expand(df: DataFrame, step, depth: int, level: str = "level") -> DataFrame:
    """The rows, what ``step`` makes of them, what it makes of that, and so on for ``depth`` levels."""
    out = now = df.withColumn(level, F.lit(0))
    for i in range(1, depth + 1):
        now = step(now.drop(level)).withColumn(level, F.lit(i))
        out = out.unionByName(now)
    return out


def cast(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Every value as the type; one that isn't of it is an error."""
    return df.withColumn(column, F.col(column).cast(kind))


def of_type(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The rows whose value is of the type."""
    return df.withColumn(column, F.col(column).try_cast(kind)).filter(F.col(column).isNotNull())


def order_by(df: DataFrame, *by: str, name: str = "ord") -> DataFrame:
    """Adds ``name``: the place of each row from 0 by the columns, further ones among ties; a minus before a column turns it around. Equal rows come in any order."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    kinds = dict(df.dtypes)
    down = [c.startswith("-") for c in by]
    plain = [c.removeprefix("-") for c in by]
    if all(kinds[c] in numbers or not d for c, d in zip(plain, down, strict=True)):
        held = df.withColumns({f"__o{i}": -F.col(c) if d else F.col(c) for i, (c, d) in enumerate(zip(plain, down, strict=True))})
        order = [f"__o{i}" for i in range(len(by))]
        return ordinals(held, order, (), name).drop(*order)
    from pyspark.sql.window import Window as W

    columns = [F.col(c).desc() if d else F.col(c) for c, d in zip(plain, down, strict=True)]
    return df.withColumn(name, (F.row_number().over(W.orderBy(*columns)) - 1).cast("long"))


def timestamp(df: DataFrame, time: str, name: str = "timestamp") -> DataFrame:
    """Each row with its time as a timestamp."""
    return df.withColumn(name, F.timestamp_millis(F.col(time)))


def to_list(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``items``: the values of each key in order; the feature is one list a key."""
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    out = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    return out.select(*keys, F.transform("__items", lambda s: s["v"]).alias("items"))


def to_hash_set(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``items``: the distinct values of each key, sorted."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("items"))


def to_dictionary(df: DataFrame, key: str, value: str) -> DataFrame:
    """One map; a key that comes twice is an error."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))).alias("items"))


def to_lookup(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """A row for each key with the list of its values."""
    return to_list(df, value, order, [key])


def first_or_default(df: DataFrame, order: Sequence[str], **values) -> DataFrame:
    return default_if_empty(first(df, order), **values)


def last_or_default(df: DataFrame, order: Sequence[str], **values) -> DataFrame:
    return default_if_empty(last(df, order), **values)


def element_at_or_default(df: DataFrame, i: int, order: Sequence[str], **values) -> DataFrame:
    return default_if_empty(element_at(df, i, order), **values)


def single_or_default(df: DataFrame, **values) -> DataFrame:
    return default_if_empty(single(df), **values)


def indexed(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``index``, from 0: what indexed selections and filters look at."""
    return _numbered(df, order, keys).withColumn("index", (F.col("__n") - 1).cast("long")).drop("__n")


def _span(df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    ends = df.groupBy(*keys).agg(F.min(time).alias("__first"), F.max(time).alias("__last")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(ends, cond).drop(*[f"__k_{k}" for k in keys])


def take_for(df: DataFrame, span: int, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows less than ``span`` after the first."""
    return _span(df, time, keys).filter(F.col(time) - F.col("__first") < span).drop("__first", "__last")


def skip_for(df: DataFrame, span: int, time: str, keys: Sequence[str] = ()) -> DataFrame:
    return _span(df, time, keys).filter(F.col(time) - F.col("__first") >= span).drop("__first", "__last")


def take_last_for(df: DataFrame, span: int, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows less than ``span`` before the last."""
    return _span(df, time, keys).filter(F.col("__last") - F.col(time) < span).drop("__first", "__last")


def skip_last_for(df: DataFrame, span: int, time: str, keys: Sequence[str] = ()) -> DataFrame:
    return _span(df, time, keys).filter(F.col("__last") - F.col(time) >= span).drop("__first", "__last")


def timeout_with(df: DataFrame, fallback: DataFrame, limit: int, time: str, order: Sequence[str], keys: Sequence[str] = (), part: str = "part") -> DataFrame:
    """Rows before the first gap of more than ``limit`` (part 0), then the fallback's rows of the keys that timed out (part 1)."""
    gaps = time_interval(df, time, order, keys).groupBy(*keys).agg(F.max("interval").alias("__gap")).filter(F.col("__gap") > limit).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return concat(timeout(df, limit, time, order, keys), fallback.join(gaps, cond, "left_semi"), part=part)


def combine_latest_all(sources: dict[str, DataFrame], time: str, value: str, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """At each row of any source, the latest value of all (a column each); rows before all have one are left out. Ties by ``order``, then by the place of the source."""
    held = list(dict.fromkeys([*keys, time, *order]))
    every = None
    for i, (name, df) in enumerate(sources.items()):
        one = df.select(*held, F.struct(F.col(value).alias("v")).alias(f"__v_{name}"), F.lit(i).alias("__side"))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    w = over(keys, time, *order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    latest = every.withColumns({f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(w) for n in sources})
    whole = F.lit(True)
    for n in sources:
        whole = whole & F.col(f"__l_{n}").isNotNull()
    return latest.filter(whole).select(*held, *[F.col(f"__l_{n}.v").alias(n) for n in sources])


def zip_all(sources: dict[str, DataFrame], value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The n-th values of all sources (a column each), within the keys, as long as all have one."""
    out = None
    for name, df in sources.items():
        one = _numbered(df, order, keys).select(*[F.col(k).alias(f"{k}" if out is None else f"__k_{k}") for k in keys], F.col("__n").alias("__n" if out is None else "__m"), F.col(value).alias(name))
        if out is None:
            out = one
            continue
        cond = F.col("__n") == F.col("__m")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        out = out.join(one, cond).drop("__m", *[f"__k_{k}" for k in keys])
    return out.withColumn("n", (F.col("__n") - 1).cast("long")).drop("__n")


def when(*plans: tuple[dict[str, DataFrame], dict[str, Column]], value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Join patterns: each plan zips its sources and selects from their values; the results of all plans are one sequence."""
    out = None
    for sources, columns in plans:
        one = zip_all(sources, value, order, keys).select(*keys, *[c.alias(n) for n, c in columns.items()])
        out = one if out is None else out.unionByName(one)
    return out


def group_by_until(df: DataFrame, ends: DataFrame, time: str, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Adds ``group``: a key's group ends with the first row of ``ends`` of that key; what comes at that time or later starts the next one, numbered from 0."""
    marks = ends.select(*keys, time, F.lit(1).alias("__end"))
    both = df.withColumn("__end", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    w = over(keys, time).rangeBetween(Window.unboundedPreceding, 0)
    closed = both.withColumn("__closed", F.sum("__end").over(w)).filter("__end = 0")
    return closed.withColumn("group", (F.dense_rank().over(over(keys, "__closed")) - 1).cast("long")).drop("__end", "__closed")


def union_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return left.unionByName(right).distinct()


def intersect_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that both have."""
    return left.intersect(right.select(*left.columns))


def except_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the left that the right doesn't have."""
    return left.subtract(right.select(*left.columns))


def fold(df: DataFrame, value: str, start: Column, step, order: Sequence[str], keys: Sequence[str] = (), name: str = "result") -> DataFrame:
    """A user's fold over the values of each key in order; the feature reads a key's values one after the other."""
    return to_list(df, value, order, keys).select(*keys, F.aggregate("items", start, step).alias(name))
