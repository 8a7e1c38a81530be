"""Aggregate functions as column expressions.

Each takes a column (or name) and gives a column for ``agg`` or a window.
Nulls are skipped; a filter goes in with ``where``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.frame import col

X = str | Column


def where(condition: Column, x: X) -> Column:
    """The column where the condition holds: ``sum_(where(p, x))`` aggregates a part."""
    return F.when(condition, col(x))


def count() -> Column:
    return F.count(F.lit(1))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def count_not_null(x: X) -> Column:
    return F.count(col(x))


def sum_(x: X) -> Column:
    return F.sum(col(x))


def sum_squares(x: X) -> Column:
    return F.sum(col(x) * col(x))


def product(x: X) -> Column:
    return F.product(col(x))


def average(x: X) -> Column:
    return F.avg(col(x))


def average_squares(x: X) -> Column:
    return F.avg(col(x) * col(x))


def min_(x: X, by: X | None = None) -> Column:
    """Least value, or the one with the least ``by``."""
    return F.min(col(x)) if by is None else F.min_by(col(x), col(by))


def max_(x: X, by: X | None = None) -> Column:
    return F.max(col(x)) if by is None else F.max_by(col(x), col(by))


def percentile_continuous(x: X, p: float) -> Column:
    """Interpolated at p * (n - 1)."""
    return F.percentile(col(x), F.lit(p))


def percentile_discrete(x: X, p: float) -> Column:
    """The element number ceil(p * n), the least one for p = 0; a double from counts of distinct values, if ``x`` is a name."""
    if isinstance(x, str):
        return F.expr(f"percentile_disc({float(p)}D) WITHIN GROUP (ORDER BY `{x}`)")
    return F.element_at(F.array_sort(F.collect_list(x)), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.count(x))).cast("int"))


def standard_deviation(x: X) -> Column:
    """Of the sample; null for fewer than two values."""
    return F.stddev_samp(col(x))


def population_standard_deviation(x: X) -> Column:
    return F.stddev_pop(col(x))


def variance(x: X) -> Column:
    return F.var_samp(col(x))


def population_variance(x: X) -> Column:
    return F.var_pop(col(x))


def standard_score(x: X) -> Column:
    """Mean and population deviation together."""
    return F.struct(F.avg(col(x)).alias("avg"), F.stddev_pop(col(x)).alias("std"))


def single_or_default(x: X, default: object = None) -> Column:
    """The only value, a default if there is none; an error if there are more."""
    n = F.count(col(x))
    return F.when(n > 1, F.raise_error(F.lit("more than one value"))).otherwise(F.coalesce(F.any_value(col(x), ignoreNulls=True), F.lit(default)))


def to_list(x: X) -> Column:
    return F.collect_list(col(x))


def sorted_list(x: X) -> Column:
    return F.array_sort(F.collect_list(col(x)))


def top_k(x: X, k: int) -> Column:
    """Structs (value, rank) of the values of rank k or better, greatest first; ties share a rank and all stay.

    A value's rank is one more than its first place among the sorted ones, so
    only the first k and the ties of the last of them are looked at. For large
    groups use ``top_k_rows``, which gathers nothing.
    """
    values = F.reverse(F.array_sort(F.collect_list(col(x))))
    least = F.element_at(values, F.least(F.lit(k), F.size(values)))
    best = F.when(F.size(values) > 0, F.filter(values, lambda v: v >= least)).otherwise(values)
    return F.transform(best, lambda v: F.struct(v.alias("value"), F.array_position(best, v).cast("int").alias("rank")))


def joined(parts: dict[str, Column]) -> Column:
    """Several aggregates as one struct."""
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def null_when_empty(x: X, value: Column) -> Column:
    return F.when(F.count(col(x)) > 0, value)


def default_when_empty(x: X, value: Column, default: object) -> Column:
    return F.coalesce(null_when_empty(x, value), F.lit(default))


def transform_input(f: Callable[[Column], Column], aggregate: Callable[[Column], Column]) -> Callable[[X], Column]:
    return lambda x: aggregate(f(col(x)))


def transform_output(aggregate: Callable[[Column], Column], f: Callable[[Column], Column]) -> Callable[[X], Column]:
    return lambda x: f(aggregate(col(x)))


def folded(x: X, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda a: a, order: X | None = None) -> Column:
    """A user's fold over the values of a group, in their own order or that of ``order``."""
    if order is None:
        values = F.array_sort(F.collect_list(col(x)))
    else:
        values = F.transform(F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(x).alias("x")))), lambda s: s["x"])
    return F.aggregate(values, start, step, finish)


def user_aggregate(f: Callable, kind: str) -> Callable[..., Column]:
    """A user's function from the values of a group (pandas Series) to one value; the group travels by Arrow."""
    import warnings

    from pyspark.sql.functions import PandasUDFType, pandas_udf

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # a user's function has no type hints to tell its kind
        return pandas_udf(f, kind, PandasUDFType.GROUPED_AGG)
