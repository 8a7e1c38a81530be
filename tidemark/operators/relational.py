"""Row operators: they look at one row, and leave lifetimes alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frame import VE, VS, col


def select(df: DataFrame, columns: dict[str, str | Column], keys: Sequence[str] = ()) -> DataFrame:
    """New payload; lifetimes and keys stay."""
    return df.select(*keys, VS, VE, *[col(c).alias(n) for n, c in columns.items()])


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def select_many(df: DataFrame, items: str | Column, name: str) -> DataFrame:
    """One row for each element of an array, each with the row's lifetime; an empty or null array gives none."""
    return df.withColumn(name, F.explode(col(items)))


def with_field(df: DataFrame, name: str, value: str | Column) -> DataFrame:
    return df.withColumn(name, col(value))


def pivot(df: DataFrame, by: Sequence[str], attribute: str, value: str, names: Sequence[str]) -> DataFrame:
    """A column for each of ``names``: its value in the rows of equal ``by``. Names are given, so no pass looks for them."""
    return df.groupBy(*by).pivot(attribute, list(names)).agg(F.first(value, ignorenulls=True))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], attribute: str = "attribute", value: str = "value") -> DataFrame:
    """A row for each column that is not null."""
    return df.unpivot(list(ids), list(columns), attribute, value).filter(F.col(value).isNotNull())


def select_by_key(df: DataFrame, columns: dict[str, str | Column], keys: Sequence[str]) -> DataFrame:
    """A selection that sees the keys, times and payload of a row; keys and lifetime stay."""
    return select(df, columns, keys)


def select_many_by_key(df: DataFrame, items: str | Column, name: str, keys: Sequence[str]) -> DataFrame:
    """A row for each element of an array that is made from keys, times and payload."""
    return df.select(*keys, VS, VE, F.explode(col(items)).alias(name))


def table_function(df: DataFrame, f: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """A user's function from a row to any number of rows; batches travel by Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(",")]
        for batch in batches:
            yield pd.DataFrame([out for row in batch.to_dict("records") for out in f(row)], columns=names)

    return df.mapInPandas(run, schema)
