"""Operators on streams that keep a state for each key: the last rows that were seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pairs(df: DataFrame, key: str, time: str, value: str, within: int | None = None) -> DataFrame:
    """Each row with the next of its key, as ``[vs, ve)`` with ``val`` and ``next_val`` (``time`` in ms as long, numeric ``value``).

    A batch is sorted by time and value; a row older than the last of its key in an earlier batch is left out. Pairs that
    are ``within`` ms or more apart are left out.
    """

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).dropna(subset=[time]).sort_values([time, value], kind="stable")
        at, val = rows[time].tolist(), [None if pd.isna(v) else float(v) for v in rows[value]]
        if state.exists:
            last = state.get
            fresh = [i for i, t in enumerate(at) if t >= last[0]]
            at, val = [last[0], *[at[i] for i in fresh]], [last[1], *[val[i] for i in fresh]]
        if not at:
            return
        state.update((int(at[-1]), val[-1]))
        out = pd.DataFrame({key: keys[0], "vs": at[:-1], "ve": at[1:], "val": val[:-1], "next_val": val[1:]})
        yield out if within is None else out[out["ve"] - out["vs"] < within]

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, vs bigint, ve bigint, val double, next_val double"
    return df.select(key, time, value).groupBy(key).applyInPandasWithState(step, schema, "at bigint, val double", "append", GroupStateTimeout.NoTimeout)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """After each batch: ``n`` rows and their ``total``, for each key that had rows in it."""

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, value).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)
