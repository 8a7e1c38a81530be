"""Text functions on columns; positions count from 0, and -1 is "not found"."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.frame import col

X = str | Column


def contains(x: X, part: str) -> Column:
    return col(x).contains(part)


def index_of(x: X, part: str, start: int = 0) -> Column:
    return F.locate(part, col(x), start + 1) - 1


def last_index_of(x: X, part: str, start: int | None = None) -> Column:
    """The last place of the part; with ``start``, the last that lies wholly in the text up to that place."""
    text = col(x) if start is None else F.substring(col(x), 1, start + 1)
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at - len(part) + 1)


def is_match(x: X, pattern: str) -> Column:
    return col(x).rlike(pattern)


def lower(x: X) -> Column:
    return F.lower(col(x))


def upper(x: X) -> Column:
    return F.upper(col(x))


def split(x: X, pattern: str) -> Column:
    return F.split(col(x), pattern)


def substring(x: X, start: int, length: int) -> Column:
    return F.substring(col(x), start + 1, length)


def equals(x: X, y: X) -> Column:
    return col(x).eqNullSafe(col(y))


def hash_code(x: X) -> Column:
    return F.xxhash64(col(x))


def length(x: X) -> Column:
    return F.length(col(x))


def split_any(x: X, separators: str) -> Column:
    """Parts between any of the characters."""
    return F.split(col(x), "[" + "".join(c if c.isalnum() else f"\\{c}" for c in separators) + "]", -1)


def apply(x: X, f: Callable[[str], object], kind: str) -> Column:
    """A user's function of each text; batches travel by Arrow, and nulls stay."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run(col(x))


def apply_boolean(x: X, f: Callable[[str], bool]) -> Column:
    return apply(x, f, "boolean")


def apply_string(x: X, f: Callable[[str], str]) -> Column:
    return apply(x, f, "string")
