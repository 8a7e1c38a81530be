"""Signals from generators, text files, index files and binary records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.frame import INF

HOUR_MS = 3_600_000
SIGNAL = "ts bigint, val float"
INDEX = "ignored string, device string, vs bigint, ve bigint"
#: Where a signal's file lies below the root: year/month/day/hour/.../device~signal.extension
FILE = r"^.*/(\d{4})/(\d{1,2})/(\d{1,2})/(\d{1,2})/(?:[^/]+/)*([^/~]+)~([^/.]+)[^/]*$"


def synthetic(spark: SparkSession, start: int, duration: int, frequency: int) -> DataFrame:
    """``duration * frequency`` samples, 1000 / frequency apart from ``start``; a sample's value is its time."""
    period = 1000 // frequency
    vs = F.col("id") * period + start
    return spark.range(duration * frequency).select(vs.alias("vs"), (vs + period).alias("ve"), vs.cast("double").alias("val"))


def with_file_parts(df: DataFrame) -> DataFrame:
    """Adds ``device``, ``signal``, and the hour ``[t_start, t_end)`` that the path of a row's file names."""
    path = F.col("_metadata.file_path")
    part = [F.regexp_extract(path, FILE, i) for i in range(1, 7)]
    number = [F.try_to_number(p, F.lit("999999")).cast("int") for p in part[:4]]
    days = F.datediff(F.make_date(*number[:3]), F.lit("1970-01-01").cast("date")).cast("long")
    start = (days * 24 + number[3]) * HOUR_MS
    return df.select(*df.columns, part[4].alias("device"), part[5].alias("signal"), start.alias("t_start"), (start + HOUR_MS).alias("t_end"))


def csv_signal(spark: SparkSession, root: str, signal: str = "*", device: str = "*", open_end: bool = True, period: int = 1) -> DataFrame:
    """Rows ``ts,val`` of all files device~signal.csv below ``root``; start edges if ``open_end``, else ``period`` long."""
    raw = spark.read.schema(SIGNAL).option("recursiveFileLookup", True).option("pathGlobFilter", f"{device}~{signal}.csv").csv(root)
    end = F.lit(INF) if open_end else F.col("ts") + period
    return with_file_parts(raw).select("device", "signal", F.col("ts").alias("vs"), end.alias("ve"), "val")


def index_file(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of devices: the second, third and fourth columns of a text file are device, start and end."""
    return spark.read.schema(INDEX).csv(path).select("device", "vs", "ve")


def binary_records(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]], skip: int = 0, glob: str = "*", chunk: int = 100_000) -> DataFrame:
    """Fixed-width records of binary files, as ``file``, ``ord`` and the fields.

    ``fields`` are names with numpy types such as ``<i8``, ``>u2`` or ``<f4``; ``skip`` bytes of each file come
    before the records. Bytes beyond the last whole record are an error. A file is read by one task, and sent on in chunks.
    """
    layout = np.dtype(list(fields))
    spark_type = {"i": "bigint", "u": "decimal(20,0)", "f": "double"}
    wide = {n: layout[n].kind == "u" and layout[n].itemsize == 8 for n, _ in fields}
    schema = ", ".join(["file string", "ord bigint", *[f"`{n}` {spark_type['u'] if wide[n] else spark_type['f' if layout[n].kind == 'f' else 'i']}" for n, _ in fields]])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                body = memoryview(content)[skip:]
                if len(body) % layout.itemsize:
                    raise ValueError(f"{name}: {len(body)} bytes are not records of {layout.itemsize}")
                records = np.frombuffer(body, layout)
                for at in range(0, len(records), chunk):
                    part = records[at : at + chunk]
                    columns = {n: [Decimal(int(v)) for v in part[n]] if wide[n] else part[n].astype("f8" if layout[n].kind == "f" else "i8") for n, _ in fields}
                    yield pd.DataFrame({"file": name, "ord": np.arange(at, at + len(part)), **columns})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(decode, schema)
