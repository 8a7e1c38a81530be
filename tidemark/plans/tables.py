"""The tables as interval relations and signals, in DataFrame and in SQL form, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.frame import epoch_ms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MIN, HOUR, DAY = 60_000, 3_600_000, 86_400_000

#: ev: events that live for an hour; vw and pu: views and purchases among them; sig: hourly means of each user's values.
EV = f"ev AS (SELECT event_id, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000 AS vs, epoch_us(ts) // 1000 + {HOUR} AS ve FROM events)"
VW = "vw AS (SELECT event_id, user_id, cents, vs, ve FROM ev WHERE event_type = 'view')"
PU = f"pu AS (SELECT event_id, user_id, cents, vs, vs + {6 * HOUR} AS ve FROM ev WHERE event_type = 'purchase')"
SIG = f"sig AS (SELECT user_id, (vs // {HOUR}) * {HOUR} AS vs, (vs // {HOUR}) * {HOUR} + {HOUR} AS ve, avg(cents) AS val FROM ev GROUP BY ALL)"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {EV}, {VW}, {PU}, {SIG} {sql}"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = epoch_ms("ts")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.col("value") * 100).cast("long").alias("cents"), t.alias("vs"), (t + HOUR).alias("ve"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).filter("event_type = 'view'").drop("event_type")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).filter("event_type = 'purchase'").drop("event_type").withColumn("ve", F.col("vs") + 6 * HOUR)


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("vs") - F.pmod(F.col("vs"), F.lit(HOUR))
    return ev(spark, sf_dir).groupBy("user_id", start.alias("vs")).agg(F.avg("cents").alias("val")).select("user_id", "vs", (F.col("vs") + HOUR).alias("ve"), "val")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})
