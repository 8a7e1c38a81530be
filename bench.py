"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR, and the signal operators on $BENCH_SECONDS seconds at 500 Hz; prints one JSON line.

The signals are those of the baseline's smoke run (6,000 s, 3 M samples); 60,000 give its full size.
"""

import json
import os
import re
import time

from pyspark.sql import SparkSession

from tidemark.operators import signal as W
from tidemark.plans.registry import QUERIES
from tidemark.sources.signals import synthetic

HEADLINE = ["sig_normalize", "sig_fill_const", "sig_fill_mean", "sig_resample", "sig_band_pass", "sig_e2e", "agg_tumbling_all", "agg_hopping", "agg_snapshot_sum", "join_temporal", "join_asof", "pat_followed_by"]


WINDOW = 60_000


def signal_runs(spark: SparkSession, seconds: int) -> dict:
    """The operators of the baseline with its parameters, each over a synthetic signal without keys."""
    fast = synthetic(spark, 0, seconds, 500)
    slow = synthetic(spark, 0, seconds, 125)
    return {
        "signal_normalize": lambda: W.normalize(fast, WINDOW),
        "signal_band_pass": lambda: W.band_pass(fast, 2, 2, 200),
        "signal_fill_const": lambda: W.fill_const(fast, 2, WINDOW, 0.0),
        "signal_fill_mean": lambda: W.fill_mean(fast, WINDOW, 2, WINDOW),
        "signal_resample": lambda: W.resample(fast, 2, 1, 2),
        "signal_end_to_end": lambda: W.end_to_end(slow, fast, 8, 2, WINDOW, WINDOW),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    for name, run in signal_runs(spark, int(os.environ.get("BENCH_SECONDS", "6000"))).items():
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = re.sub(r".*sf", "", sf_dir.rstrip("/"))
    print(json.dumps({"metric": "total_wall", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
