"""Queries of the signal operators over each user's hourly means."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import signal as W
from tidemark.plans.tables import DAY, HOUR, query, rounded, sig

K = ["user_id"]
#: Grid points up to the next sample within 12 hours, as fill operators see them.
GRID = f"""grid AS (SELECT user_id, vs AS source, val, avg, unnest(range(vs, vs + CASE WHEN n - vs <= {12 * HOUR} THEN n - vs ELSE {HOUR} END, {HOUR})) AS vs FROM (
SELECT *, lead(vs) OVER (PARTITION BY user_id ORDER BY vs) AS n, avg(val) OVER (PARTITION BY user_id, vs // {DAY}) AS avg FROM sig))"""
NORM = f"(val - avg(val) OVER (PARTITION BY user_id, vs // {DAY})) / nullif(stddev_pop(val) OVER (PARTITION BY user_id, vs // {DAY}), 0)"


@query(f"SELECT user_id, vs, ve, round({NORM}, 4) AS val FROM sig")
def sig_normalize(spark, d):
    return rounded(W.normalize(sig(spark, d), DAY, K), "val")


@query(f", {GRID} SELECT user_id, vs, vs + {HOUR} AS ve, round(CASE WHEN vs = source THEN val ELSE 0 END, 4) AS val FROM grid")
def sig_fill_const(spark, d):
    return rounded(W.fill_const(sig(spark, d), HOUR, 12 * HOUR, 0.0, K), "val")


@query(f", {GRID} SELECT user_id, vs, vs + {HOUR} AS ve, round(CASE WHEN vs = source THEN val ELSE avg END, 4) AS val FROM grid")
def sig_fill_mean(spark, d):
    return rounded(W.fill_mean(sig(spark, d), DAY, HOUR, 12 * HOUR, K), "val")


@query(f", {GRID} SELECT user_id, vs, vs + {HOUR} AS ve, vs <> source AS val FROM grid")
def sig_mask(spark, d):
    return W.mask(sig(spark, d), HOUR, 12 * HOUR, K)


def resampled(source: str) -> str:
    step = HOUR // 2
    return f"""SELECT user_id, t AS vs, t + {step} AS ve, (nval - val) * (t - vs) / (n - vs) + val AS val FROM (
SELECT *, unnest(range(vs, CASE WHEN n - vs > {12 * HOUR} THEN vs + {HOUR} ELSE n END, {step})) AS t FROM (
SELECT *, lead(vs) OVER (PARTITION BY user_id ORDER BY vs) AS n, lead(val) OVER (PARTITION BY user_id ORDER BY vs) AS nval FROM {source}) WHERE n IS NOT NULL)"""


@query(f"SELECT user_id, vs, ve, round(val, 4) AS val FROM ({resampled('sig')})")
def sig_resample(spark, d):
    return rounded(W.resample(sig(spark, d), HOUR, HOUR // 2, 12 * HOUR, K), "val").select("user_id", "vs", "ve", "val")


@query(f"""SELECT user_id, vs, n AS ve, round(val, 4) AS val, round(nval, 4) AS next_val FROM (SELECT *, lead(vs) OVER (PARTITION BY user_id ORDER BY vs) AS n, lead(val) OVER (PARTITION BY user_id ORDER BY vs) AS nval FROM sig) WHERE n - vs <= {12 * HOUR}""")
def sig_pairs(spark, d):
    return rounded(W.pairs(sig(spark, d), 12 * HOUR, K), "val", "next_val")


@query(f"""SELECT user_id, min(vs) AS vs, max(ve) AS ve FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY vs) AS i FROM (
SELECT *, CASE WHEN vs - lag(vs) OVER (PARTITION BY user_id ORDER BY vs) > {12 * HOUR} THEN 1 ELSE 0 END AS new FROM sig)) GROUP BY user_id, i""")
def sig_index(spark, d):
    return W.index(sig(spark, d), 12 * HOUR, K)


@query(f"""SELECT user_id, vs // {DAY} * {DAY} AS vs, vs // {DAY} * {DAY} + {DAY} AS ve, count(*) AS n, round(max(val), 4) AS top FROM sig GROUP BY ALL""")
def sig_grid_aggregate(spark, d):
    return rounded(W.grid_aggregate(sig(spark, d), DAY, {"n": F.count(F.lit(1)), "top": F.max("val")}, K), "top")


@query(f"""SELECT user_id, vs, ve, round(val, 4) AS val FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY val DESC, vs) AS k FROM (
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY vs) AS run FROM (
SELECT *, CASE WHEN vs - lag(vs) OVER (PARTITION BY user_id ORDER BY vs) > {HOUR} THEN 1 ELSE 0 END AS new FROM (
SELECT *, avg(val) OVER (PARTITION BY user_id ORDER BY vs RANGE BETWEEN {DAY - 1} PRECEDING AND {DAY} FOLLOWING) AS m FROM sig) WHERE val > 1.05 * m))) WHERE k = 1""")
def sig_peaks(spark, d):
    return rounded(W.peaks(sig(spark, d), HOUR, 1.05, DAY, K), "val").select("user_id", "vs", "ve", "val")


def taps_sql() -> str:
    return f"{[float(t) for t in W.band_pass_taps(2, 2, 200, 20)]}"


@query(f"""SELECT user_id, vs, ve, round(list_sum([list_extract({taps_sql()}, i + 1) * past[-1 - i] FOR i IN range(len(past))]), 3) AS val FROM (
SELECT *, list(val) OVER (PARTITION BY user_id ORDER BY vs ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS past FROM sig)""")
def sig_band_pass(spark, d):
    return W.band_pass(sig(spark, d), 2, 2, 200, K, 20).withColumn("val", F.round("val", 3))


def fill_mean_sql(source: str, out: str) -> str:
    return f"""{out} AS (SELECT user_id, CASE WHEN vs = source THEN val ELSE avg END AS val, vs FROM (SELECT user_id, vs AS source, val, avg, unnest(range(vs, vs + CASE WHEN n - vs <= {12 * HOUR} THEN n - vs ELSE {HOUR} END, {HOUR})) AS vs FROM (
SELECT *, lead(vs) OVER (PARTITION BY user_id ORDER BY vs) AS n, avg(val) OVER (PARTITION BY user_id, vs // {DAY}) AS avg FROM {source})))"""


@query(f""", {fill_mean_sql('sig', 'filled')}, slow AS (SELECT user_id, vs, {NORM} AS val FROM ({resampled('filled')})), fast AS (SELECT user_id, vs, vs + {HOUR} AS ve, {NORM} AS val FROM filled)
SELECT f.user_id, f.vs, f.ve, round(f.val, 4) + 0.0 AS val, round(s.val, 4) + 0.0 AS r_val FROM fast f JOIN slow s ON f.user_id = s.user_id AND f.vs = s.vs""")
def sig_e2e(spark, d):
    s = sig(spark, d)
    filled = W.fill_mean(s, DAY, HOUR, 12 * HOUR, K)
    slow = W.normalize(W.resample(filled, HOUR, HOUR // 2, 12 * HOUR, K), DAY, K)
    return rounded(W.grid_join(W.normalize(filled, DAY, K), slow, HOUR // 2, K), "val", "r_val").select("user_id", "vs", "ve", *[(F.col(c) + 0.0).alias(c) for c in ("val", "r_val")])
