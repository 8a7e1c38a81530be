"""Queries of the aggregates: at every instant, over windows, by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import aggregates as A
from tidemark.operators import aggregate as G
from tidemark.operators import group as P
from tidemark.operators import lifetime as L
from tidemark.plans.tables import DAY, HOUR, ev, query, rounded

SEGMENTS = "times AS (SELECT vs AS t FROM ev UNION SELECT ve FROM ev), seg AS (SELECT t AS s, lead(t) OVER (ORDER BY t) AS e FROM times)"


@query("""SELECT vs, ve, count, sum FROM (SELECT t AS vs, lead(t) OVER (ORDER BY t) AS ve, CAST(sum(n) OVER (ORDER BY t) AS BIGINT) AS count, CAST(sum(c) OVER (ORDER BY t) AS BIGINT) AS sum
FROM (SELECT t, sum(n) AS n, sum(c) AS c FROM (SELECT vs AS t, 1 AS n, cents AS c FROM ev UNION ALL SELECT ve, -1, -cents FROM ev) GROUP BY t)) WHERE count > 0""")
def agg_snapshot_sum(spark, d):
    return G.snapshot_sums(ev(spark, d), {"sum": "cents"})


@query("""SELECT user_id, vs, ve, count FROM (SELECT user_id, t AS vs, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS ve, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS count
FROM (SELECT user_id, t, sum(n) AS n FROM (SELECT user_id, vs AS t, 1 AS n FROM ev UNION ALL SELECT user_id, ve, -1 FROM ev) GROUP BY ALL)) WHERE count > 0""")
def agg_snapshot_count(spark, d):
    return G.snapshot_sums(ev(spark, d), {}, ["user_id"])


@query(f", {SEGMENTS} SELECT s AS vs, e AS ve, max(cents) AS top, min(cents) AS low FROM seg JOIN ev ON ev.vs < e AND ev.ve > s GROUP BY s, e")
def agg_snapshot_max(spark, d):
    return G.snapshot_partials(ev(spark, d), {"top": ("max", "cents"), "low": ("min", "cents")})


@query(f"""SELECT (vs + {DAY - 1}) // {DAY} * {DAY} AS vs, (vs + {DAY - 1}) // {DAY} * {DAY} + {DAY} AS ve, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total,
round(avg(cents), 4) AS mean, min(cents) AS low, max(cents) AS top, round(stddev_samp(cents), 4) AS dev, round(var_pop(cents), 4) AS var,
round(quantile_cont(cents, 0.3), 4) AS p30, CAST(quantile_disc(cents, 0.6) AS BIGINT) AS d60, arg_max(event_id, vs) AS last_id
FROM ev GROUP BY ALL""")
def agg_tumbling_all(spark, d):
    out = G.tumbling_aggregate(
        ev(spark, d).withColumn("at", F.col("vs")),
        DAY,
        {
            "n": A.count(), "total": A.sum_("cents"), "mean": A.average("cents"), "low": A.min_("cents"), "top": A.max_("cents"), "dev": A.standard_deviation("cents"),
            "var": A.population_variance("cents"), "p30": A.percentile_continuous("cents", 0.3), "d60": A.percentile_discrete("cents", 0.6), "last_id": A.max_("event_id", "at"),
        },
    )
    return rounded(out.withColumn("d60", F.col("d60").cast("bigint")), "mean", "dev", "var", "p30")


@query(f"""SELECT b AS vs, b + {2 * HOUR} AS ve, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM (
SELECT *, unnest(range((vs + {2 * HOUR - 1}) // {2 * HOUR} * {2 * HOUR}, vs + {6 * HOUR}, {2 * HOUR})) AS b FROM ev) GROUP BY b, event_type""")
def agg_hopping(spark, d):
    return G.hopping_aggregate(ev(spark, d), 6 * HOUR, 2 * HOUR, {"n": A.count(), "total": A.sum_("cents")}, ["event_type"])


@query(f"""SELECT user_id, (vs + {DAY - 1}) // {DAY} * {DAY} AS vs, (vs + {DAY - 1}) // {DAY} * {DAY} + {DAY} AS ve, count(*) FILTER (event_type = 'click') AS clicks,
CAST(sum(cents) FILTER (event_type = 'purchase') AS BIGINT) AS bought FROM ev GROUP BY ALL""")
def agg_filtered(spark, d):
    kind = F.col("event_type")
    return G.tumbling_aggregate(ev(spark, d), DAY, {"clicks": A.count_if(kind == "click"), "bought": A.sum_(A.where(kind == "purchase", "cents"))}, ["user_id"])


@query(f"""SELECT event_id, vs, ve, rank FROM (SELECT event_id, (vs + {DAY - 1}) // {DAY} * {DAY} AS vs, (vs + {DAY - 1}) // {DAY} * {DAY} + {DAY} AS ve,
rank() OVER (PARTITION BY (vs + {DAY - 1}) // {DAY} ORDER BY cents DESC) AS rank FROM ev) WHERE rank <= 5""")
def agg_topk(spark, d):
    return G.top_k_rows(L.tumbling(ev(spark, d), DAY), "cents", 5).select("event_id", "vs", "ve", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT event_type, (vs + {DAY - 1}) // {DAY} * {DAY} AS vs, (vs + {DAY - 1}) // {DAY} * {DAY} + {DAY} AS ve, count(*) AS n FROM ev GROUP BY ALL")
def grp_aggregate(spark, d):
    return G.group_aggregate(L.tumbling(ev(spark, d), DAY), ["event_type"], {"n": A.count()})


@query(f"""SELECT user_id % 10 AS bucket, (vs + {DAY - 1}) // {DAY} * {DAY} AS vs, (vs + {DAY - 1}) // {DAY} * {DAY} + {DAY} AS ve, CAST(sum(cents) AS BIGINT) AS total FROM ev GROUP BY ALL""")
def grp_map_reduce(spark, d):
    e = P.partition(ev(spark, d), {"bucket": F.col("user_id") % 10})
    return P.map_reduce(e, lambda x: L.tumbling(x, DAY), ["bucket"], {"total": A.sum_("cents")})


@query(f"SELECT event_id, user_id, round(avg(cents) OVER (PARTITION BY user_id, vs // {DAY}), 4) AS mean FROM ev")
def agg_attach(spark, d):
    return rounded(G.attach_aggregate(ev(spark, d), DAY, {"mean": A.average("cents")}, ["user_id"]), "mean").select("event_id", "user_id", "mean")
