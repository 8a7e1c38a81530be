"""Queries of the sequence operators, on each user's events and on all."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sequence as Q
from tidemark.plans.tables import DAY, HOUR, ev, query

K, O = ["user_id"], ["vs", "event_id"]
BY = "PARTITION BY user_id ORDER BY vs, event_id"
DOWN = "PARTITION BY user_id ORDER BY vs DESC, event_id DESC"


def ids(df):
    return df.select("event_id", "user_id")


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER ({DOWN}) AS n FROM ev) WHERE n <= 3")
def seq_take_last(spark, d):
    return ids(Q.take_last(ev(spark, d), 3, O, K))


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER ({DOWN}) AS n FROM ev) WHERE n > 3")
def seq_skip_last(spark, d):
    return ids(Q.skip_last(ev(spark, d), 3, O, K))


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER ({BY}) AS n FROM ev) WHERE n = 5")
def seq_element_at(spark, d):
    return ids(Q.element_at(ev(spark, d), 4, O, K))


@query("SELECT arg_min(event_id, vs) AS event_id, user_id FROM ev GROUP BY user_id")
def seq_first(spark, d):
    return ids(Q.first(ev(spark, d), O, K))


@query("SELECT arg_max(event_id, vs) AS event_id, user_id FROM ev GROUP BY user_id")
def seq_last(spark, d):
    return ids(Q.last(ev(spark, d), O, K))


@query("SELECT user_id, bool_and(cents < 30000) AS \"all\" FROM ev GROUP BY user_id")
def seq_all(spark, d):
    return Q.all_(ev(spark, d), F.col("cents") < 30000, K)


@query("SELECT user_id, bool_or(cents > 30000) AS \"any\" FROM ev GROUP BY user_id")
def seq_any(spark, d):
    return Q.any_(ev(spark, d), F.col("cents") > 30000, K)


@query("SELECT user_id, bool_or(event_type = 'signup') AS contains FROM ev GROUP BY user_id")
def seq_contains(spark, d):
    return Q.contains(ev(spark, d), "event_type", "signup", K)


@query("SELECT count(*) = 0 AS is_empty FROM ev")
def seq_is_empty(spark, d):
    return Q.is_empty(ev(spark, d))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS count FROM ev GROUP BY user_id")
def seq_count(spark, d):
    return Q.count(ev(spark, d), F.col("event_type") == "click", K)


@query("SELECT event_id, user_id FROM (SELECT *, min(cents) OVER (PARTITION BY user_id) AS m FROM ev) WHERE cents = m")
def seq_min_by(spark, d):
    return ids(Q.min_by(ev(spark, d), "cents", K))


@query("SELECT event_id, user_id FROM (SELECT *, max(cents) OVER (PARTITION BY user_id) AS m FROM ev) WHERE cents = m")
def seq_max_by(spark, d):
    return ids(Q.max_by(ev(spark, d), "cents", K))


@query("SELECT arg_min(event_id, vs) AS event_id, user_id FROM ev GROUP BY user_id, event_type")
def seq_distinct_by(spark, d):
    return ids(Q.distinct_by(ev(spark, d), ["event_type"], O, K))


@query("SELECT CAST(-1 AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS user_id FROM region LIMIT 1")
def seq_default_if_empty(spark, d):
    return Q.default_if_empty(ids(ev(spark, d).filter("cents < -1")), event_id=-1)


@query("SELECT event_id, user_id, 0 AS part FROM vw UNION ALL SELECT event_id, user_id, 1 FROM pu")
def seq_concat(spark, d):
    e = ev(spark, d)
    return Q.concat(ids(e.filter("event_type = 'view'")), ids(e.filter("event_type = 'purchase'")))


@query("SELECT event_id, user_id, unnest([0, 1, 2]) AS part FROM vw")
def seq_repeat(spark, d):
    return Q.repeat(ids(ev(spark, d).filter("event_type = 'view'")), 3)


@query("SELECT event_id, user_id, 0 AS part FROM vw UNION ALL SELECT 0, NULL, -1")
def seq_prepend(spark, d):
    return Q.prepend(ids(ev(spark, d).filter("event_type = 'view'")), event_id=0)


@query("SELECT (SELECT list(cents ORDER BY vs, event_id) FROM vw) = (SELECT list(cents ORDER BY vs, event_id) FROM pu) AS equal")
def seq_equal(spark, d):
    e = ev(spark, d)
    return Q.sequence_equal(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "cents", O)


@query(f"""SELECT user_id, (n - 1) // 3 AS buffer, array_to_string(l, ',') AS ids FROM (SELECT user_id, row_number() OVER ({BY}) AS n, list(event_id) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l FROM ev) WHERE (n - 1) % 3 = 0""")
def seq_sliding_buffer(spark, d):
    return Q.sliding_buffer(ev(spark, d), "event_id", 5, 3, O, K).select("user_id", "buffer", F.array_join(F.col("items").cast("array<string>"), ",").alias("ids"))


@query(f"SELECT user_id, vs // {DAY} AS buffer, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY vs, event_id) AS ids FROM ev GROUP BY ALL")
def seq_time_buffer(spark, d):
    return Q.time_buffer(ev(spark, d), "event_id", DAY, "vs", ["event_id"], K).select("user_id", "buffer", F.array_join(F.col("items").cast("array<string>"), ",").alias("ids"))


@query(f"SELECT arg_max(event_id, vs) AS event_id, user_id FROM ev GROUP BY user_id, vs // {DAY}")
def seq_sample(spark, d):
    return ids(Q.sample(ev(spark, d), DAY, "vs", ["event_id"], K))


@query(f"SELECT event_id, vs + {HOUR} AS vs FROM ev")
def seq_delay(spark, d):
    return Q.delay(ev(spark, d), HOUR, "vs").select("event_id", "vs")


@query(f"SELECT event_id, user_id, vs - lag(vs) OVER ({BY}) AS interval FROM ev")
def seq_time_interval(spark, d):
    return Q.time_interval(ev(spark, d), "vs", ["event_id"], K).select("event_id", "user_id", "interval")


@query(f"""SELECT event_id, user_id FROM (SELECT *, max(coalesce(g > {DAY}, false)) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS late FROM (SELECT *, vs - lag(vs) OVER ({BY}) AS g FROM ev)) WHERE NOT late""")
def seq_timeout(spark, d):
    return ids(Q.timeout(ev(spark, d), DAY, "vs", ["event_id"], K))


@query(f"""SELECT event_id, user_id FROM (SELECT *, max(event_type = 'purchase') OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM ev) WHERE NOT coalesce(f, false)""")
def seq_take_until(spark, d):
    return ids(Q.take_until(ev(spark, d), F.col("event_type") == "purchase", O, K))


@query("SELECT e.event_id, e.user_id FROM ev e JOIN (SELECT user_id, min(vs) AS f FROM pu GROUP BY user_id) p ON e.user_id = p.user_id AND e.vs > f")
def seq_skip_until(spark, d):
    e = ev(spark, d)
    return ids(Q.skip_until(e, e.filter("event_type = 'purchase'"), "vs", K))


@query("SELECT e.event_id, e.user_id FROM ev e LEFT JOIN (SELECT user_id, min(vs) AS f FROM pu GROUP BY user_id) p ON e.user_id = p.user_id WHERE f IS NULL OR e.vs < f")
def seq_take_until_other(spark, d):
    e = ev(spark, d)
    return ids(Q.take_until_other(e, e.filter("event_type = 'purchase'"), "vs", K))


@query("SELECT v.event_id, v.user_id, p.cents AS right_value FROM vw v ASOF JOIN pu p ON v.user_id = p.user_id AND v.vs >= p.vs")
def seq_with_latest_from(spark, d):
    e = ev(spark, d)
    return Q.with_latest_from(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "vs", "cents", K, ["event_id"]).select("event_id", "user_id", "right_value")


@query("""SELECT event_id, ev.user_id FROM ev JOIN (SELECT user_id, lead(b) OVER (ORDER BY b) AS nb FROM (SELECT user_id, min(vs) AS b FROM ev GROUP BY user_id)) s
ON ev.user_id = s.user_id WHERE nb IS NULL OR vs < nb""")
def seq_switch(spark, d):
    return ids(Q.switch(ev(spark, d), "user_id", "vs", ["event_id"])).filter("user_id is not null")


@query("SELECT event_id, user_id FROM ev WHERE user_id = (SELECT arg_min(user_id, vs) FROM ev)")
def seq_amb(spark, d):
    return ids(Q.amb(ev(spark, d), "user_id", "vs", ["event_id"]))


@query("SELECT v.event_id, v.user_id, n, total FROM vw v LEFT JOIN (SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM pu GROUP BY user_id) p ON v.user_id = p.user_id")
def seq_group_join(spark, d):
    e = ev(spark, d)
    out = Q.group_join(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), K, {"n": F.count("*"), "total": F.sum("cents")})
    return out.select("event_id", "user_id", "n", "total")


@query("SELECT event_id, user_id FROM ev")
def seq_materialize(spark, d):
    return Q.dematerialize(Q.materialize(ids(ev(spark, d)), "event_id"))


@query("SELECT event_id, cents, 0 AS level FROM vw UNION ALL SELECT event_id, cents // 2, 1 FROM vw WHERE cents >= 2 UNION ALL SELECT event_id, cents // 4, 2 FROM vw WHERE cents >= 4")
def seq_expand(spark, d):
    e = ev(spark, d).filter("event_type = 'view'").select("event_id", "cents")
    return Q.expand(e, lambda x: x.filter("cents >= 2").withColumn("cents", F.expr("cents div 2")), 2)
