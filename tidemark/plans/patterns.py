"""Queries of the pattern and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pattern as N
from tidemark.operators import sequence as Q
from tidemark.plans.tables import DAY, HOUR, ev, query

K, O = ["user_id"], ["vs", "event_id"]


def pairs_sql(*more: str) -> str:
    lead = "".join(f", lead({c}) OVER (PARTITION BY user_id ORDER BY vs, event_id) AS next_{c}" for c in ("vs", *more))
    return f"(SELECT *{lead} FROM ev)"


@query(f"""SELECT event_id, user_id, vs, next_vs AS ve, next_event_id FROM {pairs_sql('event_id', 'event_type')}
WHERE event_type = 'view' AND next_event_type = 'purchase' AND next_vs - vs < {DAY}""")
def pat_followed_by(spark, d):
    kind = F.col("event_type")
    out = N.followed_by(ev(spark, d).drop("cents"), kind == "view", kind == "purchase", DAY, K)
    return out.select("event_id", "user_id", "vs", "ve", "next_event_id")


@query(f"SELECT event_id, user_id, vs, next_vs AS ve, next_event_id FROM {pairs_sql('event_id')} WHERE next_vs IS NOT NULL")
def pat_pairs(spark, d):
    return N.consecutive_pairs(ev(spark, d).select("event_id", "user_id", "vs", "ve"), K, ["event_id"])


@query(f"""SELECT user_id, vs, next_vs + 1 AS ve, '' AS register FROM {pairs_sql('event_type')} WHERE event_type = 'view' AND next_event_type = 'purchase' AND next_vs - vs < {DAY}""")
def pat_automaton(spark, d):
    one, two = (N.Pattern.single(lambda e, r, k=k: e["event_type"] == k) for k in ("view", "purchase"))
    return N.detect(ev(spark, d).drop("cents"), one.then(two).with_register(""), DAY, K, order=["event_id"])


@query("SELECT event_id, user_id, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY vs, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM ev")
def seq_scan(spark, d):
    return Q.scan(ev(spark, d), {"total": F.sum("cents")}, O, K).select("event_id", "user_id", "total")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY vs, event_id) AS p FROM ev) WHERE p IS DISTINCT FROM event_type""")
def seq_distinct_until_changed(spark, d):
    return Q.distinct_until_changed(ev(spark, d), "event_type", O, K).select("event_id", "user_id", "event_type")


@query("""SELECT user_id, buffer, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY vs, event_id) AS ids FROM (
SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY vs, event_id) - 1) // 5 AS buffer FROM ev) GROUP BY user_id, buffer""")
def seq_buffer(spark, d):
    return Q.buffer(ev(spark, d), "event_id", 5, O, K).select("user_id", "buffer", F.array_join(F.col("items").cast("array<string>"), ",").alias("ids"))


@query("SELECT event_id, user_id, previous FROM (SELECT *, lag(cents) OVER (PARTITION BY user_id ORDER BY vs, event_id) AS previous, row_number() OVER (PARTITION BY user_id ORDER BY vs, event_id) AS n FROM ev) WHERE n > 1")
def seq_pairwise(spark, d):
    return Q.pairwise(ev(spark, d), "cents", O, K).select("event_id", "user_id", "previous")


@query(f"SELECT event_id, user_id FROM {pairs_sql()} WHERE next_vs IS NULL OR next_vs - vs > {HOUR}")
def seq_throttle(spark, d):
    return Q.throttle(ev(spark, d), HOUR, "vs", ["event_id"], K).select("event_id", "user_id")


NTH = "row_number() OVER (PARTITION BY user_id ORDER BY vs, event_id) AS n"


@query(f"SELECT event_id, user_id FROM (SELECT *, {NTH} FROM ev) WHERE n > 2 AND n <= 7")
def seq_skip_take(spark, d):
    return Q.skip(Q.take(ev(spark, d), 7, O, K), 2, O, K).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN cents < 10000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY vs, event_id ROWS UNBOUNDED PRECEDING) AS f FROM ev) WHERE f = 0")
def seq_take_while(spark, d):
    return Q.take_while(ev(spark, d), F.col("cents") < 10000, O, K).select("event_id", "user_id")


@query(f"""SELECT a.event_id, a.user_id, b.event_id AS r_event_id FROM (SELECT *, {NTH} FROM ev WHERE event_type = 'click') a
JOIN (SELECT *, {NTH} FROM ev WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.n = b.n""")
def seq_zip(spark, d):
    e = ev(spark, d).select("event_id", "user_id", "event_type", "vs")
    return Q.zip_(e.filter("event_type = 'click'"), e.filter("event_type = 'error'"), O, K).select("event_id", "user_id", "r_event_id")


def latest(kind: str, out: str) -> str:
    return f"last_value(CASE WHEN event_type = '{kind}' THEN cents END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY vs, event_id ROWS UNBOUNDED PRECEDING) AS {out}"


@query(f"""SELECT event_id, user_id, left_value, right_value FROM (SELECT *, {latest('view', 'left_value')}, {latest('purchase', 'right_value')} FROM ev WHERE event_type IN ('view', 'purchase'))
WHERE left_value IS NOT NULL AND right_value IS NOT NULL""")
def seq_combine_latest(spark, d):
    e = ev(spark, d)
    return Q.combine_latest(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "vs", "cents", K, ["event_id"]).select("event_id", "user_id", "left_value", "right_value")
