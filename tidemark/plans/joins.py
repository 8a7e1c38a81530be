"""Queries of the joins and set operators over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import join as J
from tidemark.plans.tables import ev, purchases, query, views

INNER = "SELECT v.event_id, v.user_id, greatest(v.vs, p.vs) AS vs, least(v.ve, p.ve) AS ve, p.event_id AS r_event_id FROM vw v JOIN pu p ON v.user_id = p.user_id AND v.vs < p.ve AND p.vs < v.ve"


def cover(name: str, source: str) -> str:
    return f"""{name} AS (SELECT user_id, min(vs) AS s, max(ve) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY vs, ve ROWS UNBOUNDED PRECEDING) AS i FROM (
SELECT *, CASE WHEN vs > max(ve) OVER (PARTITION BY user_id ORDER BY vs, ve ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {source})) GROUP BY user_id, i)"""


def gaps(left: str, stretches: str) -> str:
    """The parts of left rows outside the stretches."""
    return f"""SELECT event_id, user_id, p AS vs, least(ve, coalesce((SELECT min(s) FROM {stretches} c WHERE c.user_id = l.user_id AND c.s >= l.p), ve)) AS ve FROM (
SELECT event_id, user_id, ve, vs AS p FROM {left} UNION SELECT x.event_id, x.user_id, x.ve, c.e FROM {left} x JOIN {stretches} c ON c.user_id = x.user_id AND c.e > x.vs AND c.e < x.ve) l
WHERE NOT EXISTS (SELECT 1 FROM {stretches} c WHERE c.user_id = l.user_id AND c.s <= l.p AND l.p < c.e)"""


CP, CV = cover("cp", "pu"), cover("cv", "vw")
ID = ["event_id", "user_id", "vs", "ve"]


@query(INNER)
def join_temporal(spark, d):
    return J.join(views(spark, d).select(*ID), purchases(spark, d).select(*ID), ["user_id"])


@query("SELECT v.event_id, greatest(v.vs, p.vs) AS vs, least(v.ve, p.ve) AS ve, p.event_id AS r_event_id FROM vw v JOIN pu p ON v.vs < p.ve AND p.vs < v.ve AND v.cents < p.cents")
def join_cross_theta(spark, d):
    c = ["event_id", "cents", "vs", "ve"]
    return J.join(views(spark, d).select(*c), purchases(spark, d).select(*c), condition=F.col("cents") < F.col("r_cents")).drop("cents", "r_cents")


@query(f", {CP} {gaps('vw', 'cp')}")
def join_anti(spark, d):
    return J.anti_join(views(spark, d).select(*ID), purchases(spark, d).select("user_id", "vs", "ve"), ["user_id"])


@query(f", {CP} {INNER} UNION ALL SELECT *, NULL FROM ({gaps('vw', 'cp')})")
def join_left_outer(spark, d):
    return J.left_outer_join(views(spark, d).select(*ID), purchases(spark, d).select(*ID), ["user_id"])


@query(f", {CP}, {CV} {INNER} UNION ALL SELECT *, NULL FROM ({gaps('vw', 'cp')}) UNION ALL SELECT NULL, user_id, vs, ve, event_id FROM ({gaps('pu', 'cv')})")
def join_full_outer(spark, d):
    return J.full_outer_join(views(spark, d).select(*ID), purchases(spark, d).select(*ID), ["user_id"])


@query(f", {CP} SELECT event_id, v.user_id, greatest(vs, s) AS vs, least(ve, e) AS ve FROM vw v JOIN cp ON v.user_id = cp.user_id AND vs < e AND s < ve")
def join_semi(spark, d):
    return J.semi_join(views(spark, d).select(*ID), purchases(spark, d).select("user_id", "vs", "ve"), ["user_id"])


@query("SELECT v.event_id, v.user_id, v.vs, p.event_id AS r_event_id, p.vs AS r_vs FROM vw v ASOF LEFT JOIN pu p ON v.user_id = p.user_id AND v.vs >= p.vs")
def join_asof(spark, d):
    return J.as_of_join(views(spark, d).select(*ID), purchases(spark, d).select(*ID), ["user_id"]).drop("ve")


@query("""SELECT event_id, user_id, vs, coalesce((SELECT min(p.vs) FROM pu p WHERE p.user_id = v.user_id AND p.vs > v.vs), 9223372036854775807) AS ve FROM vw v""")
def sessionize(spark, d):
    kind = F.col("event_type")
    return J.sessionize(ev(spark, d).select(*ID, "event_type"), kind == "view", kind == "purchase", ["user_id"]).drop("event_type")


@query("SELECT event_id, user_id, vs, ve FROM vw UNION ALL SELECT event_id, user_id, vs, ve FROM pu")
def set_union(spark, d):
    return J.union(views(spark, d).select(*ID), purchases(spark, d).select(*ID))


@query("""SELECT user_id, vs, ve FROM (SELECT user_id, t AS vs, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS ve, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS c
FROM (SELECT user_id, t, sum(n) AS n FROM (SELECT user_id, vs AS t, 1 AS n FROM pu UNION ALL SELECT user_id, ve, -1 FROM pu) GROUP BY ALL)) WHERE c > 0""")
def set_distinct(spark, d):
    return J.distinct(purchases(spark, d).select("user_id", "vs", "ve"))


@query(f", {CP}, {CV} SELECT cv.user_id, greatest(cv.s, cp.s) AS vs, least(cv.e, cp.e) AS ve FROM cv JOIN cp ON cv.user_id = cp.user_id AND cv.s < cp.e AND cp.s < cv.e")
def set_intersect(spark, d):
    c = ["user_id", "vs", "ve"]
    return J.intersect(views(spark, d).select(*c), purchases(spark, d).select(*c))


@query(f", {CP} SELECT user_id, vs, ve FROM ({gaps('vw', 'cp')})")
def set_except(spark, d):
    c = ["user_id", "vs", "ve"]
    return J.except_(views(spark, d).select(*c), purchases(spark, d).select(*c))
