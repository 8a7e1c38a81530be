"""Queries of the lifetime operators, rows, sets of fields and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import strings as S
from tidemark.operators import lifetime as L
from tidemark.operators import relational as R
from tidemark.plans.tables import DAY, HOUR, MIN, ev, query, table

COLS = ["event_id", "vs", "ve"]


@query(f"SELECT event_id, vs + {5 * MIN} AS vs, ve + {5 * MIN} AS ve FROM ev")
def lt_shift(spark, d):
    return L.shift(ev(spark, d).select(*COLS), 5 * MIN)


@query(f"SELECT event_id, vs, vs + cents % 7 * {MIN} AS ve FROM ev WHERE cents % 7 > 0")
def lt_alter(spark, d):
    return L.alter_duration(ev(spark, d), F.col("cents") % 7 * MIN).select(*COLS)


@query(f"SELECT event_id, (vs + {2 * HOUR - 1}) // {2 * HOUR} * {2 * HOUR} AS vs, (vs + {2 * HOUR - 1}) // {2 * HOUR} * {2 * HOUR} + {6 * HOUR} AS ve FROM ev")
def lt_hopping(spark, d):
    return L.hopping(ev(spark, d).select(*COLS), 6 * HOUR, 2 * HOUR)


@query(f"SELECT event_id, (vs + {DAY - 1}) // {DAY} * {DAY} AS vs, (vs + {DAY - 1}) // {DAY} * {DAY} + {DAY} AS ve FROM ev")
def lt_tumbling(spark, d):
    return L.tumbling(ev(spark, d).select(*COLS), DAY)


@query(f"""SELECT event_id, vs // {HOUR} * {HOUR} AS vs, t - (t - {4 * HOUR}) % {2 * HOUR} AS ve
FROM (SELECT *, greatest(ve + {2 * HOUR - 1}, vs + {4 * HOUR}) AS t FROM ev)""")
def lt_quantize(spark, d):
    return L.quantize(ev(spark, d).select(*COLS), 4 * HOUR, 2 * HOUR, 0, HOUR)


@query(f"""SELECT event_id, greatest(vs, b) AS vs, least(ve, b + {10 * MIN}) AS ve
FROM (SELECT event_id, vs, ve, unnest(range(vs // {10 * MIN} * {10 * MIN}, ve, {10 * MIN})) AS b FROM ev)""")
def lt_chop(spark, d):
    return L.chop(ev(spark, d).select(*COLS), 10 * MIN)


@query(f"""SELECT event_id, user_id, vs, max(vs) OVER (PARTITION BY user_id, s) + {12 * HOUR} AS ve FROM (
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY vs) AS s FROM (
SELECT *, CASE WHEN vs - lag(vs) OVER (PARTITION BY user_id ORDER BY vs) >= {12 * HOUR} THEN 1 ELSE 0 END AS new FROM ev))""")
def lt_session(spark, d):
    return L.session(ev(spark, d).select("user_id", *COLS), 12 * HOUR, keys=["user_id"])


@query(f"SELECT event_id, vs, least(ve, vs + {30 * MIN}) AS ve FROM ev")
def lt_clip_const(spark, d):
    return L.clip(ev(spark, d).select(*COLS), 30 * MIN)


@query(f"""SELECT event_id, user_id, vs, least(ve, coalesce((SELECT min(p.vs) FROM pu p WHERE p.user_id = ev.user_id AND p.vs > ev.vs), ve)) AS ve FROM ev""")
def lt_clip_by(spark, d):
    e = ev(spark, d).select("user_id", *COLS, "event_type")
    return L.clip_by(e.drop("event_type"), e.filter("event_type = 'purchase'").select("user_id", "vs", "ve"), ["user_id"])


@query("SELECT event_id, user_id, vs, least(ve, coalesce(lead(vs) OVER (PARTITION BY user_id ORDER BY vs), ve)) AS ve FROM ev")
def lt_clip_self(spark, d):
    return L.clip_self(ev(spark, d).select("user_id", *COLS), ["user_id"])


@query(f"SELECT event_id, vs, ve + {MIN} AS ve FROM ev")
def lt_extend(spark, d):
    return L.extend(ev(spark, d).select(*COLS), MIN)


@query("SELECT event_id, ve AS vs, ve + 1 AS ve FROM ev")
def lt_point_at_end(spark, d):
    return L.point_at_end(ev(spark, d).select(*COLS))


@query(f"""SELECT user_id, min(vs) AS vs, max(ve) AS ve FROM (
SELECT *, vs - {HOUR} * row_number() OVER (PARTITION BY user_id ORDER BY vs) AS g FROM sig) GROUP BY user_id, g""")
def lt_stitch(spark, d):
    start = L.snap_down(F.col("vs"), HOUR)
    hours = ev(spark, d).select("user_id", start.alias("vs"), (start + HOUR).alias("ve")).distinct()
    return L.stitch(hours).select("user_id", "vs", "ve")


@query("SELECT event_id, cents * 2 AS twice, upper(event_type) AS kind, vs, ve FROM ev WHERE cents > 5000")
def rel_select_where(spark, d):
    return R.select(R.where(ev(spark, d), F.col("cents") > 5000), {"event_id": "event_id", "twice": F.col("cents") * 2, "kind": S.upper("event_type")})


@query("SELECT event_id, vs, ve, unnest(string_split(event_type, 'i')) AS part FROM ev")
def rel_select_many(spark, d):
    return R.select_many(ev(spark, d), S.split("event_type", "i"), "part").select(*COLS, "part")


@query("""SELECT user_id, CAST(sum(cents) FILTER (event_type = 'click') AS BIGINT) AS click, CAST(sum(cents) FILTER (event_type = 'view') AS BIGINT) AS view FROM ev GROUP BY user_id""")
def rel_pivot(spark, d):
    sums = ev(spark, d).groupBy("user_id", "event_type").agg(F.sum("cents").alias("cents"))
    return R.pivot(sums, ["user_id"], "event_type", "cents", ["click", "view"])


@query("SELECT event_id, 'vs' AS attribute, vs AS value FROM ev UNION ALL SELECT event_id, 'cents', cents FROM ev")
def rel_unpivot(spark, d):
    return R.unpivot(ev(spark, d), ["event_id"], ["vs", "cents"])


@query("""SELECT doc_id, contains(text, 'the') AS has, CAST(instr(text, 'a') - 1 AS BIGINT) AS first_a, regexp_matches(text, '[0-9]{3}') AS digits,
CAST(length(text) AS BIGINT) AS n, substring(text, 3, 5) AS part FROM documents""")
def str_functions(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", S.contains("text", "the").alias("has"), S.index_of("text", "a").cast("long").alias("first_a"), S.is_match("text", "[0-9]{3}").alias("digits"), S.length("text").cast("long").alias("n"), S.substring("text", 2, 5).alias("part"))
