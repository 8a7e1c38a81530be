"""Queries of sequences that are made, chosen, repeated or shared, and of conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import create as C
from tidemark.operators import sequence as Q
from tidemark.plans.tables import DAY, ev, query, table

K, O = ["user_id"], ["vs", "event_id"]
BY = "PARTITION BY user_id ORDER BY vs, event_id"
IDS = "SELECT event_id, user_id FROM"


def ids(df):
    return df.select("event_id", "user_id")


def kind(spark, d, name):
    return ev(spark, d).filter(F.col("event_type") == name)


@query("SELECT unnest(range(5, 25)) AS value")
def new_range(spark, d):
    return C.range_(spark, 5, 20)


@query("SELECT 7 AS a, 'x' AS b")
def new_return(spark, d):
    return C.return_(spark, a=7, b="x")


@query("SELECT CAST(5 AS BIGINT) AS a")
def new_empty(spark, d):
    return Q.default_if_empty(C.empty(spark, "a bigint"), a=5)


@query("SELECT CAST(pow(2, i) AS BIGINT) AS x, CAST(pow(4, i) AS BIGINT) AS square FROM range(0, 10) t(i)")
def new_generate(spark, d):
    return C.generate(spark, 1, lambda x: x < 1000, lambda x: 2 * x, lambda x: (x, x * x), "x bigint, square bigint", batch=3)


@query("SELECT i AS tick, 100 + 7 * i AS vs FROM range(0, 12) t(i) UNION ALL SELECT i, 50 * i + 50 FROM range(0, 5) t(i)")
def new_timer(spark, d):
    return C.timer(spark, 100, 7, 12).union(C.interval(spark, 50, 5))


@query("SELECT 'x' AS value FROM range(0, 6) t(i)")
def new_repeat(spark, d):
    return C.repeat_value(spark, "x", 6)


@query(f"{IDS} vw UNION ALL {IDS} pu UNION ALL {IDS} pu")
def ctl_choose(spark, d):
    seen, bought = (ids(kind(spark, d, k)) for k in ("view", "purchase"))
    sources = {"a": seen, "b": bought}
    return C.case_("a", sources, bought).union(C.case_("?", sources, bought)).union(C.if_(lambda: False, seen, bought))


@query(f"{IDS} vw UNION ALL {IDS} vw")
def ctl_defer(spark, d):
    made = C.defer(lambda: ids(kind(spark, d, "view")))
    return made().union(made())


@query("SELECT event_id, unnest([0, 1, 2]) AS part FROM vw UNION ALL SELECT event_id, 0 FROM pu")
def ctl_while(spark, d):
    seen, bought = (kind(spark, d, k).select("event_id") for k in ("view", "purchase"))
    return C.while_(lambda n: n < 3, seen).union(C.do_while(bought, lambda n: False)).union(C.while_(lambda n: False, bought))


@query("SELECT event_id, 0 AS part FROM vw UNION ALL SELECT event_id, 1 FROM pu")
def ctl_for(spark, d):
    return C.for_(["view", "purchase"], lambda k: kind(spark, d, k).select("event_id"))


@query("SELECT event_type, count(*) AS n FROM ev GROUP BY event_type UNION ALL SELECT 'all', count(*) FROM ev")
def ctl_publish(spark, d):
    shared = C.publish(ev(spark, d)).connect()
    return shared.multicast(lambda e: e.groupBy("event_type").agg(F.count("*").alias("n")).union(e.agg(F.lit("all"), F.count("*"))))


@query(f"{IDS} (SELECT * FROM ev ORDER BY vs DESC, event_id DESC LIMIT 5)")
def ctl_replay(spark, d):
    return ids(C.memoize(ev(spark, d)).replay(5, O))


@query("SELECT event_id, cents FROM ev")
def seq_cast(spark, d):
    return Q.cast(ev(spark, d).select("event_id", F.col("cents").cast("string").alias("cents")), "cents", "bigint")


@query("SELECT event_id, event_id AS value FROM ev WHERE event_id % 3 <> 0")
def seq_of_type(spark, d):
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return Q.of_type(ev(spark, d).select("event_id", mixed.alias("value")), "value", "bigint")


@query("SELECT event_id, row_number() OVER (ORDER BY cents DESC, event_id) - 1 AS ord FROM ev")
def seq_order_by(spark, d):
    return Q.order_by(ev(spark, d), "-cents", "event_id").select("event_id", "ord")


@query("SELECT event_id, vs AS at FROM ev")
def seq_timestamp(spark, d):
    return Q.timestamp(ev(spark, d), "vs").select("event_id", F.unix_millis("timestamp").alias("at"))


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY vs, event_id) AS items FROM ev GROUP BY user_id")
def seq_to_list(spark, d):
    return Q.to_list(ev(spark, d), "event_id", O, K).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM ev GROUP BY user_id")
def seq_to_hash_set(spark, d):
    return Q.to_hash_set(ev(spark, d), "event_type", K).withColumn("items", F.array_join("items", ","))


@query("SELECT string_agg(r_regionkey || '=' || r_name, ',' ORDER BY r_regionkey) AS items FROM region")
def seq_to_dictionary(spark, d):
    out = Q.to_dictionary(table(spark, d, "region"), "r_regionkey", "r_name")
    return out.select(F.array_join(F.transform(F.map_entries("items"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("items"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS items FROM nation GROUP BY n_regionkey")
def seq_to_lookup(spark, d):
    return Q.to_lookup(table(spark, d, "nation"), "n_regionkey", "n_name", ["n_nationkey"]).withColumn("items", F.array_join("items", ","))


@query("""SELECT 'first' AS form, (SELECT arg_min(event_id, vs) FROM ev) AS event_id UNION ALL SELECT 'last', (SELECT arg_max(event_id, vs) FROM ev) UNION ALL SELECT 'no first', -1
UNION ALL SELECT 'no last', -2 UNION ALL SELECT 'no third', -3 UNION ALL SELECT 'no single', -4 UNION ALL SELECT 'single', (SELECT min(event_id) FROM ev)""")
def seq_or_default(spark, d):
    e = ev(spark, d).select("event_id", "vs")
    none = e.filter("event_id < -9")
    least = e.join(F.broadcast(e.agg(F.min("event_id").alias("event_id"))), "event_id")
    forms = {
        "first": Q.first_or_default(e, O, event_id=-1), "last": Q.last_or_default(e, O, event_id=-2), "no first": Q.first_or_default(none, O, event_id=-1), "no last": Q.last_or_default(none, O, event_id=-2),
        "no third": Q.element_at_or_default(none, 2, O, event_id=-3), "no single": Q.single_or_default(none, event_id=-4), "single": Q.single_or_default(least, event_id=-4),
    }
    out = None
    for name, df in forms.items():
        one = df.select(F.lit(name).alias("form"), "event_id")
        out = one if out is None else out.union(one)
    return out


@query(f"SELECT event_id, user_id, n - 1 AS index FROM (SELECT *, row_number() OVER ({BY}) AS n FROM ev) WHERE (n - 1) % 2 = 0")
def seq_indexed(spark, d):
    return Q.indexed(ev(spark, d), O, K).filter("index % 2 = 0").select("event_id", "user_id", "index")


@query(f"""{IDS} (SELECT *, vs - min(vs) OVER (PARTITION BY user_id) AS a, max(vs) OVER (PARTITION BY user_id) - vs AS b FROM ev) WHERE a < {5 * DAY} UNION ALL
{IDS} (SELECT *, vs - min(vs) OVER (PARTITION BY user_id) AS a FROM ev) WHERE a >= {5 * DAY} UNION ALL {IDS} (SELECT *, max(vs) OVER (PARTITION BY user_id) - vs AS b FROM ev) WHERE b < {4 * DAY}
UNION ALL {IDS} (SELECT *, max(vs) OVER (PARTITION BY user_id) - vs AS b FROM ev) WHERE b >= {9 * DAY}""")
def seq_durations(spark, d):
    e = ev(spark, d)
    return ids(Q.take_for(e, 5 * DAY, "vs", K)).union(ids(Q.skip_for(e, 5 * DAY, "vs", K))).union(ids(Q.take_last_for(e, 4 * DAY, "vs", K))).union(ids(Q.skip_last_for(e, 9 * DAY, "vs", K)))


@query(f""", gaps AS (SELECT *, vs - lag(vs) OVER ({BY}) AS g FROM ev), late AS (SELECT *, max(coalesce(g > {2 * DAY}, false)) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS f FROM gaps)
SELECT event_id, user_id, 0 AS part FROM late WHERE NOT f UNION ALL SELECT event_id, user_id, 1 FROM pu WHERE user_id IN (SELECT user_id FROM gaps WHERE g > {2 * DAY})""")
def seq_timeout_with(spark, d):
    columns = ["event_id", "user_id", "vs"]
    return Q.timeout_with(ev(spark, d).select(*columns), kind(spark, d, "purchase").select(*columns), 2 * DAY, "vs", ["event_id"], K).select("event_id", "user_id", "part")


def latest(name):
    return f"last_value(CASE WHEN event_type = '{name}' THEN cents END IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS {name}"


@query(f"""SELECT event_id, user_id, vs, click, view, error FROM (SELECT *, {latest('click')}, {latest('view')}, {latest('error')} FROM ev WHERE event_type IN ('click', 'view', 'error'))
WHERE click IS NOT NULL AND view IS NOT NULL AND error IS NOT NULL""")
def seq_combine_latest_all(spark, d):
    return Q.combine_latest_all({k: kind(spark, d, k) for k in ("click", "view", "error")}, "vs", "cents", K, ["event_id"])


def nth(name):
    return f"(SELECT *, row_number() OVER ({BY}) - 1 AS n FROM ev WHERE event_type = '{name}')"


ZIPPED = f"{nth('click')} a JOIN {nth('view')} b USING (user_id, n) JOIN {nth('error')} c USING (user_id, n)"


@query(f"SELECT user_id, a.event_id AS click, b.event_id AS view, c.event_id AS error, n FROM {ZIPPED}")
def seq_zip_all(spark, d):
    return Q.zip_all({k: kind(spark, d, k) for k in ("click", "view", "error")}, "event_id", O, K)


@query(f"SELECT user_id, a.cents + b.cents AS total FROM {nth('click')} a JOIN {nth('view')} b USING (user_id, n) UNION ALL SELECT user_id, a.cents - b.cents FROM {nth('signup')} a JOIN {nth('error')} b USING (user_id, n)")
def seq_when(spark, d):
    plan = lambda a, b, c: ({k: kind(spark, d, k) for k in (a, b)}, {"total": c})
    return Q.when(plan("click", "view", F.col("click") + F.col("view")), plan("signup", "error", F.col("signup") - F.col("error")), value="cents", order=O, keys=K)


@query(f"""SELECT event_id, user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY c) - 1 AS "group" FROM (
SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY vs) AS c FROM ev) WHERE event_type <> 'purchase'""")
def seq_group_by_until(spark, d):
    e = ev(spark, d)
    return Q.group_by_until(e.filter("event_type <> 'purchase'"), kind(spark, d, "purchase"), "vs", O, K).select("event_id", "user_id", "group")


@query("SELECT user_id FROM vw UNION SELECT user_id FROM pu")
def seq_union_values(spark, d):
    return Q.union_values(kind(spark, d, "view").select("user_id"), kind(spark, d, "purchase").select("user_id"))


@query("SELECT user_id FROM vw INTERSECT SELECT user_id FROM pu")
def seq_intersect_values(spark, d):
    return Q.intersect_values(kind(spark, d, "view").select("user_id"), kind(spark, d, "purchase").select("user_id"))


@query("SELECT event_id % 50 AS x FROM vw EXCEPT SELECT event_id % 50 FROM ev WHERE event_type = 'signup' AND event_id % 2 = 0")
def seq_except_values(spark, d):
    x = (F.col("event_id") % 50).alias("x")
    return Q.except_values(kind(spark, d, "view").select(x), kind(spark, d, "signup").filter("event_id % 2 = 0").select(x))


@query("SELECT user_id, string_agg(CAST(cents % 10 AS VARCHAR), '' ORDER BY vs, event_id) AS result FROM ev GROUP BY user_id")
def seq_fold(spark, d):
    digits = ev(spark, d).withColumn("digit", (F.col("cents") % 10).cast("string"))
    return Q.fold(digits, "digit", F.lit(""), lambda a, x: F.concat(a, x), O, K)


@query("SELECT event_id, user_id FROM ev WHERE event_id = (SELECT min(event_id) FROM ev)")
def seq_single(spark, d):
    e = ev(spark, d)
    return ids(Q.single(e.join(F.broadcast(e.agg(F.min("event_id").alias("event_id"))), "event_id").select(*e.columns)))


@query(f"{IDS} (SELECT *, max(CASE WHEN cents < 10000 THEN 0 ELSE 1 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS f FROM ev) WHERE f = 1")
def seq_skip_while(spark, d):
    return ids(Q.skip_while(ev(spark, d), F.col("cents") < 10000, O, K))


@query(f"{IDS} vw UNION ALL {IDS} pu UNION ALL {IDS} ev")
def seq_merge(spark, d):
    return Q.merge(ids(kind(spark, d, "view")), ids(kind(spark, d, "purchase")), ids(ev(spark, d)))


@query("SELECT event_id, -vs AS vs FROM ev")
def seq_reverse(spark, d):
    return Q.reverse(ev(spark, d), "vs").select("event_id", "vs")


@query("SELECT event_id, user_id FROM ev WHERE event_id < 100")
def seq_dematerialize(spark, d):
    notes = Q.materialize(ids(ev(spark, d)), "event_id")
    ended = F.when(F.col("ord") >= 100, F.lit("completed")).otherwise(F.col("kind"))
    return Q.dematerialize(notes.withColumn("kind", ended))


@query("SELECT 0 AS n")
def seq_ignore(spark, d):
    return Q.ignore_elements(ev(spark, d)).agg(F.count("*").cast("int").alias("n"))


@query(f"{IDS} (SELECT *, row_number() OVER (ORDER BY vs, event_id) AS n, count(*) OVER () AS c FROM ev) WHERE n <= 7 OR (n > 11 AND n <= c - 3) OR n = 9")
def seq_keyless(spark, d):
    e = ev(spark, d)
    return ids(Q.take(e, 7, O)).union(ids(Q.skip_last(Q.skip(e, 11, O), 3, O))).union(ids(Q.element_at(e, 8, O)))


@query("""SELECT CAST(n // 4 AS BIGINT) AS buffer, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) AS ids FROM (SELECT *, row_number() OVER (ORDER BY vs, event_id) - 1 AS n FROM ev) GROUP BY n // 4""")
def seq_keyless_buffer(spark, d):
    return Q.buffer(ev(spark, d), "event_id", 4, O).select("buffer", F.array_join(F.col("items").cast("array<string>"), ",").alias("ids"))
