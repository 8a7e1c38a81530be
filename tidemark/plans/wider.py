"""Queries of the remaining joins, groups, fluent forms, lifetimes, signals and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregate as G
from tidemark.operators import group as P
from tidemark.operators import join as J
from tidemark.operators import lifetime as L
from tidemark.operators import pattern as N
from tidemark.operators import relational as R
from tidemark.operators import signal as W
from tidemark.operators.frame import INF, Props, QueryContext, TemporalFrame
from tidemark.plans.joins import ID, INNER, cover, gaps
from tidemark.plans.signals import NORM, fill_mean_sql
from tidemark.plans.tables import DAY, HOUR, MIN, ev, purchases, query, rounded, sig, views

K = ["user_id"]
COLS = ["event_id", "vs", "ve"]
OVERLAP = "v.vs < p.ve AND p.vs < v.ve"


def both(spark, d):
    return views(spark, d).select(*ID), purchases(spark, d).select(*ID)


@query(f"SELECT v.event_id, v.user_id, greatest(v.vs, p.vs) AS vs, {INF} AS ve, p.event_id AS r_event_id FROM vw v JOIN pu p ON v.user_id = p.user_id")
def join_start_edges(spark, d):
    return J.start_edge_join(*both(spark, d), K)


@query(INNER)
def join_fixed_interval(spark, d):
    return J.fixed_interval_join(*both(spark, d), HOUR, 6 * HOUR, K)


@query(INNER)
def join_hint(spark, d):
    return J.hinted_join(*both(spark, d), "increasing", K)


@query(f""", vo AS (SELECT event_id, user_id, vs, CASE WHEN event_id % 5 = 0 THEN {INF} ELSE ve END AS ve FROM vw)
SELECT v.event_id, greatest(v.vs, p.vs) AS vs, least(v.ve, p.ve) AS ve, p.event_id AS r_event_id FROM vo v JOIN pu p ON v.user_id = p.user_id AND {OVERLAP}""")
def join_open_ends(spark, d):
    v, p = both(spark, d)
    return J.join(v.withColumn("ve", F.when(F.col("event_id") % 5 == 0, F.lit(INF)).otherwise(F.col("ve"))), p, K).drop("user_id")


@query(f"SELECT v.event_id, greatest(v.vs, p.vs) AS vs, {INF} AS ve, p.event_id AS r_event_id FROM vw v, pu p")
def join_all_open(spark, d):
    v, p = (x.select("event_id", "vs", F.lit(INF).alias("ve")) for x in both(spark, d))
    return J.join(v, p)


@query(f", vw0 AS (SELECT event_id, 0 AS user_id, vs, ve FROM vw), pu0 AS (SELECT 0 AS user_id, vs, ve FROM pu), {cover('cp', 'pu0')} SELECT event_id, vs, ve FROM ({gaps('vw0', 'cp')})")
def join_anti_all(spark, d):
    v, p = both(spark, d)
    return J.anti_join(v.drop("user_id"), p.select("vs", "ve"))


THETA = f"m AS (SELECT v.event_id AS user_id, greatest(v.vs, p.vs) AS vs, least(v.ve, p.ve) AS ve, p.event_id AS other FROM vw v JOIN pu p ON {OVERLAP} AND v.cents < p.cents), vw0 AS (SELECT event_id, event_id AS user_id, vs, ve FROM vw)"


@query(f", {THETA}, {cover('cp', 'm')} SELECT event_id, vs, ve FROM ({gaps('vw0', 'cp')})")
def join_anti_theta(spark, d):
    c = ["event_id", "cents", "vs", "ve"]
    return J.anti_join(views(spark, d).select(*c), purchases(spark, d).select(*c), less=("cents", "cents")).drop("cents")


@query(f", {THETA}, {cover('cp', 'm')} SELECT event_id, vs, ve, NULL AS r_event_id FROM ({gaps('vw0', 'cp')}) UNION ALL SELECT user_id, vs, ve, other FROM m")
def join_left_outer_theta(spark, d):
    c = ["event_id", "cents", "vs", "ve"]
    return J.left_outer_join(views(spark, d).select(*c), purchases(spark, d).select(*c), less=("cents", "cents")).select("event_id", "vs", "ve", "r_event_id")


@query("SELECT event_id, vs, ve FROM vw UNION ALL SELECT event_id, vs, ve FROM pu UNION ALL SELECT event_id, vs, ve FROM ev")
def set_multi_union(spark, d):
    return J.multi_union(*(x.select(*COLS) for x in (*both(spark, d), ev(spark, d))))


@query("""SELECT event_type, vs, ve FROM (SELECT event_type, t AS vs, lead(t) OVER (PARTITION BY event_type ORDER BY t) AS ve, sum(n) OVER (PARTITION BY event_type ORDER BY t) AS c
FROM (SELECT event_type, t, sum(n) AS n FROM (SELECT event_type, vs AS t, 1 AS n FROM ev UNION ALL SELECT event_type, ve, -1 FROM ev) GROUP BY ALL)) WHERE c > 0""")
def set_distinct_selector(spark, d):
    return J.distinct(ev(spark, d), {"event_type": F.col("event_type")})


@query("""SELECT event_type, vs, ve, count, count * 2 AS twice FROM (SELECT event_type, t AS vs, lead(t) OVER (PARTITION BY event_type ORDER BY t) AS ve, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY t) AS BIGINT) AS count
FROM (SELECT event_type, t, sum(n) AS n FROM (SELECT event_type, vs AS t, 1 AS n FROM ev UNION ALL SELECT event_type, ve, -1 FROM ev) GROUP BY ALL)) WHERE count > 0""")
def grp_apply(spark, d):
    return G.group_apply(ev(spark, d), ["event_type"], lambda e, keys: G.snapshot_sums(e, {}, keys), {"twice": F.col("count") * 2})


@query(f""", a AS (SELECT user_id % 10 AS bucket, (vs + {DAY - 1}) // {DAY} * {DAY} AS vs, count(*) AS seen FROM vw GROUP BY ALL), b AS (SELECT user_id % 10 AS bucket, (vs + {DAY - 1}) // {DAY} * {DAY} AS vs, CAST(sum(cents) AS BIGINT) AS paid FROM pu GROUP BY ALL)
SELECT bucket, vs, vs + {DAY} AS ve, seen, paid FROM a FULL JOIN b USING (bucket, vs)""")
def grp_reduce_two(spark, d):
    v, p = (L.tumbling(P.partition(x, {"bucket": F.col("user_id") % 10}), DAY) for x in (views(spark, d), purchases(spark, d)))
    return P.reduce_two(v, p, ["bucket"], {"seen": F.count("*")}, {"paid": F.sum("cents")})


@query("SELECT event_id, unnest([0, 1, 2]) AS shard FROM vw")
def grp_shufflecast(spark, d):
    return P.shufflecast(views(spark, d).select("event_id"), 3)


@query("SELECT event_id, 2 * cents AS twice FROM vw")
def grp_sharded(spark, d):
    s = P.shard(views(spark, d), 4, K).query(lambda x: x.withColumn("twice", F.col("cents") * 2))
    return s.rekey("event_id").redistribute(3).query(lambda x: x.select("event_id", "twice", "shard")).unshard()


@query("SELECT event_id FROM vw UNION ALL SELECT event_id FROM pu")
def grp_spray(spark, d):
    v, p = both(spark, d)
    return P.group_union(P.spray(v, 3), P.spray(p, 2, K)).select("event_id")


@query("SELECT user_id, event_type, count(*) AS count FROM ev GROUP BY ALL")
def grp_count_by(spark, d):
    return P.count_by(ev(spark, d), ["user_id", "event_type"])


@query("SELECT event_id, cents + user_id AS x, user_id, vs, ve FROM ev")
def rel_select_by_key(spark, d):
    return R.select_by_key(ev(spark, d), {"event_id": "event_id", "x": F.col("cents") + F.col("user_id")}, K)


@query("SELECT user_id, vs, ve, unnest([user_id, cents]) AS x FROM ev")
def rel_select_many_by_key(spark, d):
    return R.select_many_by_key(ev(spark, d), F.array("user_id", "cents"), "x", K)


@query("SELECT event_id, cents, cents % 7 AS rest FROM ev")
def rel_with_field(spark, d):
    return R.with_field(ev(spark, d), "rest", F.col("cents") % 7).select("event_id", "cents", "rest")


@query(f"SELECT v.event_id, p.event_id AS r_event_id, greatest(v.vs, p.vs) AS vs, least(v.ve, p.ve) AS ve FROM vw v JOIN pu p ON {OVERLAP}")
def rel_two_streams(spark, d):
    v, p = both(spark, d)
    return J.join(v.select(*COLS), p.select(*COLS))


@query("SELECT event_id, unnest(range(0, cents % 4)) AS i FROM ev")
def rel_table_function(spark, d):
    return R.table_function(ev(spark, d).select("event_id", "cents"), lambda r: [(r["event_id"], i) for i in range(r["cents"] % 4)], "event_id bigint, i bigint")


def frame(spark, d, **promises):
    return TemporalFrame(ev(spark, d), ("user_id",), Props(**promises))


@query("SELECT event_id FROM vw UNION ALL SELECT event_id FROM pu UNION ALL SELECT event_id FROM vw")
def frame_multicast(spark, d):
    f = frame(spark, d)
    a, b = f.multicast(lambda x: x.where(F.col("event_type") == "view"), lambda x: x.where(F.col("event_type") == "purchase"))
    return f.multicast_with(a, lambda x, y: a.union(b)).union(f.copies(2)[1].where(F.col("event_type") == "view")).df.select("event_id")


@query(f"""SELECT a.event_id, b.event_id AS r_event_id, greatest(a.vs, b.vs) AS vs, least(a.vs, b.vs) + {HOUR} AS ve, a.user_id FROM vw a JOIN (SELECT * FROM ev WHERE event_type = 'click') b ON a.user_id = b.user_id AND abs(a.vs - b.vs) < {HOUR}""")
def frame_equi_join(spark, d):
    f = frame(spark, d).set_property(constant_duration=HOUR, no_open_ends=True)
    pick = lambda k: TemporalFrame(f.df.filter(F.col("event_type") == k).select(*ID), f.keys, f.get_properties())
    return pick("view").equi_join(pick("click")).df


@query("SELECT 0 AS broken")
def frame_check(spark, d):
    f = frame(spark, d).set_property(constant_duration=HOUR, no_open_ends=True)
    return f.check().agg(F.count("*").cast("int").alias("broken"))


@query(f"SELECT event_id, user_id, vs, vs + {2 * HOUR} AS ve, cents * 3 AS x FROM ev WHERE event_type = 'view' AND cents > 1000")
def q_select_where(spark, d):
    f = frame(spark, d).where((F.col("event_type") == "view") & (F.col("cents") > 1000))
    return f.select({"event_id": "event_id", "x": F.col("cents") * 3}).alter_duration(2 * HOUR).df


@query(f"""SELECT event_id, least(ve, vs + {30 * MIN}) + {MIN} AS vs, least(ve, vs + {30 * MIN}) + {MIN + 1} AS ve FROM ev WHERE event_type = 'click'""")
def q_lifetimes(spark, d):
    return frame(spark, d).where(F.col("event_type") == "click").clip(30 * MIN).extend(MIN).point_at_end().df.select(*COLS)


@query("SELECT user_id, count(*) AS n FROM vw GROUP BY user_id")
def q_context(spark, d):
    context = QueryContext(spark)
    context.register("tidemark_views", views(spark, d), K)
    assert context["tidemark_views"].keys == ("user_id",)
    return context.sql("SELECT user_id, count(*) AS n FROM tidemark_views GROUP BY user_id").df


@query(f"SELECT event_type, min(vs) AS first, count(*) AS n FROM ev WHERE vs % {DAY} < {12 * HOUR} GROUP BY event_type")
def q_group(spark, d):
    f = frame(spark, d).where(F.col("vs") % DAY < 12 * HOUR)
    return f.group_apply(["event_type"], lambda e, keys: e.groupBy(*keys).agg(F.min("vs").alias("first"), F.count("*").alias("n"))).df


@query(f"""SELECT event_id, b AS vs, b + {2 * HOUR} AS ve FROM (SELECT event_id, unnest(range((vs + {2 * HOUR - 1}) // {2 * HOUR} * {2 * HOUR}, (vs + {2 * HOUR - 1}) // {2 * HOUR} * {2 * HOUR} + {6 * HOUR}, {2 * HOUR})) AS b FROM ev)""")
def lt_repetitive(spark, d):
    return L.repetitive_hopping(ev(spark, d).select(*COLS), 6 * HOUR, 2 * HOUR)


@query(f"SELECT event_id, vs // {MIN * 30} * {MIN * 30} AS vs, t - (t - {4 * HOUR}) % {2 * HOUR} AS ve FROM (SELECT *, greatest(ve + {2 * HOUR - 1}, vs + {4 * HOUR}) AS t FROM ev)")
def lt_progressive(spark, d):
    return L.progressive_quantize(ev(spark, d).select(*COLS), 4 * HOUR, 2 * HOUR, 30 * MIN)


@query(f"""SELECT event_id, (vs + {DAY - 1}) // {DAY} * {DAY} AS vs, (vs + {DAY - 1}) // {DAY} * {DAY} + {6 * HOUR} AS ve FROM ev WHERE (vs + {DAY - 1}) // {DAY} * {DAY} - vs < {6 * HOUR}""")
def lt_hopping_sparse(spark, d):
    return L.hopping(ev(spark, d).select(*COLS), 6 * HOUR, DAY).withColumn("ve", F.col("vs") + 6 * HOUR)


@query(f"""SELECT user_id, min(vs) AS vs, max(ve) AS ve, count(*) AS n, round(sum(val), 3) AS total FROM (SELECT *, vs - {HOUR} * row_number() OVER (PARTITION BY user_id ORDER BY vs) AS g FROM sig) GROUP BY user_id, g""")
def lt_stitch_aggregate(spark, d):
    return L.stitch_aggregate(sig(spark, d), {"n": F.count("*"), "total": F.sum("val")}, K).withColumn("total", F.round("total", 3))


@query("SELECT user_id, vs, ve, val FROM (SELECT user_id, vs, ve, round(val, 4) AS val FROM sig) WHERE vs % 7200000 = 0")
def sig_alter_period(spark, d):
    return rounded(W.alter_period(sig(spark, d), 2 * HOUR).withColumn("ve", F.col("vs") + HOUR), "val").select("user_id", "vs", "ve", "val")


@query(f"SELECT event_id, t AS vs, t + {20 * MIN} AS ve FROM (SELECT event_id, unnest(range(vs, ve, {20 * MIN})) AS t FROM ev)")
def sig_chop_grid(spark, d):
    return W.chop_grid(ev(spark, d).select(*COLS), 20 * MIN)


@query("SELECT user_id, vs, coalesce(lead(vs) OVER (PARTITION BY user_id ORDER BY vs), ve) AS ve, round(val, 4) AS val FROM sig")
def sig_clip_to_next(spark, d):
    return rounded(W.clip_to_next(sig(spark, d), K), "val").select("user_id", "vs", "ve", "val")


@query(f""", b AS (SELECT user_id, vs // {2 * HOUR} * {2 * HOUR} AS hop, val FROM sig)
SELECT h.user_id, h.hop AS vs, h.hop + {2 * HOUR} AS ve, count(*) AS n, round(max(b.val), 4) AS top FROM (SELECT DISTINCT user_id, hop FROM b) h JOIN b ON b.user_id = h.user_id AND b.hop <= h.hop AND b.hop > h.hop - {6 * HOUR} GROUP BY h.user_id, h.hop""")
def sig_grid_hopping(spark, d):
    return rounded(W.grid_hopping(sig(spark, d), 6 * HOUR, 2 * HOUR, {"n": F.count("*"), "top": F.max("val")}, K), "top")


@query(f"SELECT user_id, vs, ve, round(val - avg(val) OVER (PARTITION BY user_id, vs // {DAY}), 3) AS val FROM sig")
def sig_transform(spark, d):
    def centred(window):
        window["val"] = window["val"] - window["val"].mean()
        return window

    return W.transform(sig(spark, d), DAY, centred, "user_id bigint, vs bigint, ve bigint, val double", K).withColumn("val", F.round("val", 3))


@query(f"""SELECT user_id, t AS vs, t + {HOUR // 2} AS ve, round((nval - val) * (t - vs) / (n - vs) + val, 4) AS val FROM (SELECT *, unnest(range(vs, n, {HOUR // 2})) AS t FROM (
SELECT *, lead(vs) OVER (PARTITION BY user_id ORDER BY vs) AS n, lead(val) OVER (PARTITION BY user_id ORDER BY vs) AS nval FROM sig) WHERE n - vs <= {HOUR})""")
def sig_resample_abutting(spark, d):
    return rounded(W.resample(sig(spark, d), HOUR, HOUR // 2, None, K), "val").select("user_id", "vs", "ve", "val")


@query(f"SELECT user_id, vs, ve, round({NORM.replace('stddev_pop', 'stddev_samp')}, 4) AS val FROM sig")
def sig_normalize_sample(spark, d):
    return rounded(W.normalize(sig(spark, d), DAY, K, ddof=1), "val").select("user_id", "vs", "ve", "val")


@query(f"SELECT user_id, vs // {DAY} * {DAY} AS vs, vs // {DAY} * {DAY} + {DAY} AS ve, string_agg(CAST(round(val, 0) AS BIGINT) || '', ',' ORDER BY vs) AS batch FROM sig GROUP BY user_id, vs // {DAY}")
def sig_batches(spark, d):
    item = F.struct("vs", F.round("val", 0).cast("bigint").alias("v"))
    out = W.grid_aggregate(sig(spark, d).withColumn("item", item), DAY, {"batch": F.array_sort(F.collect_list("item"))}, K)
    return out.withColumn("batch", F.array_join(F.transform("batch", lambda s: s["v"].cast("string")), ","))


FAST = f"fast AS (SELECT user_id, vs, vs + {HOUR} AS ve, {NORM} AS val FROM filled)"


@query(f""", two AS (SELECT user_id, vs, val FROM sig WHERE vs % {2 * HOUR} = 0), {fill_mean_sql('sig', 'filled')}, {fill_mean_sql('two', 'held').replace(f'ELSE {HOUR} END, {HOUR}', f'ELSE {2 * HOUR} END, {2 * HOUR}')},
slow AS (SELECT user_id, vs, {NORM} AS val FROM (SELECT user_id, t AS vs, (nval - val) * (t - vs) / (n - vs) + val AS val FROM (SELECT *, unnest(range(vs, CASE WHEN n - vs > {12 * HOUR} THEN vs + {2 * HOUR} ELSE n END, {HOUR})) AS t FROM (
SELECT *, lead(vs) OVER (PARTITION BY user_id ORDER BY vs) AS n, lead(val) OVER (PARTITION BY user_id ORDER BY vs) AS nval FROM held) WHERE n IS NOT NULL))), {FAST}
SELECT f.user_id, f.vs, f.ve, round(f.val, 4) + 0.0 AS val, round(s.val, 4) + 0.0 AS r_val FROM fast f JOIN slow s ON f.user_id = s.user_id AND f.vs = s.vs""")
def sig_end_to_end(spark, d):
    s = sig(spark, d)
    out = W.end_to_end(s.filter(F.col("vs") % (2 * HOUR) == 0), s, 2 * HOUR, HOUR, DAY, 12 * HOUR, K)
    return rounded(out, "val", "r_val").select("user_id", "vs", "ve", *[(F.col(c) + 0.0).alias(c) for c in ("val", "r_val")])


RR_WINDOW = 10 * DAY


@query(f""", many AS (SELECT *, unnest([1.02, 1.05, 1.10, 1.15]) AS factor FROM sig),
high AS (SELECT * FROM (SELECT *, avg(val) OVER (PARTITION BY user_id, factor ORDER BY vs RANGE BETWEEN {DAY - 1} PRECEDING AND {DAY} FOLLOWING) AS m FROM many) WHERE val > factor * m),
runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id, factor ORDER BY vs) AS run FROM (SELECT *, CASE WHEN vs - lag(vs) OVER (PARTITION BY user_id, factor ORDER BY vs) > {HOUR} THEN 1 ELSE 0 END AS new FROM high)),
peak AS (SELECT user_id, factor, vs FROM (SELECT *, row_number() OVER (PARTITION BY user_id, factor, run ORDER BY val DESC, vs) AS k FROM runs) WHERE k = 1),
rr AS (SELECT *, t - vs AS rr, (vs + {RR_WINDOW - 1}) // {RR_WINDOW} * {RR_WINDOW} AS b FROM (SELECT *, lead(vs) OVER (PARTITION BY user_id, factor ORDER BY vs) AS t FROM peak) WHERE t - vs <= {6 * DAY}),
stats AS (SELECT user_id, factor, b, stddev_samp(rr) AS std, avg(rr) AS mean, count(*) AS n FROM rr GROUP BY ALL HAVING stddev_samp(rr) > 0.1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY round(std, 3), factor DESC) AS k, min(factor) OVER (PARTITION BY user_id, b) AS least FROM stats) WHERE k = 1 AND least = 1.02),
picked AS (SELECT rr.*, mean FROM rr JOIN best USING (user_id, factor, b)),
kept AS (SELECT user_id, vs AS p, b FROM picked WHERE abs(rr - mean) < greatest(mean * 0.3, 300) UNION SELECT user_id, max(t), b FROM picked GROUP BY user_id, b)
SELECT s.user_id, s.vs, least(s.vs + {HOUR}, b) AS ve, round(s.val, 4) AS val FROM kept JOIN sig s ON s.user_id = kept.user_id AND s.vs = kept.p WHERE p < b""")
def sig_peaks_rr(spark, d):
    out = W.peaks_rr(sig(spark, d), HOUR, RR_WINDOW, DAY, 0, 1e9, K, (1.02, 1.05, 1.10, 1.15), gap_tol=6 * DAY)
    return rounded(out, "val").select("user_id", "vs", "ve", "val")


NEXT = "(SELECT *, lead(event_type) OVER w AS t1, lead(event_type, 2) OVER w AS t2, lead(vs) OVER w AS v1, lead(vs, 2) OVER w AS v2, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY vs, event_id))"


def single(kind):
    return N.Pattern.single(lambda e, r: e["event_type"] == kind)


@query(f"""SELECT event_id, v.user_id, vs, t AS ve, r AS r_event_id FROM (SELECT v.event_id, v.user_id, v.vs, min(p.vs) AS t, arg_min(p.event_id, p.vs) AS r FROM vw v JOIN pu p ON v.user_id = p.user_id AND p.vs > v.vs GROUP BY ALL) v WHERE t - vs < {DAY}""")
def pat_followed_by_stream(spark, d):
    v, p = both(spark, d)
    return N.followed_by_stream(v, p, DAY, K)


@query(f"SELECT user_id, vs, v1 + 1 AS ve, '' AS register FROM {NEXT} WHERE event_type = 'view' AND t1 = 'purchase' AND v1 - vs < {DAY}")
def pat_list(spark, d):
    first = N.Pattern.list_of(lambda es, r: all(e["event_type"] == "view" for e in es))
    return N.detect(ev(spark, d).drop("cents"), first.then(single("purchase")).with_register(""), DAY, K, order=["event_id"])


@query(f"SELECT user_id, vs, v1 + 1 AS ve, cents AS register FROM {NEXT} WHERE cents > 8000 AND t1 = 'purchase' AND v1 - vs < {DAY}")
def pat_multi(spark, d):
    rich = N.Pattern.multi(0, lambda acc, e: acc + e["cents"], lambda acc, r: acc > 8000, lambda acc, r: int(acc))
    return N.detect(ev(spark, d), rich.then(single("purchase")).with_register(0), DAY, K, "bigint", order=["event_id"])


@query(f"SELECT user_id, vs, v1 + 1 AS ve, '' AS register FROM {NEXT} WHERE event_type IN ('view', 'click') AND t1 = 'purchase' AND v1 - vs < {DAY}")
def pat_or(spark, d):
    either = single("view").or_(single("click"))
    return N.detect(ev(spark, d).drop("cents"), either.then(single("purchase")).with_register(""), DAY, K, order=["event_id"])


@query(f"""SELECT user_id, vs, v1 + 1 AS ve, '' AS register FROM {NEXT} WHERE event_type = 'view' AND t1 = 'purchase' AND v1 - vs < {2 * DAY}
UNION ALL SELECT user_id, vs, v2 + 1, '' FROM {NEXT} WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase' AND v2 - vs < {2 * DAY}""")
def pat_optional(spark, d):
    p = single("view").then(single("click").optional()).then(single("purchase")).with_register("")
    return N.detect(ev(spark, d).drop("cents"), p, 2 * DAY, K, order=["event_id"])


def starred(least: int) -> str:
    """A view, ``least`` clicks or more, a purchase."""
    return f"""SELECT b.user_id, a.vs, b.vs + 1 AS ve, '' AS register FROM (SELECT *, max(CASE WHEN event_type <> 'click' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i FROM {NEXT}) b
JOIN {NEXT} a ON a.user_id = b.user_id AND a.n = b.i WHERE b.event_type = 'purchase' AND a.event_type = 'view' AND b.n - a.n > {least} AND b.vs - a.vs < {3 * DAY}"""


@query(starred(0))
def pat_star(spark, d):
    p = single("view").then(single("click").star()).then(single("purchase")).with_register("")
    return N.detect(ev(spark, d).drop("cents"), p, 3 * DAY, K, order=["event_id"])


@query(starred(1))
def pat_plus(spark, d):
    p = single("view").then(single("click").plus()).then(single("purchase")).with_register("")
    return N.detect(ev(spark, d).drop("cents"), p, 3 * DAY, K, order=["event_id"])


@query(f"SELECT user_id, vs, v1 + 1 AS ve, '' AS register FROM {NEXT} WHERE t1 = 'purchase' AND v1 - vs < {DAY}")
def pat_any(spark, d):
    arcs = (N.Arc(0, 1), N.Arc(1, 2, "epsilon"), N.Arc(2, 3, "single", lambda e, r: e["event_type"] == "purchase"))
    return N.detect(ev(spark, d).drop("cents"), N.Automaton(arcs, 0, frozenset({3}), ""), DAY, K, order=["event_id"])
