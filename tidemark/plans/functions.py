"""Queries of the aggregate and text functions, and of aggregates at every instant."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import aggregates as A
from tidemark.functions import strings as S
from tidemark.operators import aggregate as G
from tidemark.operators.ranked import snapshot_ranked
from tidemark.plans.aggregates import SEGMENTS
from tidemark.plans.tables import DAY, ev, purchases, query, views

K = ["user_id"]
WINDOW = f"(vs + {DAY - 1}) // {DAY} * {DAY} AS vs, (vs + {DAY - 1}) // {DAY} * {DAY} + {DAY} AS ve"
SWEEP = "SELECT user_id, t AS vs, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS ve, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS n"


@query(f"""SELECT user_id, {WINDOW}, count(*) FILTER (cents > 5000) AS some, CAST(sum(cents * cents) AS BIGINT) AS squares, product(1 + cents % 2) AS prod, round(avg(cents * cents), 2) AS mean_square,
round(var_samp(cents), 2) AS var, round(stddev_pop(cents), 2) AS dev, round(avg(cents), 2) AS mean FROM ev GROUP BY ALL""")
def agg_statistics(spark, d):
    out = G.tumbling_aggregate(
        ev(spark, d), DAY,
        {
            "some": A.count_not_null(A.where(F.col("cents") > 5000, "cents")), "squares": A.sum_squares("cents"), "prod": A.product(F.col("cents") % 2 + 1), "mean_square": A.average_squares("cents"),
            "var": A.variance("cents"), "dev": A.population_standard_deviation("cents"), "score": A.standard_score("cents"),
        }, K,
    )
    return out.withColumn("mean", F.col("score.avg")).drop("score").withColumns({c: F.round(c, 2) for c in ("mean_square", "var", "dev", "mean")})


@query(f"""SELECT user_id, vs, ve, string_agg(CAST(cents AS VARCHAR), ',' ORDER BY cents) AS items, string_agg(cents || ':' || r, ',' ORDER BY cents DESC) FILTER (r <= 3) AS top FROM (
SELECT user_id, {WINDOW}, cents, rank() OVER (PARTITION BY user_id, (vs + {DAY - 1}) // {DAY} ORDER BY cents DESC) AS r FROM ev) GROUP BY ALL""")
def agg_lists(spark, d):
    out = G.tumbling_aggregate(ev(spark, d), DAY, {"items": A.sorted_list("cents"), "all": A.to_list("cents"), "top": A.top_k("cents", 3)}, K)
    same = F.array_sort("all") == F.col("items")
    top = F.array_join(F.transform("top", lambda r: F.concat_ws(":", r["value"], r["rank"])), ",")
    return out.select("user_id", "vs", "ve", F.when(same, F.array_join(F.col("items").cast("array<string>"), ",")).alias("items"), top.alias("top"))


@query("SELECT event_id, cents AS one, -1 AS none FROM ev")
def agg_single(spark, d):
    return ev(spark, d).groupBy("event_id").agg(A.single_or_default("cents").alias("one"), A.single_or_default(A.where(F.col("cents") < 0, "cents"), -1).cast("int").alias("none"))


@query("""SELECT user_id, CAST(max(cents) - min(cents) AS BIGINT) AS spread, CAST(sum(2 * cents) AS BIGINT) AS twice, CAST(sum(cents) + 1 AS BIGINT) AS more, CAST(NULL AS BIGINT) AS nothing, CAST(-5 AS BIGINT) AS stated,
min(cents) AS low, max(cents) AS high FROM ev GROUP BY user_id""")
def agg_combinators(spark, d):
    never = A.where(F.col("cents") < 0, "cents")
    both = A.joined({"low": A.min_("cents"), "high": A.max_("cents")})
    out = ev(spark, d).groupBy("user_id").agg(
        A.transform_input(lambda x: x * 2, A.sum_)("cents").alias("twice"), A.transform_output(A.sum_, lambda s: s + 1)("cents").alias("more"),
        A.null_when_empty(never, A.sum_(never)).alias("nothing"), A.default_when_empty(never, A.sum_(never), -5).cast("bigint").alias("stated"), both.alias("both"),
    )
    return out.select("user_id", (F.col("both.high") - F.col("both.low")).alias("spread"), "twice", "more", "nothing", "stated", "both.low", "both.high")


@query("SELECT user_id, CAST(max(cents) - min(cents) AS BIGINT) AS spread FROM ev GROUP BY user_id")
def agg_user_defined(spark, d):
    return ev(spark, d).groupBy("user_id").agg(A.user_aggregate(lambda x: int(x.max() - x.min()), "bigint")("cents").alias("spread"))


@query("""SELECT user_id, CAST(sum(cents * pow(2, k - 1)) % 1000003 AS BIGINT) AS result FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY vs DESC, event_id DESC) AS k FROM ev) WHERE k <= 20 GROUP BY user_id""")
def agg_folded(spark, d):
    from tidemark.operators import sequence as Q

    last = Q.take_last(ev(spark, d), 20, ["vs", "event_id"], K)
    result = A.folded("cents", F.lit(0).cast("bigint"), lambda a, x: a * 2 + x, lambda a: F.pmod(a, F.lit(1000003)), "vs")
    return last.groupBy("user_id").agg(result.alias("result"))


@query("""SELECT user_id, vs, coalesce(lead(vs) OVER (PARTITION BY user_id ORDER BY vs), 9223372036854775807) AS ve, n, total FROM (
SELECT DISTINCT user_id, vs, count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS total FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY vs))""")
def agg_start_edges(spark, d):
    return G.snapshot_start_edges(ev(spark, d), {"n": A.count(), "total": A.sum_("cents")}, K)


@query(f"""SELECT user_id, vs, ve, CAST(l AS BIGINT) AS left_count, CAST(r AS BIGINT) AS right_count, CASE WHEN l > 0 THEN CAST(lc AS BIGINT) END AS seen, CASE WHEN r > 0 THEN CAST(rc AS BIGINT) END AS bought FROM (
{SWEEP}, sum(l) OVER (PARTITION BY user_id ORDER BY t) AS l, sum(r) OVER (PARTITION BY user_id ORDER BY t) AS r, sum(lc) OVER (PARTITION BY user_id ORDER BY t) AS lc, sum(rc) OVER (PARTITION BY user_id ORDER BY t) AS rc
FROM (SELECT user_id, t, sum(l + r) AS n, sum(l) AS l, sum(r) AS r, sum(lc) AS lc, sum(rc) AS rc FROM (
SELECT user_id, vs AS t, 1 AS l, 0 AS r, cents AS lc, 0 AS rc FROM vw UNION ALL SELECT user_id, ve, -1, 0, -cents, 0 FROM vw UNION ALL
SELECT user_id, vs, 0, 1, 0, cents FROM pu UNION ALL SELECT user_id, ve, 0, -1, 0, -cents FROM pu) GROUP BY user_id, t)) WHERE n > 0""")
def agg_binary(spark, d):
    return G.binary_aggregate(views(spark, d), purchases(spark, d), {"seen": "cents"}, {"bought": "cents"}, K)


@query(f"""SELECT user_id, vs, ve, CAST(n AS BIGINT) AS count, CASE WHEN k > 0 THEN CAST(c AS BIGINT) END AS sum FROM ({SWEEP}, sum(k) OVER (PARTITION BY user_id ORDER BY t) AS k, sum(c) OVER (PARTITION BY user_id ORDER BY t) AS c
FROM (SELECT user_id, t, sum(n) AS n, sum(k) AS k, sum(c) AS c FROM (SELECT user_id, vs AS t, 1 AS n, cents % 2 AS k, cents * (cents % 2) AS c FROM ev
UNION ALL SELECT user_id, ve, -1, -(cents % 2), -cents * (cents % 2) FROM ev) GROUP BY user_id, t)) WHERE n > 0""")
def agg_snapshot_nulls(spark, d):
    odd = ev(spark, d).withColumn("cents", A.where(F.col("cents") % 2 == 1, "cents"))
    return G.snapshot_sums(odd, {"sum": "cents"}, K)


@query(f", {SEGMENTS} SELECT s AS vs, e AS ve, count(*) AS count, round(sum(cents / 8.0), 3) AS sum FROM seg JOIN ev ON ev.vs < e AND ev.ve > s GROUP BY s, e")
def agg_snapshot_double(spark, d):
    return G.snapshot_sums(ev(spark, d), {"sum": F.col("cents") / 8.0}).withColumn("sum", F.round("sum", 3))


@query(f", {SEGMENTS} SELECT s AS vs, e AS ve, max(cents) AS top, min(cents) AS low, count(cents) AS n FROM seg JOIN ev ON ev.vs < e AND ev.ve > s GROUP BY s, e")
def agg_snapshot_partials(spark, d):
    return G.snapshot_partials(ev(spark, d), {"top": ("max", "cents"), "low": ("min", "cents"), "n": ("count", "cents")})


@query(f", {SEGMENTS} SELECT s AS vs, e AS ve, round(quantile_cont(cents, 0.5), 2) AS middle, quantile_disc(cents, 0.6) AS d60 FROM seg JOIN ev ON ev.vs < e AND ev.ve > s GROUP BY s, e")
def agg_snapshot_percentiles(spark, d):
    return snapshot_ranked(ev(spark, d), "cents", {"middle": ("continuous", 0.5), "d60": ("discrete", 0.6)}).withColumn("middle", F.round("middle", 2))


@query(f""", {SEGMENTS} SELECT vs, ve, string_agg(cents || ':' || r, ',' ORDER BY cents DESC) AS top FROM (
SELECT s AS vs, e AS ve, cents, rank() OVER (PARTITION BY s ORDER BY cents DESC) AS r FROM seg JOIN ev ON ev.vs < e AND ev.ve > s) WHERE r <= 2 GROUP BY vs, ve""")
def agg_snapshot_topk(spark, d):
    out = snapshot_ranked(ev(spark, d), "cents", {"top": ("top", 2)})
    return out.withColumn("top", F.array_join(F.transform("top", lambda r: F.concat_ws(":", r["value"], r["rank"])), ","))


@query("""SELECT event_id, CAST(CASE WHEN instr(substring(event_type, 3), 'i') > 0 THEN instr(substring(event_type, 3), 'i') + 1 ELSE -1 END AS INT) AS after,
CAST(length(event_type) - instr(reverse(event_type), 'e') AS INT) * CAST(contains(event_type, 'e') AS INT) - CAST(NOT contains(event_type, 'e') AS INT) AS last_e,
array_to_string(string_split_regex(event_type, '[iu]'), '|') AS parts, reverse(event_type) AS back, length(event_type) % 2 = 0 AS even, event_type = 'view' AS is_view FROM ev""")
def str_places(spark, d):
    t = "event_type"
    return ev(spark, d).select(
        "event_id", S.index_of(t, "i", 2).alias("after"), S.last_index_of(t, "e").cast("int").alias("last_e"), F.array_join(S.split_any(t, "iu"), "|").alias("parts"),
        S.apply_string(t, lambda x: x[::-1]).alias("back"), S.apply_boolean(t, lambda x: len(x) % 2 == 0).alias("even"), S.equals(t, F.lit("view")).alias("is_view"),
    )


@query("SELECT event_id, upper(event_type) AS up, lower(upper(event_type)) AS low, substring(event_type, 1, 2) AS head FROM ev")
def str_case(spark, d):
    return ev(spark, d).select("event_id", S.upper("event_type").alias("up"), S.lower(S.upper("event_type")).alias("low"), S.substring("event_type", 0, 2).alias("head"))
