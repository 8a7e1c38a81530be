"""Cases of the reviews of round 2: large groups, ties and long lifetimes against plain loops."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate as G
from tidemark.operators import join as J
from tidemark.operators import ranked
from tidemark.operators import sequence as Q
from tidemark.operators.frame import INF
from tidemark.plans.registry import ORACLE_SQL, QUERIES
from tidemark.plans.ship import ship


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_switch_ends_by_time(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("b", 5, 3), ("b", 6, 5), ("c", 6, 4), ("c", 6, 6), ("d", 6, 7), ("d", 8, 8)], "s string, t bigint, i bigint")
    assert got(Q.switch(df, "s", "t", ["i"])) == [("a", 1, 1), ("b", 5, 3), ("d", 6, 7), ("d", 8, 8)]


@pytest.fixture(scope="module")
def lives():
    """Two keys (one null); equal times and values, nulls, lifetimes over all buckets, some open."""
    draw = random.Random(7)
    return [(draw.choice(["a", None]), vs := draw.randrange(2000), draw.choice([vs + 3, vs + 40, vs + 40, vs + 900, INF]), draw.choice([None, *range(12)])) for _ in range(600)]


def stretches(lives, key):
    own = [r for r in lives if r[0] == key]
    times = sorted({t for r in own for t in r[1:3]} | {INF})
    for a, b in zip(times, times[1:], strict=False):
        if alive := [r[3] for r in own if r[1] <= a < r[2]]:
            yield a, b, sorted(v for v in alive if v is not None)


def without_snapshot(monkeypatch):
    def deal(*a, **b):
        raise AssertionError("rows are dealt to every stretch that they are alive in")

    monkeypatch.setattr(G, "snapshot", deal)


def test_percentiles_are_swept(spark, lives, monkeypatch):
    without_snapshot(monkeypatch)
    monkeypatch.setattr(ranked, "LOAD", 4)
    ship(spark)
    df = spark.createDataFrame(lives, "k string, vs bigint, ve bigint, x bigint")
    out = got(ranked.snapshot_ranked(df, "x", {"m": ("continuous", 0.5), "d": ("discrete", 0.6)}, ["k"]))
    want = []
    for key in ("a", None):
        for a, b, v in stretches(lives, key):
            n = len(v)
            want.append((key, a, b, (v[(n - 1) // 2] + v[n // 2]) / 2 if n else None, v[-(-3 * n // 5) - 1] if n else None))
    assert out == sorted(want, key=repr)
    assert QUERIES["agg_snapshot_percentiles"](spark, "/root/testdata/sf0.001").columns == ["vs", "ve", "middle", "d60"]


def test_multiset_splits():
    draw, m, plain = random.Random(1), ranked.Multiset(), []
    for _ in range(300):
        v, n = draw.randrange(50), draw.choice([1, 2, 90])
        m.add(v, n)
        plain += [v] * n
    plain.sort()
    for v in range(0, 50, 3):
        m.remove(v, plain.count(v))
        plain = [x for x in plain if x != v]
    assert [m[i] for i in range(m.size)] == plain and m.from_value(20) == [x for x in plain if x >= 20][::-1] and len(m.blocks) > 1


def test_top_values_are_swept(spark, lives, monkeypatch):
    without_snapshot(monkeypatch)
    ship(spark)
    df = spark.createDataFrame(lives, "k string, vs bigint, ve bigint, x bigint")
    out = [(r.k, r.vs, r.ve, [tuple(x) for x in r.t]) for r in ranked.snapshot_ranked(df, "x", {"t": ("top", 3)}, ["k"]).collect()]
    want = []
    for key in ("a", None):
        for a, b, v in stretches(lives, key):
            want.append((key, a, b, [(x, r) for x in v[::-1] if (r := 1 + sum(y > x for y in v)) <= 3]))
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert QUERIES["agg_snapshot_topk"](spark, "/root/testdata/sf0.001").columns == ["vs", "ve", "top"]


@pytest.fixture(scope="module")
def two_sides():
    draw = random.Random(3)
    side = lambda n: [(i, draw.choice([None, *range(8)]), vs := draw.randrange(5000), draw.choice([vs + 1, vs + 20, vs + 30, vs + 45, vs + 3000, INF])) for i in range(n)]
    return side(130), side(110)


def pairs_of(left, right, less=False):
    return [(a[0], b[0], max(a[2], b[2]), min(a[3], b[3])) for a in left for b in right if a[2] < b[3] and b[2] < a[3] and (not less or (a[1] is not None and b[1] is not None and a[1] < b[1]))]


def frames(spark, two_sides):
    return [spark.createDataFrame(x, "i bigint, x bigint, vs bigint, ve bigint") for x in two_sides]


def test_join_without_keys_meets_at_the_later_start(spark, two_sides, monkeypatch):
    def both_spanned(*a, **b):
        raise AssertionError("both sides are dealt to all their buckets")

    monkeypatch.setattr(J, "overlapping", both_spanned)
    monkeypatch.setattr(J, "SPAN", 8)  # some are long
    out = J.join(*frames(spark, two_sides)).select("i", "r_i", "vs", "ve")
    assert got(out) == sorted(pairs_of(*two_sides), key=repr)


def test_open_rows_are_dealt_to_few_buckets(spark, monkeypatch):
    dealt, spanned = [], J.spanned
    monkeypatch.setattr(J, "spanned", lambda *a: dealt.append(spanned(*a)) or dealt[-1])
    left, right = (spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 7919).alias("vs"), F.lit(INF).alias("ve")) for n in (300, 200))
    assert J.join(left, right).count() == 60_000
    assert sum(x.count() for x in dealt) < 80 * 500  # 257 buckets a row before


def test_less_meets_the_greatest_alone(spark, two_sides, monkeypatch):
    left, right = two_sides
    ship(spark)
    joined, plain = [], J.join
    monkeypatch.setattr(J, "join", lambda *a, **b: joined.append(a) or plain(*a, **b))
    out = J.left_outer_join(*frames(spark, two_sides), less=("x", "x")).select("i", "r_i", "vs", "ve")
    want = []
    for i, x, vs, ve in left:
        times = sorted({vs, ve, *[t for r in right for t in r[2:4] if vs < t < ve]})
        for a, b in zip(times, times[1:], strict=False):
            if not any(x is not None and r[1] is not None and x < r[1] and r[2] <= a < r[3] for r in right):
                want.append((i, None, a, b))
    merged = []
    for w in want:
        if merged and merged[-1][0] == w[0] and merged[-1][3] == w[2]:
            merged[-1] = (w[0], None, merged[-1][2], w[3])
        else:
            merged.append(w)
    assert got(out) == sorted(merged + pairs_of(left, right, True), key=repr)
    assert "__most" in joined[1][1].columns


def test_theta_queries_name_their_columns(spark, monkeypatch):
    asked = []
    for f in ("anti_join", "left_outer_join"):
        monkeypatch.setattr(J, f, lambda left, *a, less=None, **b: asked.append(less) or left.withColumn("r_event_id", F.lit(1)))
    QUERIES["join_anti_theta"](spark, "/root/testdata/sf0.001")
    QUERIES["join_left_outer_theta"](spark, "/root/testdata/sf0.001")
    assert asked == [("cents", "cents")] * 2


def test_switch_matches_its_sql_without_times_and_users(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 11 = 3 OR user_id = 7 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 9 = 1 AND event_id > 20 THEN NULL ELSE user_id END AS user_id)
FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    duck.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = sorted(duck.execute(ORACLE_SQL["seq_switch"]).fetchall())
    assert any(u == 7 for _, u in want)
    assert got(QUERIES["seq_switch"](spark, str(tmp_path)).select("event_id", "user_id")) == sorted(want, key=repr)


def test_all_open_pairs_every_row(spark):
    sf = "/root/testdata/sf0.001"
    kinds = dict(spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect())
    assert QUERIES["join_all_open"](spark, sf).count() == kinds["view"] * kinds["purchase"]


def test_open_rows_meet_once_in_even_cells(spark, monkeypatch):
    monkeypatch.setattr(J, "SIDE", (20, 60))
    left = [(i, None if i % 50 == 7 else i * 7919 % 501, INF) for i in range(300)] + [(300, INF, INF)]
    right = [(i, None if i % 40 == 7 else i * 104_729 % 503, INF) for i in range(200)]
    ld, rd = (spark.createDataFrame(x, "i int, vs bigint, ve bigint") for x in (left, right))
    out = J.join(ld, rd)
    times = lambda *t: max((x for x in t if x is not None), default=None)
    assert got(out) == sorted(((i, times(a, b), INF, j) for i, a, _ in left if a != INF for j, b, _ in right), key=repr)
    tasks = [n for (n,) in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(tasks) > 12 and max(tasks) < 12_000  # of 60,000; by time the last buckets had most pairs, and small buckets were put into one task
    assert J.join(ld, rd.limit(0)).count() == 0
