"""Streams of interval relations against the batch operators, file by file, and policies on plain tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate as G
from tidemark.operators import join as J
from tidemark.operators import lifetime as L
from tidemark.operators import pattern as N
from tidemark.plans.ship import ship
from tidemark.sources import egress, ingress
from tidemark.streaming import relations as S
from tidemark.streaming import windows

SCHEMA = "k string, id bigint, vs bigint, ve bigint, v double, side string"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Rows in four files, each later than the one before, and a last one that moves the progress beyond all."""
    draw = random.Random(4)
    files = []
    for f in range(4):
        part = []
        for i in range(25):
            vs = 10_000 + 1000 * f + draw.randrange(0, 1000, 10)  # at 0 a row would be late from the start
            part.append((draw.choice("ab"), 100 * f + i, vs, vs + draw.choice([10, 40, 300, 1500]), float(draw.randrange(9)), draw.choice("lr")))
        files.append(part)
    files.append([(k, 900 + i, 90_000, 90_010, 0.0, s) for i, (k, s) in enumerate([("a", "l"), ("b", "l"), ("a", "r"), ("b", "r")])])
    files.append([(k, 990 + i, 190_000, 190_010, 0.0, "x") for i, k in enumerate("ab")])
    return files


@pytest.fixture
def source(spark, tmp_path, rows):
    ship(spark)
    for part in rows:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return S.with_event_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 1000)


@pytest.fixture
def plain(spark, rows):
    return spark.createDataFrame([r for part in rows for r in part], SCHEMA)


def finish(spark, df, tmp_path):
    q = windows.run_available(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(240) and q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def early(df):
    return df.filter("ve < 80000")


def side(df, s):
    return df.filter(F.col("side") == s)


def test_anti_join(spark, source, plain, tmp_path):
    out = finish(spark, S.anti_join(side(source, "l"), side(source, "r"), "k", ["id"]), tmp_path)
    want = J.anti_join(side(plain, "l").select("k", "vs", "ve", "id"), side(plain, "r").select("k", "vs", "ve"), ["k"])
    assert got(early(out)) == got(early(want))


def test_clip(spark, source, plain, tmp_path):
    out = finish(spark, S.clip_by(side(source, "l"), side(source, "r"), "k", ["id"]), tmp_path)
    want = L.clip_by(side(plain, "l").select("k", "vs", "ve", "id"), side(plain, "r").select("k", "vs", "ve"), ["k"])
    assert got(early(out)) == got(early(want))


def test_stitch(spark, source, plain, tmp_path):
    grid = lambda df: df.filter("ve - vs = 10 or ve - vs = 40").select("k", *(["at"] if "at" in df.columns else []), "vs", "ve")
    out = finish(spark, S.stitch(grid(source), "k"), tmp_path)
    assert got(early(out)) == got(early(L.stitch(grid(plain)).select("k", "vs", "ve")))


def test_sliding(spark, source, plain, tmp_path):
    out = finish(spark, S.sliding(source, "k", "v"), tmp_path)
    want = G.snapshot_sums(plain, {"sum": "v"}, ["k"])
    assert got(early(out)) == got(early(want.select("k", "vs", "ve", "count", "sum")))


def test_detect(spark, source, plain, tmp_path):
    pattern = N.Pattern.single(lambda e, r: e["v"] > 4).then(N.Pattern.single(lambda e, r: e["v"] < 4)).with_register("")
    out = finish(spark, S.detect(source, "k", pattern, 500), tmp_path)
    assert got(early(out)) == got(early(N.detect(plain.drop("side"), pattern, 500, ["k"])))


def test_keyed_progress(spark, tmp_path):
    for part in ([("a", 1, 100, 110, 0.0, "l"), ("b", 2, 10, 20, 0.0, "l")], [("a", 3, 40, 95, 0.0, "l"), ("b", 4, 40, 50, 0.0, "l"), ("a", 5, 95, 99, 0.0, "l")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.with_event_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 1000)
    out = finish(spark, S.keyed_progress(stream.select("k", "id", "vs", "ve", "at"), "k", 10, "adjust", idle=10_000), tmp_path)
    assert got(out.select("id", "vs", "late", "moved_by")) == [(1, 100, False, None), (2, 10, False, None), (3, 90, True, 50), (4, 40, False, None), (5, 95, False, None)]


def test_policies(spark):
    df = spark.createDataFrame([(0, 3, 9), (1, 12, 15), (2, 11, 40), (3, 27, 30), (4, 25, 26)], "i bigint, vs bigint, ve bigint")
    marks = ingress.punctuations(df, "i", 10)
    assert got(marks) == [(0, 0), (1, 10), (3, 20)]
    assert got(ingress.flushed(df, "i", marks).select("i", "flush")) == [(0, 1), (1, 3), (2, 3), (3, None), (4, None)]
    assert got(ingress.flushed(df, "i", marks, "on_batch", 2).select("i", "flush")) == [(0, 1), (1, 1), (2, 3), (3, 3), (4, 5)]
    assert [ingress.completed(df, 20, p).count() for p in ("none", "flush", "end_of_stream")] == [2, 3, 5]
    assert got(ingress.completed(df, 20, "flush").select("ve")) == [(15,), (20,), (9,)]
    routes = ingress.route(df, {"early": F.col("vs") < 12, "long": F.col("ve") - F.col("vs") > 2})
    assert {k: sorted(r.i for r in v.collect()) for k, v in routes.items()} == {"early": [0, 2], "long": [1, 3], "": [4]}
    p = df.select(F.col("i").cast("string").alias("p"), "vs", "ve")
    edges = egress.edges(p)
    assert egress.reshape(edges, ["p"]).count() == 10
    assert got(egress.reshape(edges, ["p"], "coalesce")) == got(p)
