"""Sources, sinks and streams on small files written by the tests."""

import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators.frame import INF, Props, TemporalFrame
from tidemark.sources import egress, ingress, signals
from tidemark.streaming import stateful, windows


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_synthetic(spark):
    assert got(signals.synthetic(spark, 100, 1, 4)) == [(100, 350, 100.0), (350, 600, 350.0), (600, 850, 600.0), (850, 1100, 850.0)]


def test_csv_and_index(spark, tmp_path):
    hour = tmp_path / "2020" / "1" / "2" / "03"
    hour.mkdir(parents=True)
    (hour / "d1~ecg.csv").write_text("1,0.5\n2,1.5\n")
    (hour / "d2~abp.csv").write_text("7,3\n")
    assert got(signals.csv_signal(spark, str(tmp_path), "ecg")) == [("d1", "ecg", 1, INF, 0.5), ("d1", "ecg", 2, INF, 1.5)]
    raw = spark.read.schema(signals.SIGNAL).option("recursiveFileLookup", True).csv(str(tmp_path))
    parts = signals.with_file_parts(raw).select("device", "t_start", "t_end").distinct()
    assert got(parts) == [(d, 1577934000000, 1577937600000) for d in ("d1", "d2")]
    (tmp_path / "index").write_text("x,d1,5,9\n")
    assert got(signals.index_file(spark, str(tmp_path / "index"))) == [("d1", 5, 9)]


def test_binary(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"head" + b"".join(struct.pack(">Hiq", 65535 - i, -i, i << 40) for i in range(5)))
    df = signals.binary_records(spark, str(tmp_path), [("a", ">u2"), ("b", ">i4"), ("c", ">i8")], skip=4, glob="*.bin", chunk=2)
    assert got(df.drop("file")) == [(i, 65535 - i, -i, i << 40) for i in range(5)]
    (tmp_path / "b.bin").write_bytes(b"head!")
    with pytest.raises(Exception, match="not records"):
        signals.binary_records(spark, str(tmp_path), [("a", ">u2")], skip=4, glob="b.bin").collect()


def test_edges_round_trip(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 4, INF), (None, 1, 2)], "p string, vs bigint, ve bigint")
    e = egress.edges(df)
    assert e.count() == 7
    back = ingress.from_edges(e, "time", "is_end", ["p"])
    assert sorted(map(repr, back.select("p", "vs", "ve").collect())) == sorted(map(repr, spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("b", 4, INF), (None, 1, 2)], df.schema).collect()))
    assert got(egress.state_at(df)) == [("a",), ("b",)]
    assert got(egress.state_at(df, 2)) == [("a",), ("a",)]


def test_relation_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 5)], "p string, vs bigint, ve bigint")
    egress.write_relation(TemporalFrame(df, ("p",), Props(no_open_ends=True)), str(tmp_path / "r"))
    back = egress.read_relation(spark, str(tmp_path / "r"))
    assert back.keys == ("p",) and back.props == Props(no_open_ends=True) and got(back.df) == [("a", 1, 5)]


ARRIVALS = [(0, 10, 20), (1, 30, 40), (2, 25, 28), (3, 15, 26), (4, 5, 90), (5, 31, 33)]


def plain_disorder(policy, latency):
    top, out = None, []
    for i, vs, ve in ARRIVALS:
        late = top is not None and vs < top - latency
        if not late:
            out.append((i, vs, ve))
        elif policy == "adjust" and top - latency < ve:
            out.append((i, top - latency, ve))
        top = vs if top is None else max(top, vs)
    return out


@pytest.mark.parametrize("policy", ["drop", "adjust"])
@pytest.mark.parametrize("latency", [0, 5, 10, 100])
def test_disorder(spark, policy, latency):
    df = spark.createDataFrame(ARRIVALS, "i bigint, vs bigint, ve bigint")
    assert got(ingress.disorder(df, "i", policy, latency)) == plain_disorder(policy, latency)


def test_disorder_throw_and_audit(spark):
    df = spark.createDataFrame(ARRIVALS, "i bigint, vs bigint, ve bigint")
    assert got(ingress.disorder(df, "i", "throw", 100)) == ARRIVALS
    with pytest.raises(Exception, match="late row"):
        ingress.disorder(df, "i", "throw").collect()
    assert sorted(map(tuple, ingress.late_rows(df, "i", "adjust").collect()), key=str) == [(2, 25, 28, None), (3, 15, 26, None), (4, 5, 90, 25)]


def test_sequence_timeline(spark):
    df = spark.createDataFrame([(i * 7 % 101, f"r{i}") for i in range(50)], "o bigint, p string")
    want = [(o, p, n // 4, n // 4 + 1) for n, (o, p) in enumerate(sorted((i * 7 % 101, f"r{i}") for i in range(50)))]
    assert got(ingress.sequence_timeline(df, "o", 4, buckets=5)) == want


def stream(spark, tmp_path, rows):
    """A stream that takes one file at a time; every group of rows is a file."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "k string, t bigint, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, t bigint, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return s.withColumn("at", F.timestamp_millis("t"))


def finish(spark, query, path):
    assert query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(path)


def test_stream_windows(spark, tmp_path):
    s = windows.with_lateness(stream(spark, tmp_path, [[("a", 1000, 1.0), ("a", 1500, 2.0), ("b", 2500, 4.0)], [("a", 99000, 0.0)]]), "at", 0)
    aggregates = {"n": F.count("*"), "s": F.sum("v")}
    q = windows.run_available(windows.tumbling(s, "at", 1000, aggregates, ["k"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got(finish(spark, q, str(tmp_path / "out"))) == [("a", 1000, 2000, 1, 1.0), ("a", 2000, 3000, 1, 2.0), ("b", 3000, 4000, 1, 4.0)]
    q = windows.run_available(windows.session(s, "at", 700, aggregates, ["k"]), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert got(finish(spark, q, str(tmp_path / "out2"))) == [("a", 1000, 2200, 2, 3.0), ("b", 2500, 3200, 1, 4.0)]


def test_stream_pairs(spark, tmp_path):
    s = stream(spark, tmp_path, [[("a", 1, 1.0), ("b", 2, 2.0), ("a", 5, 3.0)], [("a", 9, 4.0), ("b", 3, 5.0)]])
    q = windows.run_available(stateful.pairs(s, "k", "t", "v"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got(finish(spark, q, str(tmp_path / "out"))) == [("a", 1, 5, 1.0, 3.0), ("a", 5, 9, 3.0, 4.0), ("b", 2, 3, 2.0, 5.0)]


def test_stream_join(spark, tmp_path):
    s = windows.with_lateness(stream(spark, tmp_path, [[("a", 1000, 1.0), ("a", 1500, 2.0), ("b", 1600, 3.0)], [("a", 4000, 5.0)]]), "at", 1000)
    out = windows.followed_within(s.filter("v = 1"), s.filter("v <> 1"), "at", "at", 2000, ["k"]).select("k", "t", "r_t")
    q = windows.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got(finish(spark, q, str(tmp_path / "out"))) == [("a", 1000, 1500)]


def test_stream_totals(spark, tmp_path):
    seen = []
    s = stream(spark, tmp_path, [[("a", 1, 1.0)], [("a", 2, 2.0), ("b", 2, 5.0)]])
    q = windows.run_batches(stateful.running_totals(s, "k", "v"), lambda df, i: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert ("a", 2, 3.0) in seen and ("b", 1, 5.0) in seen
