"""The corpus queries against plain versions, on the smallest tables and on a table of edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10
from pathlib import Path

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, htmltext, langid, media, neardup, packing, pst, qda, quality, simhash, substrings
from tidemark.llm.queries import QUERIES
from tidemark.plans.ship import ship

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
PASSAGE = "the quiet river runs below the old stone bridge and past the mill where nobody works any more"
EDGE = [
    (1, PASSAGE, "en", "a", 1), (2, PASSAGE, "en", "a", 1), (2, PASSAGE, "en", "a", 1), (3, f"Before. {PASSAGE} after it all. {PASSAGE}", None, None, None), (4, None, "en", "b", 0), (5, "", None, "b", 0),
    (6, " \n\t ", "de", None, 3), (7, LONG, "de", "c", 9), (8, LONG + " end", "de", "c", 9), (9, "É" * 70 + " 漢字 🙂  x", "fr", "c", 4), (10, "One\nOne\nTwo words\nTwo words", "fr", "c", 4),
    (11, "ab " * 400, "fr", "c", 4), (12, "a\x00b \x7f  c", None, "c", 4), (13, "1234 5678 !!!", "en", "c", 4), (14, "it's we'll  don't   STOP", "en", "c", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_bytes(t):
    return (t or "").encode()


def crc(x):
    return zlib.crc32(str(x).encode())


@pytest.fixture(scope="module")
def real(spark):
    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    ship(spark)
    # Columns of other names that operators use within, to see that they don't clash.
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({"piece": F.lit("p"), "token": F.lit(None).cast("int"), "fingerprint": F.lit(3), "score": F.lit("s")}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def both(f):
    return pytest.mark.parametrize("name", ["real", "edge"])(f)


def bag(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@both
def test_op2(name, request):
    df = request.getfixturevalue(name)
    seen, want = {}, []
    rows = sorted(texts(df), key=lambda r: r[0])
    for doc, t in rows:
        b = text_bytes(t)
        for i in range(len(b) - 49):
            seen.setdefault(b[i : i + 50], doc)
    for doc, t in rows:
        b = text_bytes(t)
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert bag(substrings.dedup_digests(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


@both
def test_op3(name, request):
    df = request.getfixturevalue(name)
    want = []
    for doc, t in texts(df):
        b = text_bytes(t)
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append((doc, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    out = media.document_media(df)
    assert bag(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want)
    stored = defaultdict(set)
    for r in out.collect():
        stored[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 and None not in next(iter(v)) for v in stored.values())


@both
def test_op4(name, request):
    df = request.getfixturevalue(name)
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.no_truncation()
    tok.no_padding()
    want = []
    for doc, t in texts(df):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert bag(bpe.encode_digests(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


@both
def test_op5(name, request):
    df = request.getfixturevalue(name)
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tok.no_truncation()
    tok.no_padding()
    want, total = [], 0
    for doc, t in texts(df):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for n, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want.append((doc, n, s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    out = packing.pack(df).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-total // 4096) * 1.05 + 1


def fingerprint(t):
    w = WORD.findall(text_bytes(t).translate(LOWER))
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@both
def test_op6(name, request):
    df = request.getfixturevalue(name)
    prints = [(doc, fingerprint(t)) for doc, t in texts(df)]
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[top(i)] = min(doc, least.get(top(i), doc))
    want = [(doc, f"{p:016x}", least[top(i)]) for i, (doc, p) in enumerate(prints)]
    assert bag(simhash.components(df), "doc_id", "fingerprint", "component_id") == sorted(want)


@both
def test_op8(name, request):
    df = request.getfixturevalue(name)
    want = []
    for doc, t in texts(df):
        w = WORD.findall(text_bytes(t))
        lines = [x for x in text_bytes(t).split(b"\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        chars = sum(len(x.decode()) for x in w)
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((doc, len(w), chars, len(re.findall(rb"[#*$%&|<>]", text_bytes(t))), len(lines) - len(set(lines)), len(hit), failed))
    out = quality.quality_rules(df)
    assert bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want)
    assert out.filter("base_failed and kept or kept is null").count() == 0


@both
def test_op9(name, request):
    df = request.getfixturevalue(name)
    docs = [(doc, [*WORD.findall(text_bytes(t).translate(LOWER)), None]) for doc, t in texts(df)]
    c = Counter(w for doc, ws in docs if crc(doc) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((doc, crc(doc) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for doc, ws in docs)
    out = pst.suffix_tree_scores(df).withColumn("base_score", F.round("base_score", 4))
    got = bag(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5] == pytest.approx(w[5], rel=1e-6, abs=1e-3) for g, w in zip(got, want))
    assert out.filter("score is null or isnan(score) or score > 0").count() == 0
    if name == "real":
        held = out.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
        assert held.s > held.b


def test_op1_held_out(spark):
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null and length(text) >= 100").select("doc_id", "lang")
    ship(spark)
    seen = got.join(docs, "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score").agg(F.avg("ok").alias("ok"), F.min("score").alias("low"), F.max("score").alias("top")).first()
    assert seen.ok > 0.9 and 0 <= seen.low <= seen.top <= 1


def test_op1_edge(edge):
    got = {r.doc_id: r for r in langid.language_id(edge).collect()}
    assert len(got) == len({r[0] for r in EDGE})
    assert all(got[i].lang_pred == "und" for i in (4, 5, 6, 13))
    assert all(r.held_out == (crc(i) % 4 == 2) for i, r in got.items())


def test_op7_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality_classifier"](spark, d)
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out and quality is not null").select("score", "quality", "predicted").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_op7_edge(spark, edge):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (99, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        got = qda.quality_scores(edge, labelled).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><div id="nav"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div>
<article><h1>A title &amp; more</h1><p>The first paragraph tells at some length what happened in the town on that day, and who had seen it.</p>
<p>The second   one goes on with what the people said &#8212; and what they did not say &mdash; for just as long a while.</p></article><div class="footer"><a href="/c">Contact</a> <a href="/p">Privacy</a></div></body></html>"""


def test_op10_edge(spark):
    ship(spark)
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p"), (None, "x", "plain")], "page_id long, url string, html string")
    got = htmltext.main_text(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    text = next(r.text for r in got if r.page_id == 1)
    assert "The second one goes on with what the people said — and what" in text
    assert not any(x in text for x in ("Home", "Privacy", "var a", "p{}"))
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]


def test_op10_whole_table(spark):
    got = QUERIES["op10_html_extraction"](spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert got.count() == pages.count()
    assert got.filter("text <> ''").count() > 0


@pytest.mark.parametrize("f", [substrings.dedup_digests, media.document_media, bpe.encode_digests, packing.pack, simhash.components, quality.quality_rules, pst.suffix_tree_scores, langid.language_id, neardup.keep_one, substrings.dedup])
def test_empty_tables(none, f):
    assert f(none).collect() == []


def test_near_duplicates_keep_one(spark, edge):
    kept = {r.doc_id for r in neardup.keep_one(edge).collect()}
    groups = [{1, 2}, {7, 8}]
    assert all(len(kept & g) == 1 for g in groups)
    assert {3, 9, 10, 14} <= kept


def test_stages_keep_columns(edge):
    for f in (langid.keep_identified, quality.keep_good, neardup.keep_one, substrings.dedup):
        assert f(edge).columns == edge.columns


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    out = corpus_pipeline.run(spark, SF)
    by = defaultdict(int)
    for r in out.collect():
        assert r.offset + r.length <= 4096
        by[r.sequence_id] += r.length
    assert by and max(by.values()) <= 4096
    assert not Path(SF, "_temporary").exists()
