"""Exact removal of repeated passages with suffix arrays.

Each byte covered by a 50-byte string that also starts in a document with a
smaller doc_id is removed. Finding these strings takes four steps.

1. Anchors: each window of 50 bytes has a least k-gram hash; windows in a row
   that share it form a piece, so equal windows lie in pieces with equal
   anchors. Entries hold the hashes of anchor and piece; a task sends one for
   each piece that it holds, that of its smallest document.
2. Where entries of an anchor meet, equal pieces become one: all windows of a
   piece are repeated in all but its smallest document. Pieces that differ
   under an anchor that two documents hold are requested.
3. The texts of requested pieces meet by anchor in shards. They are sorted by
   external induced sorting (see ``suffix``), which gives suffixes and common
   prefixes; runs of windows that share 50 bytes tell the smallest document of
   each window.
4. The repeated windows of a document meet its text, whose bytes they remove.

A passage or a text that a third of all documents hold is one entry a task in
the shuffle by anchors, and one piece in that to the shards. Pieces that stand
alone under their anchor, or that share no 34 bytes around it with another
piece, have no window in common with another and aren't sorted. Two different
pieces would have to agree in 96 bits of hashes to be taken for one.

Defined cases: a null text is empty and loses nothing; documents of one doc_id
never count against each other; repeated rows get equal results; matches never
cross documents; texts need not be valid in any language, only bytes count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, chunks, grow, own_name, shrink, utf8
from tidemark.llm.suffix import suffix_lcp

#: Length of the strings that count, and of the k-grams that anchor them.
LENGTH, GRAM = 50, 18
#: Bytes around an anchor that two windows around it share on one side at least.
SIDE = (LENGTH - GRAM) // 2
#: Bytes of text that a bucket of anchors and a shard of pieces stand for.
BUCKET_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
#: Parts that a shard is made of, so that shards are of even sizes.
PARTS = 16
#: Anchors that a task gathers before it sends them.
ANCHORS_AT_ONCE = 400_000
SALTS = 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
KEEP = np.uint64(16)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """48-bit hash of the GRAM bytes from each position."""
    with np.errstate(over="ignore"):
        powers, width, factor = {1: data.astype(np.uint64) + np.uint64(1)}, 1, {1: MULTIPLIER}
        while 2 * width <= GRAM:
            half = powers[width]
            powers[2 * width] = half[:-width] * factor[width] + half[width:]
            factor[2 * width] = factor[width] * factor[width]
            width *= 2
        out, have = powers[width], width
        while have < GRAM:
            step = 1 << ((GRAM - have).bit_length() - 1)
            more = powers[step][have:]
            n = min(len(out), len(more))
            out = out[:n] * factor[step] + more[:n]
            have += step
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (out ^ (out >> np.uint64(29))) >> KEEP


def pieces_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of a text of LENGTH bytes or more: hash, first window, number of windows in a row."""
    least, width, want = gram_hashes(data), 1, LENGTH - GRAM + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    start = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    return least[start], start, np.diff(np.append(start, len(least)))


POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER to the power -1, -2, ... and 0, 1, ...; n of each at least."""
    if not POWERS or len(POWERS[0]) < n:
        size = max(1 << 16, 2 * n)
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
            down = np.multiply.accumulate(np.full(size, inverse, np.uint64))
            up = np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, MULTIPLIER, np.uint64)))
        POWERS[:] = [down, up]
    return POWERS[0], POWERS[1]


def piece_hashes(data: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """48-bit hash of the bytes of each piece, wherever it stands."""
    down, up = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], dtype=np.uint64))
        end = start + windows + (LENGTH - 1)
        out = (sums[end] - sums[start]) * up[start] + windows.astype(np.uint64) * MULTIPLIER
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (out ^ (out >> np.uint64(29))) >> KEEP


ENTRY = (("hash", np.uint64), ("piece", np.uint64), ("doc", np.int64), ("text", np.int64), ("start", np.uint32), ("windows", np.uint32))
ENTRIES = "bucket int, known boolean, " + ", ".join(f"{n} binary" for n, _ in ENTRY)


def entry_rows(columns: list[np.ndarray], bucket: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
    """One row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = order[i:j]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[i])], pa.int32()), pa.array([known]), *[pa.array([shrink(c[at].astype(t))], pa.binary()) for c, (_, t) in zip(columns, ENTRY, strict=True)]],
            names=["bucket", "known", *[n for n, _ in ENTRY]],
        )


def leaders(h: np.ndarray, piece: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by anchor, piece and document; in it, whether a row's document is the smallest with the piece, and where pieces begin."""
    order = np.lexsort((doc, piece, h))
    h, piece, doc = h[order], piece[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (piece[1:] != piece[:-1])
    least = doc[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
    return order, doc == least, first


def anchor_sender(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        docs: list[int] = []
        texts: dict[bytes, int] = {}
        prints: list[int] = []
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            owner = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            h, piece, start, windows = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            doc, text = np.array(docs, np.int64)[owner], np.array(prints, np.int64)[owner]
            order, lead, _ = leaders(h, piece, doc)
            cols = [x[order] for x in (h, piece, doc, text, start, windows)]
            del owner, h, piece, start, windows, doc, text, order
            # A smaller document here holds the same piece: all its windows are repeated. The smallest goes on.
            yield from entry_rows([x[~lead] for x in cols], (cols[2][~lead] + cols[4][~lead]) % buckets, True)
            yield from entry_rows([x[lead] for x in cols], (cols[0][lead] % np.uint64(buckets)).astype(np.int64), False)

        for batch in chunks(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch), strict=True):
                if len(text) < LENGTH or doc is None:
                    continue
                key = hashlib.blake2b(text, digest_size=16).digest()
                if (known := texts.get(key)) is not None:
                    docs[known] = min(docs[known], doc)
                    continue
                texts[key] = len(docs)
                docs.append(doc)
                prints.append(text_print(text))
                data = np.frombuffer(text, np.uint8)
                h, start, windows = pieces_of(data)
                found.append((h, piece_hashes(data, start, windows), start.astype(np.uint32), windows.astype(np.uint32)))
                held += len(h)
            if held > ANCHORS_AT_ONCE:
                yield from send()
                found, docs, texts, prints, held = [], [], {}, [], 0
        if held:
            yield from send()

    return run


def text_print(text: bytes) -> int:
    """Spark's xxhash64 of the text."""
    x = xxhash.xxh64_intdigest(text, 42)
    return x - (1 << 64) if x >= 1 << 63 else x


FOUND = "doc_id long, text_print long, hash long, start int, windows int"


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows known to be repeated (hash is null), and requests for the pieces that differ under one anchor (hash is the anchor)."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def out(cols: list[np.ndarray], asked: bool) -> pa.RecordBatch:
        h, _, doc, text, start, windows = cols
        anchor = pa.array(h.astype(np.int64)) if asked else pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text), anchor, pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))], names=names)

    heard: list[list[np.ndarray]] = []
    for batch in batches:
        for row in batch.to_pylist():
            cols = [grow(row[n], t) for n, t in ENTRY]
            if row["known"]:
                yield out(cols, False)
            else:
                heard.append(cols)
    if not heard:
        return
    cols = [np.concatenate(x) for x in zip(*heard, strict=True)]
    del heard
    order, lead, first = leaders(cols[0], cols[1], cols[2])
    cols = [x[order] for x in cols]
    yield out([x[~lead] for x in cols], False)
    h, doc = cols[0], cols[2]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(head, append=len(h))
    several = (np.add.reduceat(first, head) > 1) & (np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head))
    ask = np.repeat(several, size) & lead
    yield out([x[ask] for x in cols], True)


PIECES = "part int, hash long, piece binary, doc_id long, text_print long, start int, windows int"


def piece_sender(parts: int):
    """Texts of requested pieces."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            wants = batch.column("wants")
            n = pc.list_value_length(wants).to_numpy()
            h, start, windows = (wants.flatten().field(i).to_numpy() for i in range(3))
            ends = start + windows + (LENGTH - 1)
            pieces, at = [], 0
            for text, k in zip(utf8(batch), n.tolist(), strict=True):
                pieces += [text[a:b] for a, b in zip(start[at : at + k].tolist(), ends[at : at + k].tolist(), strict=True)]
                at += k
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            cols = [pa.array((h % parts).astype(np.int32)), pa.array(h), pa.array(pieces, pa.binary()), batch.column("doc_id").take(owner), batch.column("text_print").take(owner), pa.array(start), pa.array(windows)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


SPANS = "doc_id long, text_print long, start int, windows int"


def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the pieces of a shard, as runs of their starts."""
    names = [x.split()[0] for x in SPANS.split(", ")]
    table = pa.Table.from_batches(kept) if (kept := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    h, doc, text, start, windows = (table.column(c).to_numpy() for c in ("hash", "doc_id", "text_print", "start", "windows"))
    coded = table.column("piece").combine_chunks().dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    n = len(distinct)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, code, doc)
    anchor = np.zeros(n, np.int64)
    anchor[code] = h
    later = doc != least[code]
    out = [(doc[later], text[later], start[later], windows[later])]
    lead = np.flatnonzero(~later)
    order = lead[np.argsort(code[lead], kind="stable")]
    first_of = np.searchsorted(code[order], np.arange(n + 1))
    chosen = np.flatnonzero(worth_sorting(distinct, anchor))
    if len(chosen):
        piece, offset, run = repeated_windows(distinct.take(pa.array(chosen)), least[chosen])
        piece = chosen[piece]
        times = first_of[piece + 1] - first_of[piece]
        at = order[np.repeat(first_of[piece] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        out.append((doc[at], text[at], start[at] + np.repeat(offset, times), np.repeat(run, times)))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], names=names)


def flat(pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces in a row, and their lengths."""
    lengths = pc.binary_length(pieces).to_numpy().astype(np.int64)
    return np.frombuffer(b"".join(pieces.to_pylist()), np.uint8), lengths


def worth_sorting(pieces: pa.BinaryArray, anchor: np.ndarray) -> np.ndarray:
    """Pieces that share bytes around their anchor with another distinct piece: SIDE to its left, or to its right.

    A window holds its anchor with SIDE bytes more on one side at least. A
    piece that holds its anchor twice is always worth it.
    """
    n = len(pieces)
    order = np.argsort(anchor, kind="stable")
    head = np.append(True, anchor[order][1:] != anchor[order][:-1])
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(head) - 1
    several = np.bincount(group)[group] > 1
    at = np.flatnonzero(several)
    if not len(at):
        return several
    data, lengths = flat(pieces.take(pa.array(at)))
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(at)), lengths)
    grams = gram_hashes(data)
    hit = np.flatnonzero((grams == anchor[at].astype(np.uint64)[owner[: len(grams)]]) & (owner[: len(grams)] == owner[GRAM - 1 :][: len(grams)]))
    times = np.bincount(owner[hit], minlength=len(at))
    place = np.zeros(len(at), np.int64)
    place[owner[hit][::-1]] = hit[::-1]
    sums = side_hashes(data)
    worth = times != 1
    span = GRAM + SIDE
    for inside, from_ in ((place - SIDE >= begin, place - SIDE), (place + span <= begin + lengths, place)):
        ok = np.flatnonzero(inside & (times == 1))
        key = sums[from_[ok]] ^ (group[at[ok]].astype(np.uint64) * MULTIPLIER)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        worth[ok[count[inverse] > 1]] = True
    # A piece with its anchor twice may match any piece of its group.
    odd = np.unique(group[at[times != 1]])
    worth |= np.isin(group[at], odd)
    out = np.zeros(n, bool)
    out[at[worth]] = True
    return out


def side_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM + SIDE bytes from each position, made of two overlapping or touching grams."""
    grams = gram_hashes(data)
    with np.errstate(over="ignore"):
        second = np.append(grams[SIDE:], np.zeros(min(SIDE, len(grams)), np.uint64))[: len(grams)]
        out = grams * MULTIPLIER + second
    return np.append(out, np.zeros(len(data) - len(out), np.uint64))


def repeated_windows(pieces: pa.BinaryArray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that also start in a document smaller than their piece's: piece, first window, number of windows in a row."""
    data, lengths = flat(pieces)
    total = len(data) + len(lengths)
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(total, np.int32)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    inside = np.arange(total, dtype=np.int32) - begin.astype(np.int32)[owner]
    text[inside < lengths[owner]] = data
    text[inside < lengths[owner]] += 1
    suffixes, lcp = suffix_lcp(text, 257)
    run = np.cumsum(lcp < LENGTH)
    of = owner[suffixes]
    whole = inside[suffixes] + LENGTH <= lengths[of]
    suffixes, run, of = suffixes[whole], run[whole], of[whole]
    if not len(run):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    smallest = np.repeat(np.minimum.reduceat(least[of], first), np.diff(np.append(first, len(run))))
    hit = np.sort(suffixes[smallest < least[of]])
    if not len(hit):
        return hit, hit, hit
    first = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1))
    return owner[hit[first]], inside[hit[first]], np.diff(np.append(first, len(hit)))


def remove(text: bytes, spans: list | None) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the bytes of its repeated windows (start, windows), and the maximal removed runs."""
    runs: list[tuple[int, int]] = []
    for start, windows in sorted((s["start"], s["windows"]) for s in spans or ()):
        end = min(start + windows + LENGTH - 1, len(text))
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    keep, at = [], 0
    for a, b in runs:
        keep.append(text[at:a])
        at = b
    return b"".join([*keep, text[at:]]), runs


def digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), utf8(batch), batch.column("spans").to_pylist(), strict=True):
            kept, runs = remove(text, spans)
            rows.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        types = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def keep_column(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    field = batch.schema.field(name)
    return batch.set_column(batch.schema.get_field_index(name), field, pa.array(values, field.type))


def cleaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept text in place of the text; bytes of a character cut in two are dropped. The last column has the spans."""
    for batch in chunks(batches):
        name = batch.schema.names[-1]
        texts = [None if t is None else remove(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True)]
        batch = keep_column(batch, "text", texts)
        if "n_chars" in batch.schema.names:
            batch = keep_column(batch, "n_chars", [None if t is None else len(t) for t in texts])
        yield batch.drop_columns([name])


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Repeated windows of ``docs`` (doc_id, text): doc_id, text_print and spans (start, windows) of each text that has any."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("text_print", F.xxhash64("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    # A text of more than one document is whole in all but the smallest; print and another hash tell texts apart.
    short = scratch.save(docs.select("doc_id", "text_print", F.xxhash64(F.lit("other"), "text").alias("other"), size.alias("n_bytes")).filter(f"n_bytes >= {LENGTH} and doc_id is not null"))
    total = short.agg(F.sum("n_bytes")).first()[0] or 0
    owners = short.groupBy("text_print", "other").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").drop("last")
    salted = owners.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    copies = (
        short.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["text_print", "other", "salt"]).filter("doc_id > owner")
        .select("doc_id", "text_print", F.lit(0).alias("start"), (F.col("n_bytes") - (LENGTH - 1)).cast("int").alias("windows"))
    )
    buckets, shards = int(total // BUCKET_BYTES) + 1, int(total // SHARD_BYTES) + 1
    entries = docs.select("doc_id", "text").mapInArrow(anchor_sender(buckets), ENTRIES)
    found = scratch.save(entries.repartition(buckets, "bucket").mapInArrow(judge, FOUND))
    del entries
    scratch.release()
    known = found.filter("hash is null").select("doc_id", "text_print", "start", "windows")
    wants = found.filter("hash is not null").groupBy("doc_id", "text_print").agg(F.collect_list(F.struct("hash", "start", "windows")).alias("wants"))
    # Repeated rows (same doc_id and text) send the same pieces, which are one in the shard.
    asked = docs.filter(size >= LENGTH).join(wants, ["doc_id", "text_print"]).select("doc_id", "text_print", "text", "wants")
    pieces = asked.mapInArrow(piece_sender(PARTS * shards), PIECES)
    spans = scratch.save(pieces.repartition(shards, "part").mapInArrow(sort_shard, SPANS).union(known).union(copies))
    del pieces, asked, wants, known
    scratch.drop(found, short)
    scratch.release()
    return spans.groupBy("doc_id", "text_print").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def with_spans(docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The documents with their repeated windows as column ``name``, a name that they don't have."""
    doc, text_print = own_name(docs, "span_doc"), own_name(docs, "span_print")
    spans = repeated_spans(docs, scratch).select(F.col("doc_id").alias(doc), F.col("text_print").alias(text_print), F.col("spans").alias(name))
    return docs.join(spans, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(text_print)), "left").drop(doc, text_print)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, and the digest of what is kept."""
    scratch = Scratch(docs.sparkSession)
    return with_spans(docs.select("doc_id", "text"), scratch, "spans").select("doc_id", "text", "spans").mapInArrow(digester, RESULT)


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages removed from their text (and n_chars, if there is one, to match); other columns stay as they are."""
    name = own_name(docs, "spans")
    marked = with_spans(docs, Scratch(docs.sparkSession), name).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{name}`"))
    return marked.mapInArrow(cleaner, docs.schema)
