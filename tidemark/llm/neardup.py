"""One document of each group of near copies, by SimHash, BK-trees and shingle prefixes.

Near copies share 0.8 or more of their five-word shingles (Jaccard). Two steps
find their pairs, and each pair is compared exactly on its shingles; groups are
the components of the pairs that pass. The document with the smallest doc_id
stays.

The first step finds most links at two candidates a document. SimHash
fingerprints over distinct words are dealt to shards by samples of their bits,
``TABLES`` times over; a shard is a BK-tree that each of its points searches
within ``RADIUS`` bits. A point's candidates are its nearest neighbour and the
one with the smallest document, over all shards; a document's, the first one of
its own fingerprint too. This step alone misses pairs.

The second step misses none. Under one order of all shingles, rare before
common, two sets of similarity t share a shingle among the first
n - ceil(t n) + 1 of each. So all pairs that share such a shingle are
candidates, but for those whose sizes or places in the order exclude t, and
those that verified links have joined already. In each list of documents of a
shingle, all are compared with the document whose shingles are shared the most,
often the original of the copies; then every pair that is still not joined is
compared. On a group with verified links this is far less than all pairs; many
documents that share rare shingles without being similar cost all their pairs.

The sample of bits grows with the logarithm of the number of points. The order
only decides the cost: common shingles come from a sample of the documents.
Entries of the other ones, which are rare, travel once, as compressed arrays by
bucket, since most are those of one document alone and end there. Lists are
judged and their first documents chosen by aggregates and joins, which combine
before the shuffle and split where a shingle is hot.

Defined cases: texts that are equal up to white space and the case of A-Z are
copies, texts without words included; a null text is empty; a null doc_id is
never dropped nor does it drop others; repeated rows of one doc_id and text stay
together; a doc_id with several texts has the links of all of them; an empty
table stays empty.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, Scratch, chunks, grow, own_name, release_memory, shrink, splitmix, utf8
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import SEED, BKTree, majority_bits, signed

WORDS, SIMILARITY = 5, 0.8
TABLES, RADIUS = 12, 10
#: Points of chance in a shard.
CROWD = 64
#: Candidate pairs of one document above which its side of the join is salted.
BUSY, SALTS = 256, 16
#: Documents sampled for the order of shingles (or one of SAMPLE_SHARE), times a common shingle is seen there, and common shingles at most.
SAMPLE, SAMPLE_SHARE, COMMON, MAX_COMMON = 20_000, 16, 4, 200_000
#: Remainders that a sketch counts shingles by.
SKETCH = 256
#: A bitmap of documents has at most 2 to this number of bits (8 MB).
MOST_BITS = 26
#: Pairs that a list step holds before it hands them on.
PAIRS = 1 << 20
#: Texts that a task remembers having sent, entries that it gathers before it sends them, and bytes of text that a bucket of entries stands for.
SEEN, AT_ONCE, BUCKET_BYTES = 200_000, 400_000, 16 << 20
FACTOR = np.uint64(0x9FB21C651E98DF25)


def word_figures(words: list[bytes]) -> dict[str, np.ndarray]:
    digest = xxhash.xxh64_intdigest
    return {"hash": np.array([digest(w, SEED) for w in words], np.uint64)}


def hashed_words(split: list[list[bytes]], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and each text's number of words."""
    memo.refresh()
    n = np.fromiter(map(len, split), np.int64, len(split))
    index = memo.index([w for words in split for w in words])
    return (memo.columns["hash"][index] if len(index) else np.empty(0, np.uint64)), n


def small(owner: np.ndarray) -> np.ndarray:
    """In 16 bits if they fit, which NumPy sorts by radix."""
    return owner.astype(np.uint16) if len(owner) and owner.max() < 1 << 16 else owner


def distinct_in_rows(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each owner, owners in order."""
    order = np.argsort(values)
    order = order[np.argsort(small(owner[order]), kind="stable")]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def shingle_sets(hashes: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, all in a row, and their texts; a text of fewer words is one shingle."""
    owner = np.repeat(np.arange(len(n)), n)
    keys, owners = [], []
    with np.errstate(over="ignore"):
        if (m := len(hashes) - words + 1) > 0:
            key = np.zeros(m, np.uint64)
            for j in range(words):
                key = key * FACTOR + hashes[j : m + j]
            whole = owner[:m] == owner[words - 1 :]
            keys.append(splitmix(key[whole]))
            owners.append(owner[:m][whole])
        begin = np.cumsum(n) - n
        for i in np.flatnonzero((n > 0) & (n < words)):
            key = np.array([n[i]], np.uint64)
            for h in hashes[begin[i] : begin[i] + n[i]]:
                key = splitmix(key * FACTOR + h)
            keys.append(key)
            owners.append(np.array([i]))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return distinct_in_rows(np.concatenate(keys), np.concatenate(owners))


def printer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, 128-bit digest of the words in order, fingerprint over the distinct words."""
    memo = Memo(word_figures)
    for batch in chunks(batches):
        split = [t.lower().split() for t in utf8(batch)]
        digests = [xxhash.xxh128_digest(b" ".join(words)) for words in split]
        hashes, n = hashed_words(split, memo)
        hashes, owner = distinct_in_rows(hashes, np.repeat(np.arange(len(n)), n))
        prints = majority_bits(hashes, np.bincount(owner, minlength=len(n)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(prints.view(np.int64))], names=["doc_id", "digest", "print"])


def marks(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places of doc_ids in a bitmap."""
    return (splitmix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap that has the mark of every doc_id of ``rows``: ``bits`` of them, whatever the number of rows, combined in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = marks(batch.column("doc_id").to_numpy(), bits)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["map"])

    total = np.zeros(bits // 8, np.uint8)
    for row in rows.select("doc_id").coalesce(16).mapInArrow(run, "map binary").toLocalIterator():
        total |= np.frombuffer(zlib.decompress(row["map"]), np.uint8)
    return total


def shingles(words: int, wanted: np.ndarray):
    """Of the texts whose doc_id has its mark in the bitmap ``wanted``: number of distinct shingles, sketch, and the sorted shingles as bytes.

    The sketch counts the shingles of each of SKETCH remainders, up to 255.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_figures)
        bits = 8 * len(wanted)
        for batch in chunks(batches):
            at = marks(batch.column("doc_id").to_numpy(), bits)
            batch = batch.filter(pa.array((wanted[at >> 3] >> (at & 7) & 1).astype(bool)))
            rows = batch.num_rows
            keys, owner = shingle_sets(*hashed_words([t.lower().split() for t in utf8(batch)], memo), words)
            sketch = np.minimum(np.bincount(owner * SKETCH + (keys % np.uint64(SKETCH)).astype(np.int64), minlength=rows * SKETCH), 255).astype(np.uint8).tobytes()
            size = np.bincount(owner, minlength=rows)
            data = keys.tobytes()
            ends = (8 * np.cumsum(size)).tolist()
            sets = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]
            sketches = [sketch[i * SKETCH : (i + 1) * SKETCH] for i in range(rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int32)), pa.array(sketches, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "size", "sketch", "shingles"])

    return run


def possible(least: float):
    """Pairs (a, b) whose sizes (m, n) and sketches (x, y) don't exclude the similarity: two texts share no more shingles of a remainder than either has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("x", "y"))
            both = np.minimum(x, y)
            total = batch.column("m").to_numpy().astype(np.int64) + batch.column("n").to_numpy()
            shared = both.sum(1, dtype=np.int64)
            keep = (shared >= least * (total - shared) - 1e-6) | (both == 255).any(1)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(u), len(v)) + 1e-6 < least * max(len(u), len(v)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= least * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def samples(n_points: int, tables: int) -> list[int]:
    """Masks of the sampled bits of each table; the same in every run."""
    bits = max(8, int(np.ceil(np.log2(max(n_points, 2) / CROWD))))
    draw = random.Random(64)
    return [sum(1 << b for b in draw.sample(range(64), min(bits, 48))) for _ in range(tables)]


def candidates(radius: int):
    """Tasks hold whole shards (table, value, print, first): the nearest document and the smallest one within the radius of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        held = pa.Table.from_batches(rows)
        table, value, prints, first = (held.column(c).to_numpy() for c in ("table", "value", "print", "first"))
        order = np.lexsort((first, value, table))
        table, value, prints, first = table[order], value[order], prints[order].view(np.uint64), first[order]
        cuts = np.flatnonzero((table[1:] != table[:-1]) | (value[1:] != value[:-1])) + 1
        bounds = np.concatenate([[0], cuts, [len(prints)]])
        found = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i < 2:
                continue
            points = prints[i:j]
            nearest = np.full(j - i, np.iinfo(np.int64).max)  # distance * size + number
            lowest = np.arange(j - i)

            def visit(q: np.ndarray, p: np.ndarray) -> None:
                other = q != p
                q, p = q[other], p[other]
                distance = np.bitwise_count(points[q] ^ points[p]).astype(np.int64)  # noqa: B023
                np.minimum.at(nearest, q, distance * len(points) + p)  # noqa: B023
                np.minimum.at(lowest, q, p)  # noqa: B023

            tree, numbers = BKTree(points), np.arange(j - i)
            for start in range(0, j - i, 4096):
                tree.search(points, numbers[start : start + 4096], radius, visit)
            some = np.flatnonzero(nearest < np.iinfo(np.int64).max)
            distance, near = np.divmod(nearest[some], j - i)
            own = first[i:j]
            found.append(np.stack([own[some], distance, own[near], own[lowest[some]]]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found, axis=1)], names=["doc_id", "distance", "near", "low"])

    return run


def near_pairs(prints: DataFrame, scratch: Scratch, tables: int, radius: int) -> DataFrame:
    """Pairs (a, b) of documents of ``prints`` (doc_id, print), distinct texts, that the fingerprints suggest."""
    points = scratch.save(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    masks = samples(points.count(), tables)
    keys = F.explode(F.array([F.struct(F.lit(i).alias("table"), F.col("print").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(masks)]))
    dealt = points.select("print", "first", keys.alias("k")).select("k.table", "k.value", "print", "first").repartition("table", "value")
    found = dealt.mapInArrow(candidates(radius), "doc_id long, distance long, near long, low long")
    best = found.groupBy("doc_id").agg(F.min(F.struct("distance", "near"))["near"].alias("near"), F.min("low").alias("low"))
    pairs = best.select("doc_id", F.explode(F.array_distinct(F.array("near", "low"))).alias("other")).filter("doc_id <> other").select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"))
    same = prints.join(points, "print").filter("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    out = scratch.save(pairs.union(same).distinct())
    scratch.drop(points)
    return out


def met(pairs: DataFrame, sets: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``pairs`` (a, b) with columns of ``sets`` for both documents; ``columns``: name in ``sets`` -> names for a and for b. Documents of many pairs are salted."""
    busy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).filter(f"pairs > {BUSY}").select("a", F.lit(True).alias("busy"))
    left = pairs.join(busy, "a", "left").select("a", "b", F.when(F.col("busy"), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"))
    salts = F.when(F.col("busy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    x = sets.join(busy, sets["doc_id"] == busy["a"], "left").select(F.col("doc_id").alias("a"), *[F.col(c).alias(to) for c, (to, _) in columns.items()], F.explode(salts).alias("salt"))
    y = sets.select(F.col("doc_id").alias("b"), *[F.col(c).alias(to) for c, (_, to) in columns.items()])
    return left.join(y, "b").join(x, ["a", "salt"]).drop("salt")


def similar_pairs(pairs: DataFrame, docs: DataFrame, scratch: Scratch, words: int, similarity: float) -> DataFrame:
    """The rows of the saved table ``pairs`` (a, b) whose documents' shingles are similar, as a saved table.

    A bitmap of bounded size tells most texts that no pair names, so that
    neither their words are hashed nor their shingles sent; sketches tell most
    pairs that can't be similar, so that the shingles of few pairs meet.
    """
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    bits = 1 << min(MOST_BITS, max(10, (16 * pairs.count()).bit_length()))
    sets = scratch.save(docs.select("doc_id", "text").mapInArrow(shingles(words, bitmap(wanted, bits)), "doc_id long, size int, sketch binary, shingles binary"))
    near = met(pairs, sets, {"size": ("m", "n"), "sketch": ("x", "y")}).select("a", "b", "m", "n", "x", "y").mapInArrow(possible(similarity), "a long, b long")
    # A doc_id with several texts has the links of each; a repeated row only repeats a pair.
    near = scratch.save(near.distinct())
    out = scratch.save(met(near, sets, {"shingles": ("x", "y")}).select("a", "b", "x", "y").mapInArrow(similar(similarity), "a long, b long").distinct())
    scratch.drop(sets, near)
    return out


ENTRY = (("shingle", np.uint64), ("doc_id", np.int64), ("size", np.int32), ("place", np.int32))
BLOCKS = "bucket int, " + ", ".join(f"{n} binary" for n, _ in ENTRY)
POSTINGS = "shingle long, doc_id long, size int, place int"


def set_prefixes(words: int, similarity: float, common: np.ndarray, buckets: int):
    """The first shingles of each text, of which similar texts share one: shingle, doc_id, size of the set, place in the order.

    As compressed arrays by bucket, common shingles in bucket -1. A task sends equal texts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, waiting = Memo(word_figures), set(), []

        def send() -> Iterator[pa.RecordBatch]:
            held = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            waiting.clear()
            late = held.pop()
            bucket = np.where(late, -1, (held[0] % np.uint64(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = order[i:j][np.argsort(held[0][order[i:j]])]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[i])], pa.int32()), *[pa.array([shrink(x[at])], pa.binary()) for x in held]], names=["bucket", *[n for n, _ in ENTRY]])

        for batch in chunks(batches):
            if len(seen) > SEEN:
                seen.clear()
            texts, docs = [], []
            for t, doc in zip(utf8(batch), batch.column("doc_id").cast(pa.int64()).to_pylist(), strict=True):
                if (key := xxhash.xxh128_digest(t)) not in seen:
                    seen.add(key)
                    texts.append(t.lower().split())
                    docs.append(doc)
            keys, owner = shingle_sets(*hashed_words(texts, memo), words)
            late = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys if len(common) else np.zeros(len(keys), bool)
            order = np.argsort(small(2 * owner + late), kind="stable")
            keys, owner, late = keys[order], owner[order], late[order]
            size = np.bincount(owner, minlength=len(texts))
            place = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
            first = place < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[owner]
            keys, owner, late, place = keys[first], owner[first], late[first], place[first]
            if len(keys):
                waiting.append((keys, np.array(docs, np.int64)[owner], size[owner].astype(np.int32), place.astype(np.int32), late))
            if sum(len(x[0]) for x in waiting) > AT_ONCE:
                yield from send()
        if waiting:
            yield from send()

    return run


def unpacked(batches: Iterator[pa.RecordBatch], shared: bool) -> Iterator[pa.RecordBatch]:
    """The entries of blocks; ``shared``: tasks hold whole buckets, and only entries of shingles that several documents have are given."""
    release_memory()
    names = [n for n, _ in ENTRY]
    heard: list[list[np.ndarray]] = []
    for batch in batches:
        for row in batch.to_pylist():
            cols = [grow(row[n], kind) for n, kind in ENTRY]
            if shared:
                heard.append(cols)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cols[0].view(np.int64), *cols[1:])], names=names)
    if heard:
        cols = [np.concatenate(x) for x in zip(*heard, strict=True)]
        del heard
        order = np.argsort(cols[0], kind="stable")
        cols = [x[order] for x in cols]
        head = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
        several = np.minimum.reduceat(cols[1], head) != np.maximum.reduceat(cols[1], head)
        keep = np.repeat(several, np.diff(np.append(head, len(order))))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (cols[0].view(np.int64), *cols[1:])], names=names)


def shared_entries(docs: DataFrame, scratch: Scratch, words: int, similarity: float) -> DataFrame:
    """POSTINGS of all shingles that similar texts may meet in and that several documents have, or that are common."""
    sums = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    buckets = int((sums["bytes"] or 0) // BUCKET_BYTES) + 1
    blocks = scratch.save(docs.mapInArrow(set_prefixes(words, similarity, common_shingles(docs, sums["n"], words), buckets), BLOCKS))
    common = blocks.filter("bucket < 0").mapInArrow(lambda batches: unpacked(batches, False), POSTINGS)
    rare = blocks.filter("bucket >= 0").repartition(buckets, "bucket").mapInArrow(lambda batches: unpacked(batches, True), POSTINGS)
    out = scratch.save(rare.union(common))
    scratch.drop(blocks)
    return out


def common_shingles(texts: DataFrame, n_texts: int, words: int) -> np.ndarray:
    """Shingles that a sample of the texts holds often, a bounded number; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_figures)
        for batch in chunks(batches):
            keys, _ = shingle_sets(*hashed_words([t.lower().split() for t in utf8(batch)], memo), words)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["shingle"])

    share = max(1, min(SAMPLE_SHARE, n_texts // SAMPLE))
    counted = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text").mapInArrow(run, "shingle long").groupBy("shingle").count()
    rows = counted.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MAX_COMMON).select("shingle").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def mixed_lists(postings: DataFrame) -> DataFrame:
    """The rows (shingle, doc_id, root, size, place) of the lists whose documents have several roots."""
    several = postings.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    return postings.join(several, "shingle")


def with_roots(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (doc_id and others) with the root of their document, which is itself where no link is known."""
    return rows.join(groups.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


def hub_pairs(mixed: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the document that shares the largest part of its shingles with each other one of its lists."""
    # The part of a document's first shingles that no other group shares, in thousandths.
    alone = mixed.groupBy("doc_id").agg((1000 - F.count(F.lit(1)) * 1000 / F.max("size")).cast("int").alias("alone"))
    row = F.struct("doc_id", "root", "size", "place")
    hubs = mixed.join(alone, "doc_id").groupBy("shingle").agg(F.min_by(row, F.struct("alone", "doc_id")).alias("hub"))
    most = F.least(F.col("size") - F.col("place"), F.col("hub.size") - F.col("hub.place"))
    possible = (F.col("root") != F.col("hub.root")) & (most + 1e-6 >= similarity * (F.col("size") + F.col("hub.size") - most))
    met = mixed.join(hubs, "shingle").filter(possible)
    return met.select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct()


def all_pairs(similarity: float):
    """Tasks hold whole lists: all pairs of several roots that could reach the similarity if their shingle is the first that they share, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        shingle, doc, root, size, place = (table.column(c).to_numpy() for c in ("shingle", "doc_id", "root", "size", "place"))
        order = np.lexsort((doc, size, shingle))
        shingle, doc, root, size, place = (x[order] for x in (shingle, doc, root, size, place))
        size, place = size.astype(np.int64), place.astype(np.int64)
        ends = np.searchsorted(shingle, shingle, "right")
        for start in range(0, len(ends), PAIRS):
            i = np.arange(start, min(start + PAIRS, len(ends)))
            step = 1
            # Sizes rise along a list: beyond the first row that is too large, all are.
            while len(i := i[i + step < ends[i]]) and len(i := i[size[i] + 1e-6 >= similarity * size[i + step]]):
                j = i + step
                most = np.minimum(size[i] - place[i], size[j] - place[j])
                good = (root[i] != root[j]) & (most + 1e-6 >= similarity * (size[i] + size[j] - most))
                if good.any():
                    a, b = np.unique(np.sort(np.stack([doc[i[good]], doc[j[good]]]), axis=0), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                step += 1

    return run


def similar_links(docs: DataFrame, owners: DataFrame, prints: DataFrame, scratch: Scratch, words: int, similarity: float, tables: int, radius: int) -> DataFrame:
    """Pairs (a, b) that join all similar documents of ``prints`` (doc_id, print), distinct texts. ``owners`` (doc_id, owner) names the one of ``prints`` that has a document's text."""
    pairs = near_pairs(prints, scratch, tables, radius)
    links = similar_pairs(pairs, docs, scratch, words, similarity)
    scratch.drop(pairs)
    scratch.release()
    entries = shared_entries(docs, scratch, words, similarity)
    shared = entries.join(owners, "doc_id").select("shingle", F.col("owner").alias("doc_id"), "size", "place").distinct()
    groups = connected_components(links, scratch)
    rooted = scratch.save(with_roots(shared, groups))
    scratch.drop(entries)
    mixed = scratch.save(mixed_lists(rooted))
    scratch.drop(rooted)
    scratch.release()
    hubs = scratch.save(hub_pairs(mixed, similarity))
    links = scratch.save(links.union(similar_pairs(hubs, docs, scratch, words, similarity)))
    scratch.drop(hubs)
    left = mixed_lists(with_roots(mixed.drop("root"), connected_components(links, scratch)))
    rest = scratch.save(left.repartition("shingle").mapInArrow(all_pairs(similarity), "a long, b long").distinct())
    scratch.drop(mixed)
    scratch.release()
    return scratch.save(links.union(similar_pairs(rest, docs, scratch, words, similarity)))


def dropped(docs: DataFrame, scratch: Scratch, words: int = WORDS, similarity: float = SIMILARITY, tables: int = TABLES, radius: int = RADIUS) -> DataFrame:
    """doc_id of every document that has a copy or a near copy of smaller doc_id in its group."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save(docs.mapInArrow(printer, "doc_id long, digest binary, print long"))
    texts = scratch.save(rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.first("print").alias("print"), F.max("doc_id").alias("last")))
    # A text may be that of a third of all documents: its row is salted if several have it.
    many = texts.select("digest", "owner", F.explode(F.when(F.col("owner") < F.col("last"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), (F.col("owner") < F.col("last")).alias("several"))
    single = rows.join(many.filter("not several").drop("salt"), "digest").select("doc_id", "owner")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(many.filter("several"), ["digest", "salt"]).select("doc_id", "owner")
    owners = scratch.save(single.union(salted).distinct())
    scratch.drop(rows)
    prints = texts.select(F.col("owner").alias("doc_id"), "print")
    pairs = similar_links(docs, owners, prints, scratch, words, similarity, tables, radius)
    groups = connected_components(pairs, scratch)
    return owners.filter("owner < doc_id").select("doc_id").union(groups.filter("node <> root").select(F.col("node").alias("doc_id"))).distinct()


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those that have a copy or near copy of smaller doc_id; all columns stay."""
    scratch = Scratch(docs.sparkSession)
    gone = scratch.save(dropped(docs.select("doc_id", "text"), scratch, words, similarity))
    scratch.release()
    other = own_name(docs, "gone_id")
    gone = gone.withColumnRenamed("doc_id", other)
    return docs.join(gone, F.col("doc_id") == F.col(other), "left_anti")
