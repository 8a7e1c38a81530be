"""SimHash near-duplicates with BK-trees.

A fingerprint bit is 1 if it is set in over half of the shingle hashes. Equal
fingerprints are one point. Points are dealt to shards so that any two within
the radius meet in one: the bits are cut into blocks, and of m blocks a pair
within radius r agrees in m - r at least, so each point goes to one shard for
each choice of m - r blocks. A shard is a BK-tree (children keyed by the
integer Hamming distance to their parent, small leaves), whose points follow
only the edges within the radius. A shard reports a spanning forest of its
links, not all pairs; components are joined by alternating stars.

The trees aren't broadcast: all together they hold the fingerprints of all
documents, which must not go through the driver, and no bound holds for them.
Each travels by shuffle to the task that searches it. A shard's key has as many
bits as keep a few thousand points of chance in it; a dense ball of near copies
has at most as many points as there are distinct fingerprints in it.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero, linked like any other; repeated doc_ids are rows of their
own and share the smallest doc_id that any of their fingerprints reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, chunks, utf8
from tidemark.llm.components import connected_components

BITS = 64
SEED = 42
LEAF = 8
#: Points of chance that a shard may hold before keys take one more block.
CROWD = 4096
SALTS = 16


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words (fewer words: of them all; none: nothing)."""
    split = text.lower().split()
    if not split:
        return []
    joined = b" ".join(split)
    digest = xxhash.xxh64_intdigest
    if len(split) <= words:
        return [digest(joined, SEED)]
    ends = list(accumulate([len(w) + 1 for w in split]))
    return [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The fingerprint of each consecutive run of hashes."""
    out = np.zeros(len(lengths), np.uint64)
    some = np.flatnonzero(lengths)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(lengths) - lengths)[some]
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        ones = 2 * counts > lengths[some][:, None]
        out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprinter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [shingle_hashes(t, words) for t in utf8(batch)]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            prints = majority_bits(np.array([h for row in rows for h in row], np.uint64), lengths)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


class BKTree:
    """Points (unsigned 64-bit, distinct) under the Hamming distance."""

    def __init__(self, points: np.ndarray, members: np.ndarray | None = None):
        self.points = points
        members = np.arange(len(points)) if members is None else members
        self.leaf = members if len(members) <= LEAF else None
        if self.leaf is None:
            self.pivot = int(members[0])
            rest = members[1:]
            distance = np.bitwise_count(points[rest] ^ points[self.pivot])
            self.children = {int(k): BKTree(points, rest[distance == k]) for k in np.unique(distance)}

    def search(self, queries: np.ndarray, wanted: np.ndarray, radius: int, visit) -> None:
        """``visit(query numbers, point numbers)`` for pairs within the radius; ``wanted`` numbers the queries."""
        if self.leaf is not None:
            near = np.bitwise_count(queries[wanted][:, None] ^ self.points[self.leaf][None, :]) <= radius
            q, p = np.nonzero(near)
            if len(q):
                visit(wanted[q], self.leaf[p])
            return
        distance = np.bitwise_count(queries[wanted] ^ self.points[self.pivot]).astype(np.int16)
        hit = wanted[distance <= radius]
        if len(hit):
            visit(hit, np.full(len(hit), self.pivot))
        for key, child in self.children.items():
            follow = wanted[np.abs(distance - key) <= radius]
            if len(follow):
                child.search(queries, follow, radius, visit)


class Forest:
    """Labels of the points of a shard, joined as links are found."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = self.label[a] != self.label[b]
        while differ.any():
            x, y = self.label[a[differ]], self.label[b[differ]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            to = np.arange(len(self.label))
            np.minimum.at(to, high, low)
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]
            differ = self.label[a] != self.label[b]


def shard_forest(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point, the number of the point that stands for its component in the shard."""
    forest = Forest(len(points))
    if len(points) > 1:
        tree, order = BKTree(points), np.arange(len(points))
        for start in range(0, len(points), 4096):
            tree.search(points, order[start : start + 4096], radius, forest.link)
    return forest.label


def shard_links(radius: int):
    """Tasks hold whole shards (columns choice, value, print): their spanning links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        choice, value, prints = (table.column(c).to_numpy() for c in ("choice", "value", "print"))
        order = np.lexsort((prints, value, choice))
        choice, value, prints = choice[order], value[order], prints[order].view(np.uint64)
        cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (value[1:] != value[:-1])) + 1
        bounds = np.concatenate([[0], cuts, [len(prints)]])
        a, b = [], []
        for i in np.flatnonzero(np.diff(bounds) > 1):
            points = prints[bounds[i] : bounds[i + 1]]
            label = shard_forest(points, radius)
            moved = label != np.arange(len(points))
            if moved.any():
                a.append(points[label[moved]])
                b.append(points[moved])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    return run


def block_masks(n_points: int, radius: int, bits: int = BITS, crowd: int = CROWD) -> list[int]:
    """Masks of the shard keys: every choice of m - radius out of m blocks, with m just large enough."""
    m = radius + 1
    while m < 2 * radius and n_points / 2 ** (bits * (m - radius) // m) > crowd:
        m += 1
    edges = [bits * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(x) for x in combinations(blocks, m - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def print_links(points: DataFrame, n_points: int, radius: int) -> DataFrame:
    """``points`` (print, distinct) to links (a, b) that span each component of prints within the radius."""
    masks = block_masks(n_points, radius)
    keys = F.explode(F.array([F.struct(F.lit(i).alias("choice"), F.col("print").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(masks)]))
    dealt = points.select("print", keys.alias("k")).select("k.choice", "k.value", "print").repartition("choice", "value")
    return dealt.mapInArrow(shard_links(radius), "a long, b long")


def components(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint and component_id.

    Texts are read once. The join that gives documents their component is
    salted, as a third of all documents may share a fingerprint, and it holds
    only prints that have two documents or a link.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(docs.select("doc_id", "text").mapInArrow(fingerprinter(words), "doc_id long, print long"))
    points = scratch.save(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(print_links(points.select("print"), points.count(), radius), scratch)
    linked = points.join(roots, points["print"] == roots["node"], "left").select("print", "first", "n", "root")
    whole = linked.filter("root is not null")
    smallest = whole.groupBy("root").agg(F.min("first").alias("component"))
    known = whole.join(smallest, "root").select("print", "component").union(linked.filter("root is null and n > 1").select("print", F.col("first").alias("component")))
    salted = known.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    rows = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["print", "salt"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id")
    )
