"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the words that training has at least ``CONTEXT_SCALE`` times the
square root of its N tokens of, one for all other words, the end of a text, and
its beginning. Contexts are the symbols before a token, up to ``DEPTH`` of them.
A context seen so often is retained if its next-symbol distribution diverges
from that of its suffix by more than the cost of the distribution; next symbols
count from ``NEXT_SCALE`` times that root. The longest retained suffix of what
precedes a token is its state; its distribution is smoothed by that of the
state's own suffix. A word that isn't frequent has its class's probability times
its add-one share of the class, for which its count in the whole training corpus
is looked up.

So the tree grows with the corpus, as its square root: at most sqrt(N) /
CONTEXT_SCALE contexts and sqrt(N) / NEXT_SCALE next-symbol entries a depth,
which is the bound of what the driver gathers and tasks are sent (at 5e9 tokens
1.4 and 14 million). The counts of all words grow in full: they are never
broadcast but travel by shuffle to the part of the documents that needs them.

Defined cases: a null or empty text is just an end; without any training text
every count is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, Scratch, chunks, held_out, release_memory, shrink, utf8
from tidemark.llm.common import grow as unshrink

CONTEXT_SCALE, NEXT_SCALE, DEPTH = 0.05, 0.005, 3
#: Odd multiplier of the codes of contexts, which are 64-bit hashes of their symbols.
MULTIPLIER = np.int64(0x5851F42D4C957F2D)
DISCOUNT = 0.5
#: Bytes of text of the parts that documents are dealt to for their words' counts.
PART_BYTES = 24 << 20
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def word_hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in found], np.uint64).view(np.int64)


def word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each part that a task holds: hash and count in training texts. Two words would have to share 64 bits to be one."""
    part, count = None, Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(count), part, np.int32)), pa.array(word_hashes(list(count))), pa.array(np.fromiter(count.values(), np.int64, len(count)))], names=["part", "word", "n"])

    for batch in batches:
        for p, held, text in zip(batch.column("part").to_pylist(), batch.column("held_out").to_pylist(), utf8(batch), strict=True):
            if p != part:
                if count:
                    yield out()
                part, count = p, Counter()
            found = words(text)
            if held:
                for w in found:
                    if w not in count:
                        count[w] = 0
            else:
                count.update(found)
    if count:
        yield out()


def extend(code: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Codes of contexts with one more symbol at their end, modulo 2**64."""
    return code * MULTIPLIER + (symbol + np.int64(1))


@dataclass
class Symbols:
    """Numbers: the frequent words in order of their hashes, then rare, end, begin."""

    hashes: np.ndarray
    rare: int = field(init=False)
    end: int = field(init=False)
    begin: int = field(init=False)
    base: int = field(init=False)

    def __post_init__(self):
        self.rare = len(self.hashes)
        self.end, self.begin, self.base = self.rare + 1, self.rare + 2, self.rare + 3

    def of(self, found: list[bytes]) -> dict[str, np.ndarray]:
        h = word_hashes(found)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        return {"symbol": np.where(hit, at, self.rare).astype(np.int32), "hash": h}

    def rows(self, split: list[list[bytes]], memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, each with begin and end; positions of the tokens; how many symbols of its text come before each; its text."""
        n = np.fromiter(map(len, split), np.int64, len(split))
        index = memo.index([w for row in split for w in row])
        size = n + 2
        begin = np.cumsum(size) - size
        out = np.full(int(size.sum()), self.begin, np.int32)
        out[begin + size - 1] = self.end
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(index)) + 2 * owner + 1
        if len(index):
            out[at] = memo.columns["symbol"][index]
        every = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(out)) - begin[every]
        tokens = np.flatnonzero(inside > 0)
        return out, tokens, inside[tokens], every[tokens]

    def context(self, row: np.ndarray, tokens: np.ndarray, depth: int) -> np.ndarray:
        """Code of the ``depth`` symbols before each token, oldest first."""
        code = np.zeros(len(tokens), np.int64)
        for k in range(depth, 0, -1):
            code = extend(code, row[tokens - k])
        return code


def symbol_rows(symbols: Symbols):
    """The symbols of all texts of a chunk in a row, each text with its begin and end, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(symbols.of)
        for batch in chunks(batches):
            memo.refresh()
            row = symbols.rows([words(t) for t in utf8(batch)], memo)[0]
            yield pa.RecordBatch.from_arrays([pa.array([shrink(row)], pa.binary())], names=["symbols"])

    return run


def fold(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)


def next_counter(symbols: Symbols, contexts: np.ndarray, depth: int):
    """Counts of (number of the context, next symbol) in rows of symbols, for the given sorted context codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        keys, counts, waiting = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            for data in batch.column("symbols").to_pylist():
                row = unshrink(data, np.int32)
                begin = np.flatnonzero(row == symbols.begin)
                inside = np.arange(len(row)) - np.repeat(begin, np.diff(begin, append=len(row)))
                tokens = np.flatnonzero(inside >= depth)
                code = symbols.context(row, tokens, depth)
                at = np.minimum(np.searchsorted(contexts, code), len(contexts) - 1)
                hit = contexts[at] == code
                key, n = np.unique(at[hit] * np.int64(symbols.base) + row[tokens[hit]], return_counts=True)
                keys.append(key)
                counts.append(n)
                waiting += len(key)
                if waiting > max(len(keys[0]), 1 << 18):
                    key, n = fold(keys, counts)
                    keys, counts, waiting = [key], [n], 0
        key, n = fold(keys, counts)
        for i in range(0, len(key), 1 << 18):
            at, nxt = np.divmod(key[i : i + (1 << 18)], symbols.base)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(nxt.astype(np.int32)), pa.array(n[i : i + (1 << 18)])], names=["context", "next", "n"])

    return run


@dataclass
class Tree:
    symbols: Symbols
    tokens: int
    kinds: int
    #: Count of each frequent word.
    counts: np.ndarray
    #: log10 probability of each symbol without context.
    root: np.ndarray
    #: Per depth from 1: sorted codes of the retained contexts, log10 weight of their suffix's distribution.
    codes: list[np.ndarray]
    weights: list[np.ndarray]
    #: Per depth: sorted (number of the context * base + symbol), log10 probability in full.
    entries: list[np.ndarray]
    probabilities: list[np.ndarray]

    def log_probs(self, row: np.ndarray, tokens: np.ndarray, inside: np.ndarray, depth: int | None = None) -> np.ndarray:
        """log10 P(symbol | longest retained suffix of at most ``depth`` symbols) for each token."""
        depth = len(self.codes) if depth is None else depth
        nxt = row[tokens]
        if depth == 0:
            return self.root[nxt]
        out = np.empty(len(tokens))
        rest = np.ones(len(tokens), bool)
        extra = np.zeros(len(tokens))
        codes = self.codes[depth - 1]
        if len(codes):
            far = np.flatnonzero(inside >= depth)
            code = self.symbols.context(row, tokens[far], depth)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            far, at = far[codes[at] == code], at[codes[at] == code]
            key = at.astype(np.int64) * self.symbols.base + nxt[far]
            entries = self.entries[depth - 1]
            e = np.minimum(np.searchsorted(entries, key), max(len(entries) - 1, 0))
            hit = entries[e] == key if len(entries) else np.zeros(len(key), bool)
            out[far[hit]] = self.probabilities[depth - 1][e[hit]]
            rest[far[hit]] = False
            extra[far[~hit]] = self.weights[depth - 1][at[~hit]]
        left = np.flatnonzero(rest)
        out[left] = extra[left] + self.log_probs(row, tokens[left], inside[left], depth - 1)
        return out


def grow(tree: Tree, codes: np.ndarray, members: np.ndarray, totals: np.ndarray, at: np.ndarray, nxt: np.ndarray, n: np.ndarray) -> None:
    """Add a depth: retain the contexts whose counts diverge from what their suffix says.

    ``codes`` (sorted), ``members`` (their symbols, a row each) and ``totals``
    are of the contexts, ``at``, ``nxt`` and ``n`` (sorted) of their next
    symbols. A context pays for its entries by log(total) / 2 each, the usual
    price of a parameter; its gain is total times the divergence.
    """
    size, depth = len(codes), members.shape[1]
    own = np.maximum(n - DISCOUNT, 0) / totals[at]
    weight = np.maximum(1 - np.bincount(at, own, size), 1e-12)
    row = np.concatenate([members[at, 1:], nxt[:, None]], 1).ravel()
    below = 10 ** tree.log_probs(row, np.arange(len(nxt)) * depth + depth - 1, np.full(len(nxt), depth - 1), depth - 1)
    p = own + weight[at] * below
    left = np.maximum(totals - np.bincount(at, n, size), 0)
    gain = np.bincount(at, n * np.log(p / below), size) + left * np.log(weight)
    entries = np.bincount(at, minlength=size)
    keep = (entries > 0) & (gain > 0.5 * (entries + 1) * np.log(totals + 1))
    number = np.cumsum(keep) - 1
    kept = keep[at]
    tree.codes.append(codes[keep])
    tree.weights.append(np.log10(weight[keep]))
    tree.entries.append(number[at[kept]] * tree.symbols.base + nxt[kept].astype(np.int64))
    tree.probabilities.append(np.log10(p[kept]))


def least_count(scale: float, tokens: int) -> int:
    return max(2, math.ceil(scale * math.sqrt(tokens)))


def columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table.column(name).to_numpy() for name in names]


def train(docs: DataFrame, scratch: Scratch, frequent: tuple[np.ndarray, np.ndarray], n_texts: int, tokens: int, kinds: int, least: int, least_next: int, max_depth: int) -> Tree:
    """The tree of the training texts ``docs`` (text). ``frequent``: hashes and counts of the frequent words."""
    order = np.argsort(frequent[0])
    symbols, counts = Symbols(frequent[0][order]), frequent[1][order]
    p = np.zeros(symbols.base)
    p[: symbols.rare] = (counts + 1) / (tokens + kinds + 1)
    p[symbols.end] = (n_texts + 1) / (tokens + kinds + 1)
    p[symbols.rare] = max(1 - p.sum(), 1e-12)
    p[symbols.begin] = 1e-12
    tree = Tree(symbols, tokens, kinds, counts, np.log10(p), [], [], [], [])
    members = np.concatenate([np.arange(symbols.rare), [symbols.rare, symbols.begin]]).astype(np.int32)[:, None]
    totals = np.concatenate([counts, [tokens - n_texts - counts.sum(), n_texts]])
    rows = scratch.save(docs.select("text").mapInArrow(symbol_rows(symbols), "symbols binary"))
    for depth in range(1, max_depth + 1):
        often = totals >= least
        members, totals = members[often], totals[often]
        if not len(totals):
            break
        codes = np.zeros(len(members), np.int64)
        for k in range(depth):
            codes = extend(codes, members[:, k])
        order = np.argsort(codes)
        codes, members, totals = codes[order], members[order], totals[order]
        counted = rows.mapInArrow(next_counter(symbols, codes, depth), "context int, next int, n long").groupBy("context", "next").agg(F.sum("n").alias("n"))
        at, nxt, n = columns(counted.filter(F.col("n") >= least_next), "context", "next", "n")
        order = np.lexsort((nxt, at))
        at, nxt, n = at[order].astype(np.int64), nxt[order], n[order]
        grow(tree, codes, members, totals, at, nxt, n)
        inner = nxt != symbols.end
        members, totals = np.concatenate([members[at[inner]], nxt[inner, None]], 1), n[inner]
    scratch.drop(rows)
    return tree


def scorer(tree: Tree, n_texts: int):
    """Rows sorted by part, those with counts (kind 0) before documents (kind 1)."""
    symbols, total = tree.symbols, tree.tokens + tree.kinds + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hashes, counts = None, [], []
        known = np.empty(0, np.int64), np.empty(0, np.int64)
        memo = None

        def figures(found: list[bytes]) -> dict[str, np.ndarray]:
            out = symbols.of(found)
            at = np.minimum(np.searchsorted(known[0], out["hash"]), max(len(known[0]) - 1, 0))
            hit = known[0][at] == out["hash"] if len(known[0]) else np.zeros(len(found), bool)
            c = np.where(hit, known[1][at] if len(known[1]) else 0, 0)
            return {"symbol": out["symbol"], "log": np.log10(c + 1.0), "known": (c > 0).astype(np.int32)}

        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            memo.refresh()
            split = [words(t) for t in utf8(batch)]
            row, tokens, inside, text = symbols.rows(split, memo)
            n = np.fromiter(map(len, split), np.int64, len(split))
            index = memo.index([w for x in split for w in x])
            log = memo.columns["log"][index] if len(index) else np.empty(0)
            hit = memo.columns["known"][index] if len(index) else np.empty(0, np.int32)
            rows = len(split)
            owner = np.repeat(np.arange(rows), n)
            base = np.bincount(owner, log, rows) + np.log10(n_texts + 1.0) - (n + 1) * np.log10(total)
            own = np.bincount(text, tree.log_probs(row, tokens, inside), rows)
            # A rare word's share of its class is its own add-one probability over the class's.
            inner = (memo.columns["symbol"][index] == symbols.rare) if len(index) else np.empty(0, bool)
            own += np.bincount(owner, np.where(inner, log - np.log10(total) - tree.root[symbols.rare], 0), rows)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(n + 1), pa.array(np.bincount(owner, hit, rows).astype(np.int64) + (n_texts > 0)), pa.array(np.full(rows, tree.tokens, np.int64)), pa.array(base), pa.array(own)],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )

        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if j <= i:
                    continue
                if parts[i] != part:
                    part, hashes, counts, memo = parts[i], [], [], None
                piece = batch.slice(i, j - i)
                if kinds[i] == 0:
                    hashes.append(piece.column("word").to_numpy())
                    counts.append(piece.column("n").to_numpy())
                    continue
                if memo is None:
                    h = np.concatenate([symbols.hashes, *hashes]) if hashes or len(symbols.hashes) else np.empty(0, np.int64)
                    c = np.concatenate([tree.counts, *counts]) if len(h) else np.empty(0, np.int64)
                    order = np.argsort(h)
                    known = h[order], c[order]
                    hashes, counts, memo = [], [], Memo(figures, 150_000)
                for x in chunks(iter([piece])):
                    yield score(x)

    return run


def suffix_tree_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, context_scale: float = CONTEXT_SCALE, next_scale: float = NEXT_SCALE, depth: int = DEPTH) -> DataFrame:
    """Score every document (doc_id, text) with a tree of those whose crc32(doc_id) modulo ``modulus`` is not ``remainder``."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    sums = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("texts")).first()
    n_texts, parts = sums["texts"] or 0, int((sums["bytes"] or 0) // PART_BYTES) + 1
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    own = scratch.save(dealt.select("part", "held_out", "text").repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(word_counter, "part int, word long, n long"))
    scratch.release()
    corpus = scratch.save(own.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))
    total = corpus.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    tokens, kinds = (total["n"] or 0) + n_texts, total["kinds"] + (n_texts > 0)
    least = least_count(context_scale, tokens)
    frequent = tuple(columns(corpus.filter(F.col("n") >= least), "word", "n"))
    tree = train(docs.filter("not held_out"), scratch, frequent, n_texts, tokens, kinds, least, least_count(next_scale, tokens), depth)
    counts = own.select("part", "word").join(corpus.filter(F.col("n") < least), "word").select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"), "word", "n")
    texts = dealt.select("part", F.lit(1).alias("kind"), "doc_id", "held_out", "text", F.lit(None).cast("long").alias("word"), F.lit(None).cast("long").alias("n"))
    both = counts.union(texts).repartitionById(parts, "part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(scorer(tree, n_texts), RESULT)
