"""Best-fit packing of token sequences by exact complements.

Pieces of documents are packed by their lengths alone: the counts of the
lengths (``capacity`` numbers at most, whatever the corpus) go to the driver,
which finds bin patterns. For the longest length, the gap it leaves is looked
up in indices of single lengths, pair sums and triple sums; a combination that
fills it exactly is consumed as often as the available counts allow. What
remains is packed best-fit by falling length. A pattern is a few ranges of
ranks, so pieces find their sequence and offset from their rank among the
pieces of their length.

Defined cases: a null or empty text is one piece that holds the end id alone;
repeated rows are packed as often as they occur; an empty table gives no rows;
ties of length are placed by doc_id, piece and digest; other columns are not
read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bpe import PairIndexBPE
from tidemark.llm.common import Scratch, chunks, release_memory, shrink_heaps, utf8

CAPACITY = 4096
END_ID = 1
CHUNK = 4 << 20
MEMO = 700_000
#: Ranks are counted within (length, salt). A salt holds about this many rows of a length, or so many more that there are about MOST_SALTS.
ROWS_PER_SALT, MOST_SALTS = 500, 100_000
#: Pre-tokenisation of the public word vocabulary (a fixed value).
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: Marks that are a pre-token of their own after letters.
MARKS = frozenset(bytes([c]) for c in b".,;:!?|)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def simple(text: str) -> bool:
    """One pre-token that stays as it is: lower-case letters, composed."""
    return text.isalpha() and text.islower() and unicodedata.is_normalized("NFC", text)


class WordLevel:
    """Texts to ids of the word vocabulary: white space dropped, NFC, lower case."""

    def __init__(self, path: str):
        self.bpe = PairIndexBPE(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.bpe.special)) + ")")
        self.memo: dict[bytes, bytes] = {}

    def parts(self, word: bytes) -> list[bytes | int]:
        """Pre-tokens of a word in UTF-8; an int is a special id."""
        text = word.decode("utf-8", "replace")
        out: list[bytes | int] = []
        for x in self.special.split(text):
            if x in self.bpe.special:
                out.append(self.bpe.special[x])
            else:
                out += [p.encode() for p in WORD_LEVEL.findall("".join([c.lower() for c in unicodedata.normalize("NFC", x)]))]
        return out

    def learn(self, new: list[bytes]) -> None:
        pieces: dict[bytes, int] = {}
        number = pieces.setdefault
        plain: list[tuple[bytes, int]] = []
        marked: list[tuple[bytes, int, int]] = []
        other: list[tuple[bytes, list[int]]] = []
        for w in new:
            if w.isalpha() and w.islower():  # ASCII letters
                plain.append((w, number(w, len(pieces))))
            elif (head := w[:-1]).isalpha() and w[-1:] in MARKS and head.islower():
                marked.append((w, number(head, len(pieces)), number(w[-1:], len(pieces))))
            elif simple(text := w.decode("utf-8", "replace")):
                plain.append((w, number(w, len(pieces))))
            elif w[-1:] in MARKS and simple(text[:-1]):
                marked.append((w, number(w[:-1], len(pieces)), number(w[-1:], len(pieces))))
            else:
                other.append((w, [p if type(p) is int else ~number(p, len(pieces)) for p in self.parts(w)]))
        ids, n = self.bpe.encode(list(pieces))
        data = ids.astype("<u4").tobytes()
        ends = (4 * np.cumsum(n)).tolist()
        begins = [0, *ends[:-1]]
        memo = self.memo
        for w, i in plain:
            memo[w] = data[begins[i] : ends[i]]
        for w, i, j in marked:
            memo[w] = data[begins[i] : ends[i]] + data[begins[j] : ends[j]]
        for w, own in other:
            memo[w] = b"".join([data[begins[~p] : ends[~p]] if p < 0 else p.to_bytes(4, "little") for p in own])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        rows = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.memo) > MEMO:  # start afresh with what this batch repeats
            repeated = Counter(w for row in rows for w in row)
            self.memo = {w: self.memo[w] for w, c in repeated.items() if c > 1 and w in self.memo}
        memo = self.memo
        if new := set(chain.from_iterable(rows)).difference(memo):
            self.learn(list(new))
        get = memo.__getitem__
        return [b"".join(map(get, row)) for row in rows]


@lru_cache(maxsize=1)
def word_level(path: str) -> WordLevel:
    """A worker's codec; its memo outlives a task."""
    return WordLevel(path)


def cutter(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_level(path)
        end = end_id.to_bytes(4, "little")
        for batch in chunks(batches, max_bytes=CHUNK):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), codec.encode(utf8(batch)), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, i, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)])) for i, a in enumerate(range(0, n, capacity))]
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


#: A pattern: its copies, and slots (length, how often in each copy).
Pattern = tuple[int, list[tuple[int, int]]]


class SumIndex:
    """Combinations of available lengths by their sum.

    Counts only fall, so a combination that isn't there any more never comes
    back: each sum has a cursor over its pairs, and one over its triples, which
    only moves on. All lookups together pass each combination once.
    """

    def __init__(self, have: list[int]):
        self.have = have
        self.small = [1] * len(have)
        self.third = list(range(-2, len(have) - 2))

    def pair(self, total: int, used: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """Two lengths, the larger as large as can be, besides those in ``used``."""
        have, a, passed = self.have, self.small[total], True
        while 2 * a <= total:
            b = total - a
            if have[a] and have[b] > (a == b):
                if passed:
                    self.small[total], passed = a, False
                if have[a] > used.count(a) and have[b] > used.count(b) + (a == b):
                    return b, a
            a += 1
        if passed:
            self.small[total] = a
        return None

    def triple(self, total: int, used: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Three lengths, the largest as large as can be, besides those in ``used``."""
        have, c, passed = self.have, self.third[total], True
        while 3 * c >= total and c > 0:
            if have[c] and self.pair(total - c):
                if passed:
                    self.third[total], passed = c, False
                if have[c] > used.count(c) and (two := self.pair(total - c, (*used, c))):
                    return c, *two
            c -= 1
        if passed:
            self.third[total] = c
        return None


def exact_patterns(have: np.ndarray, capacity: int) -> list[Pattern]:
    """Consume from ``have`` (counts by length) all that exact complements fill, longest first."""
    out: list[Pattern] = []
    left = have.tolist()
    sums = SumIndex(left)
    for longest in range(capacity, 0, -1):
        while left[longest]:
            gap = capacity - longest
            if gap == 0:
                found = (longest,)
            elif left[gap] > (gap == longest):
                found = (longest, gap)
            elif more := sums.pair(gap, (longest,)) or sums.triple(gap, (longest,)):
                found = (longest, *more)
            else:
                break
            kinds = sorted(set(found), reverse=True)
            times = min(left[x] // found.count(x) for x in kinds)
            for x in kinds:
                left[x] -= times * found.count(x)
            out.append((times, [(x, found.count(x)) for x in kinds]))
    have[:] = left
    return out


def residual_patterns(have: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit by falling length; equal bins are handled together."""
    open_bins: dict[int, list[Pattern]] = {}
    gaps: list[int] = []  # sorted gaps of open bins

    def put(gap: int, pattern: Pattern) -> None:
        import bisect

        if gap not in open_bins:
            open_bins[gap] = []
            bisect.insort(gaps, gap)
        open_bins[gap].append(pattern)

    import bisect

    for length in range(capacity, 0, -1):
        left = int(have[length])
        have[length] = 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if full := left // each:
                    put(capacity - each * length, (full, [(length, each)]))
                if rest := left - full * each:
                    put(capacity - rest * length, (1, [(length, rest)]))
                break
            gap = gaps[at]
            copies, slots = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(at)
            each = min(gap // length, left)
            times = min(copies, left // each)
            if times < copies:
                put(gap, (copies - times, slots))
            put(gap - each * length, (times, [*slots, (length, each)]))
            left -= times * each
    return [p for patterns in open_bins.values() for p in patterns]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Ranges of ranks: rows (length, first rank, how often in a copy, first sequence, offset), sorted; and the number of sequences."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for copies, slots in [*exact_patterns(have, capacity), *residual_patterns(have, capacity)]:
        offset = 0
        for length, times in slots:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += copies * times
            offset += length * times
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def placer(ranges: np.ndarray):
    key = ranges[:, 0] << 48 | ranges[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if word_level.cache_info().currsize:  # texts are read; the worker's words would lie beside the heap that ranks need
            word_level.cache_clear()
            release_memory()
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            _, first, times, sequence, offset = ranges[at].T
            nth = rank - first
            cols = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence + nth // np.maximum(times, 1)), pa.array(offset + nth % np.maximum(times, 1) * length)], names=[x.split()[0] for x in PIECES.split(", ")] + ["sequence_id", "offset"])

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (PIECES columns, read more than once) with sequence_id and offset.

    The ranks of a length are dealt over salts, so a length that a third of
    all rows share is counted by many tasks. The driver gets the counts of the
    lengths, ``capacity`` numbers at most; what comes before each salt is summed
    where the sizes of the salts are.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges, _ = plan(counts, capacity)
    each = max(ROWS_PER_SALT, sum(counts.values()) // MOST_SALTS)
    spark = pieces.sparkSession
    dealt = spark.createDataFrame([(length, n // each + 1) for length, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(dealt), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    window = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(window) - 1).join(starts, ["length", "salt"])
    names = [x.split()[0] for x in PIECES.split(", ")]
    return ranked.select(*names, (F.col("nth") + F.col("before")).cast("long").alias("rank")).mapInArrow(placer(ranges), PIECES + ", sequence_id long, offset long")


def vocabulary(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their sequence and offset.

    Texts are read once; the table of pieces (a few dozen bytes each) is
    written to the shared folder, so their ranks hold if an executor is lost.
    Heaps are shrunk before texts are read and before ranks are counted, as
    workers with their words live beside them.
    """
    scratch = Scratch(docs.sparkSession)
    shrink_heaps(docs.sparkSession)
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(cutter(vocabulary(path), capacity, end_id), PIECES))
    shrink_heaps(docs.sparkSession)
    return place(pieces, capacity)
