"""BPE encoding and decoding with a pair occurrence index.

All pieces of a batch are laid out as one array of symbols with links to the
left and right neighbour. An index maps each mergeable pair, by its rank, to
all its positions. Active ranks are taken in ascending order; every position
of the pair is merged at once (left to right where occurrences overlap), and
only the lists of the pairs that this creates are extended. A merge only ever
creates pairs of a higher rank, so the result is that of merging each piece by
itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import chunks

#: Byte-level pre-tokenisation of the public vocabulary (a fixed value).
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
SPLIT = regex.compile(r" (?![\s\p{White_Space}]|\Z)")
UNSURE = regex.compile(r" (?:[\s\p{White_Space}]|\Z)")
CHUNK = 4 << 20
MEMO = 400_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in set(plain):
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class PairIndexBPE:
    """Merges of a tokenizers JSON file, applied to many byte strings at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.width = max(vocab.values()) + 2
        keys = self.left * self.width + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        # Pairs of single bytes, which all positions start from, have a table of their own.
        self.base = int(max(self.first.max(), self.last.max())) + 1
        a, b = np.divmod(np.arange(self.base**2), self.base)
        self.base_ranks = self.rank_of(a, b).astype(np.int32)
        back = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes: dict[int, bytes] = {i: bytes(back[c] for c in t.removesuffix(suffix)) if suffix else bytes(back[c] for c in t) for t, i in vocab.items()}
        self.token_text = {i: str(i) for i in self.token_bytes}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it isn't mergeable (or a symbol is gone)."""
        key = a.astype(np.int64) * self.width + b
        key[(a < 0) | (b < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if not n:
            return np.empty(0, np.int64), lengths
        ends = np.cumsum(lengths)
        filled = lengths > 0
        sym = np.append(self.first[data], -1).astype(np.int32)
        sym[ends[filled] - 1] = self.last[data[ends[filled] - 1]]
        right, left = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        right[ends[filled] - 1] = n  # position n, also reached as -1, is nobody
        right[n] = n
        left[(ends - lengths)[filled]] = n
        beside = sym[right[:-1]]
        found = np.where(beside >= 0, self.base_ranks[sym[:-1] * self.base + np.maximum(beside, 0)], -1)
        at = np.flatnonzero(found >= 0).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                rank = int(ranks[i])
                if rank in index:
                    index[rank].append(positions[i:j])
                else:
                    index[rank] = [positions[i:j]]
                    heapq.heappush(active, rank)

        if len(at):
            note(at, found[at])
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            pos = np.sort(pos[(sym[pos] == a) & (sym[right[pos]] == b)])
            pos = pos[np.append(True, pos[1:] != pos[:-1])[: len(pos)]]
            if a == b and len(pos) > 1:  # runs of one symbol: every other position, from the left
                order = np.arange(len(pos))
                starts = np.append(True, right[pos[:-1]] != pos[1:])
                pos = pos[(order - np.maximum.accumulate(np.where(starts, order, 0))) % 2 == 0]
            if not len(pos):
                continue
            gone = right[pos]
            after = right[gone]
            sym[pos] = self.merged[rank]
            sym[gone] = -1
            right[pos] = after
            left[after] = pos
            near = np.concatenate([left[pos], pos])
            new = self.rank_of(sym[near], sym[right[near]])
            some = new >= 0
            if some.any():
                note(near[some], new[some])
        alive = sym[:n] >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        return sym[:n][alive], total[ends] - total[ends - lengths]

    def decode(self, ids) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])


class ByteLevel:
    """Whole texts to ids, with a memo of space-delimited stretches.

    A stretch starts with a space that no white space follows, so the
    pre-tokeniser never looks across its ends.
    """

    def __init__(self, path: str):
        self.bpe = PairIndexBPE(path)
        self.memo: dict = {}
        self.lossy: dict = {}
        specials = sorted(self.bpe.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.probe = specials

    def stretches(self, text: str) -> list:
        """Keys of stretches: a str had a space before it, a 1-tuple has none."""
        if not text:
            return []
        parts = SPLIT.split(text) if UNSURE.search(text) else text.split(" ")
        out: list = parts
        if parts[0] or len(parts) == 1:
            out[0] = (parts[0],)
        else:
            out = parts[1:]
        return out

    def keys(self, text: str) -> list:
        if self.special and any(s in text for s in self.probe):
            out: list = []
            for part in self.special.split(text):
                if part in self.bpe.special:
                    out.append((part, self.bpe.special[part]))
                else:
                    out += self.stretches(part)
            return out
        return self.stretches(text)

    def learn(self, keys: list[list]) -> None:
        """Put all new stretches of a batch into the memo, each as its ids joined by commas.

        Each is decoded again; those whose bytes differ are noted in ``lossy``.
        """
        if len(self.memo) > MEMO:  # start afresh with what this batch repeats
            repeated = Counter(k for row in keys for k in row)
            self.memo = {k: self.memo[k] for k, c in repeated.items() if c > 1 and k in self.memo}
            self.lossy = {k: v for k, v in self.lossy.items() if k in self.memo}
        memo = self.memo
        new = list({k for row in keys for k in row if k not in memo})
        if not new:
            return
        sources = [" " + k if type(k) is str else k[0] for k in new]
        pieces: dict[str, int] = {}
        number = lambda p: pieces.setdefault(p, len(pieces))
        of = [[] if type(k) is tuple and len(k) == 2 else [number(p) for p in BYTE_LEVEL.findall(s)] for k, s in zip(new, sources, strict=True)]
        ids, n = self.bpe.encode([p.encode() for p in pieces])
        ends = np.cumsum(n).tolist()
        begins = [0, *ends[:-1]]
        flat = ids.tolist()
        texts = list(map(self.bpe.token_text.__getitem__, flat))
        raw = list(map(self.bpe.token_bytes.__getitem__, flat))
        for k, source, own in zip(new, sources, of, strict=True):
            if len(own) == 1:
                i, j = begins[own[0]], ends[own[0]]
                memo[k], back = ",".join(texts[i:j]), b"".join(raw[i:j])
            elif own:
                memo[k] = ",".join([x for o in own for x in texts[begins[o] : ends[o]]])
                back = b"".join([x for o in own for x in raw[begins[o] : ends[o]]])
            else:
                memo[k], back = str(k[1]), self.bpe.decode([k[1]])
            if back != source.encode():
                self.lossy[k] = back

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        keys = [self.keys(t) for t in texts]
        self.learn(keys)
        n, ids, decoded = [], [], []
        get = self.memo.__getitem__
        for text, row in zip(texts, keys, strict=True):
            joined = ",".join(map(get, row))
            n.append(joined.count(",") + 1 if joined else 0)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            if self.lossy and any(k in self.lossy for k in row):
                back = b"".join([self.lossy.get(k) or (" " + k if type(k) is str else k[0]).encode() for k in row]).decode("utf-8", "replace")
            else:  # each stretch decoded to its own bytes, so the text did
                back = text
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
        return n, ids, decoded

    def encode(self, text: str) -> list[int]:
        keys = [self.keys(text)]
        self.learn(keys)
        return [int(i) for k in keys[0] for i in self.memo[k].split(",")]


@lru_cache(maxsize=1)
def byte_level(path: str) -> ByteLevel:
    """A worker's codec; its memo outlives a task."""
    return ByteLevel(path)


def digester(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_level(path)
        for batch in chunks(batches, max_bytes=CHUNK):
            n, ids, decoded = codec.digests([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_level(path)
        for batch in chunks(batches, max_bytes=CHUNK):
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBPE(path)
        for batch in batches:
            texts = [bpe.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def vocabulary(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row; a null or empty text has no ids. Narrow."""
    return docs.select("doc_id", "text").mapInArrow(encoder(vocabulary(path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text. Narrow."""
    return encoded.select("doc_id", "ids").mapInArrow(decoder(vocabulary(path)), "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the text decoded from them, per row; null is empty. Narrow: the vocabulary is read from its file in each worker."""
    return docs.select("doc_id", "text").mapInArrow(digester(vocabulary(path)), SCHEMA)
