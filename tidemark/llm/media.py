"""Interleaved sequences of text and media, resolved by digest.

HTML parsing yields the ordered items of a document: texts, and references to
media with their captions. A reference names its payload by digest; a join on
the digest resolves it, and items stay in their positions with their captions.
Payloads are stored as 8-bit grey PNG images, 64 samples wide, which is
lossless. The store is a table in the shared folder, written and read back
where its rows are: images are never shuffled. A task stores equal payloads
once; those of several tasks become one when their figures meet by digest.

Defined cases: null HTML has no items; a reference without a payload in the
store stays, unresolved (null columns); repeated rows keep their own items; a
null text is an empty payload, which is 64 zero bytes; an empty table has no
rows; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, chunks, utf8
from tidemark.llm.htmltext import INLINE, RAW, tags

WIDTH = 64
LEVEL = 4
#: Digests that a task remembers.
SEEN = 200_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # a fixed value of the format
SCHEME = "sha256:"
ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string>"
FIGURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
MEDIA = frozenset("img audio video source embed".split())


def payload(text: bytes) -> bytes:
    """The bytes, filled with zeros to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """A grey 8-bit PNG, WIDTH samples a row."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + png_chunk(b"IHDR", head) + png_chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + png_chunk(b"IEND", b"")


def decode(image: bytes) -> bytes:
    """The samples of an image made by ``encode``; checks every checksum."""
    if not image.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, data, width = len(SIGNATURE), [], 0
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Size, mean, deviation, entropy and commonest value of the samples."""
    n = len(samples)
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    p = counts / n
    mean = float((p * np.arange(256)).sum())
    deviation = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
    some = p[p > 0]
    return f"{WIDTH}x{n // WIDTH};mean={mean:.4f};std={deviation:.4f};bits={-(some * np.log2(some)).sum():.4f};mode={int(counts.argmax())}"


def items(page: str) -> list[dict]:
    """Texts and media references in page order. A caption is the figure's, else the alternative text."""
    out: list[dict] = []
    parts: list[str] = []
    caption: list[str] | None = None
    figure: list[int] = []
    in_figure, raw = False, 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "digest": None, "caption": None})

    for text, tag, close, attributes in tags(page):
        if text and not raw:
            (parts if caption is None else caption).append(text)
        if tag in RAW:
            raw = max(0, raw + (-1 if close else 1))
        elif tag == "figure":
            flush()
            in_figure, figure = not close, []
        elif tag == "figcaption":
            if not close:
                flush()
                caption = []
            elif caption is not None:
                said = " ".join(entities.unescape("".join(caption)).split())
                for i in figure:
                    out[i]["caption"] = said or out[i]["caption"]
                caption = None
        elif tag in MEDIA and not close:
            found = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
            source = found.get("src", "")
            if source:
                flush()
                if in_figure:
                    figure.append(len(out))
                out.append({"position": len(out), "kind": "media", "text": None, "digest": source.removeprefix(SCHEME), "caption": found.get("alt") or None})
        elif tag and tag not in INLINE:
            flush()
    flush()
    return out


def interleaver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    for batch in chunks(batches, "html"):
        rows = [items(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(rows, kind)], names=["id", "items"])


def interleave(pages: DataFrame) -> DataFrame:
    """id and ordered items of each page (id, html). Narrow."""
    return pages.select("id", "html").mapInArrow(interleaver, f"id long, items array<{ITEM}>")


def references(sequences: DataFrame) -> DataFrame:
    """A row for each media item: id, position, digest, caption."""
    return sequences.select("id", F.explode("items").alias("item")).filter("item.kind = 'media'").select("id", "item.position", "item.digest", "item.caption")


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """Join references with the store's row (one for each digest); positions and captions stay with them.

    A third of all references may name one payload: a plain left join, whose
    large partitions of references adaptive execution splits.
    """
    return refs.join(store, "digest", "left")


def store_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored form of each payload; a task stores equal ones once (as far back as ``SEEN`` payloads)."""
    seen: set[bytes] = set()
    for batch in chunks(batches):
        digests, images = [], []
        if len(seen) > SEEN:
            seen.clear()
        for text in utf8(batch):
            samples = payload(text)
            digest = hashlib.sha256(samples).digest()
            if digest not in seen:
                seen.add(digest)
                digests.append(digest.hex())
                images.append(encode(samples))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["digest", "media"])


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of each stored image, from its samples as read from the stored bytes."""
    for batch in chunks(batches, "media"):
        rows = []
        for digest, image in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
            samples = decode(image)
            rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
        if rows:
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in FIGURES.split(", ")])


def as_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page for each document that shows its payload, named by digest, with its size as caption."""
    for batch in chunks(batches):
        rows = [f'<figure><img src="{SCHEME}{hashlib.sha256(payload(t)).hexdigest()}"><figcaption>{len(t)}</figcaption></figure>' for t in utf8(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.string())], names=["id", "html"])


def stored_figures(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Write the payloads of ``texts`` (text) to the store, read them back, and give one row of figures for each digest.

    The figures of a digest that several tasks stored are equal; the least is taken, combined before the shuffle.
    """
    stored = scratch.save(texts.mapInArrow(store_media, "digest string, media binary"))
    names = [x.split()[0] for x in FIGURES.split(", ")][1:]
    figures = scratch.save(stored.mapInArrow(read_back, FIGURES).groupBy("digest").agg(F.min(F.struct(*names)).alias("own")).select("digest", "own.*"))
    scratch.drop(stored)
    return figures


def document_media(docs: DataFrame) -> DataFrame:
    """Store every text (doc_id, text) as media, refer to it from a sequence, resolve and read back."""
    texts = docs.select("doc_id", "text")
    figures = stored_figures(texts.select("text"), Scratch(docs.sparkSession))
    sequences = interleave(texts.mapInArrow(as_pages, "id long, html string"))
    return resolve(references(sequences), figures).select(
        F.col("id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
