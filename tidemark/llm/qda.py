"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a normal density over transformed statistics; its covariance is
shrunk towards the pooled one and towards a multiple of the identity. The
score is the posterior of label 1 from Mahalanobis log densities, by Cholesky
factors that are worked out once.

Defined cases: a null text counts as empty and is scored like any other.
With only one label, or none, in the training rows, every score is that
label's share (0.5 for none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, chunks, held_out, utf8
from tidemark.llm.textstats import CONTINUATION, SYMBOLS, WHITE, n_dup_lines, repeat_words

#: Bound of the training sample: labelled rows, those with the smallest hash of doc_id.
MAX_TRAIN_ROWS = 20_000
#: Shrinkage of a class covariance to the pooled one, and of that to a multiple of the identity.
TO_POOLED, TO_SPHERE = 0.15, 0.02
THRESHOLD = 0.3
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = b".,;:?'\"()-"
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def statistics(texts: list[bytes], memo: Memo) -> np.ndarray:
    """A row of transformed statistics per text."""
    split = [t.split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    index = memo.index([w for words in split for w in words])
    repeated = repeat_words(index, n)
    rows = []
    for text, words, again in zip(texts, split, repeated, strict=True):
        size = len(text)
        of = lambda drop: size - len(text.translate(None, drop))  # noqa: B023, E731
        some, k = max(size, 1), max(len(words), 1)
        lines = text.count(b"\n") + 1
        rows.append(
            (
                np.log1p(len(words)), np.log1p((size - of(WHITE)) / k), np.log(1e-3 + of(SYMBOLS) / some), np.log(1e-3 + of(UPPER) / some),
                np.log(1e-3 + of(DIGITS) / some), np.log(1e-3 + of(MARKS) / some), np.log(1e-3 + text.count(b"!") / some), np.log(1e-2 + of(CONTINUATION) / some),
                np.log(1e-2 + n_dup_lines(text) / lines), np.log(1e-2 + again / k), len(set(words)) / k, np.log1p(len(words) / lines),
                np.log(1e-2 + text.count(b"http") / k), np.log(1e-2 + text.count(b". ") / k),
            )
        )
    return np.array(rows, np.float64).reshape(len(rows), -1)


def no_figures(words: list) -> dict[str, np.ndarray]:
    return {}


@dataclass
class Discriminant:
    """Class densities; ``factors`` are the inverses of the Cholesky factors."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log_density = np.stack([o - 0.5 * np.square((z - m) @ f.T).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)])
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -500, 500)))


@dataclass
class Constant:
    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant | Constant:
    """x: rows of statistics; y: labels 0 and 1."""
    if len(set(y.tolist())) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    groups = [z[y == c] for c in (0, 1)]
    means = np.array([g.mean(0) for g in groups])
    covs = [np.cov(g.T, bias=True).reshape(z.shape[1], -1) for g in groups]
    pooled = sum(c * len(g) for c, g in zip(covs, groups, strict=True)) / len(z)
    factors, offsets = [], []
    for cov, group in zip(covs, groups, strict=True):
        cov = (1 - to_pooled) * cov + to_pooled * pooled
        cov = (1 - to_sphere) * cov + to_sphere * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(len(group) / len(z)) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, means, np.array(factors), np.array(offsets))


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo(no_figures)
    for batch in chunks(batches):
        memo.refresh()
        x = statistics(utf8(batch), memo)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "label": batch.column("label"), "x": pa.array(list(x), pa.list_(pa.float64()))})


def scorer(model: Discriminant | Constant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(no_figures)
        for batch in chunks(batches):
            memo.refresh()
            score = model.score(statistics(utf8(batch), memo))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = MAX_TRAIN_ROWS) -> Discriminant | Constant:
    """Fit on the labelled rows (doc_id, label) with the smallest hashes, ``max_rows`` at most.

    Which is the bound of what is broadcast and of what comes to the driver:
    one label per doc_id (the smallest, if labels repeat), and of repeated
    doc_ids the row with the least statistics.
    """
    chosen = (
        labels.filter(may_learn & F.col("label").isin(0, 1))
        .groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("row")).select("row.*").toArrow()
    y = rows.column("label").to_numpy()
    if not len(y):
        return fit(np.zeros((0, 1)), np.zeros(0, np.int32))
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(y), -1)
    order = np.lexsort(np.column_stack([x, y]).T)  # the same model whatever the order of the rows
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, label: str = "quality") -> DataFrame:
    """Score every document (doc_id, text); learn from labels whose crc32(doc_id) modulo ``modulus`` is not ``remainder``."""
    held = held_out(F.col("doc_id"), modulus, remainder)
    model = train(docs, labels.select("doc_id", F.col(label).alias("label")), ~held & F.col("doc_id").isNotNull())
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(scorer(model), SCHEMA)
