"""Language identification by interpolated Kneser-Ney character models.

Each language has models of orders 1 to 4 over the characters of its words,
with word ends. All languages share sorted arrays of 64-bit n-gram hashes;
beside a hash stand the languages that have the n-gram, each with its
interpolated log probability, so one binary search serves all languages and
the arrays hold no more than the languages' own n-grams. The language with the
lowest cross entropy per character wins; a text whose cross entropy exceeds
the winner's calibrated limit is rejected.

Defined cases: a null text or one without a letter is ``und`` with score 0
and is not accepted. Without any labelled text all is ``und``. A language with
too few calibration texts has the limit of all languages' texts together;
without any calibration text at all nothing is rejected. Repeated rows get
equal results; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, chunks, held_out, keep_rows, segment_sums

ORDER = 4
#: Characters beyond which evidence no longer sharpens the score.
SCORE_CHARS = 40
#: Bound of the training sample: about so many documents of each language.
DOCS_PER_LANG = 600
CALIBRATION_PER_LANG = 200
#: Calibration texts of a language below which its limit is that of all together.
LEAST_TEXTS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean"


def clean(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all (context, symbol) windows of ORDER, oldest first, and the number of each word's windows."""
    pad = "\x02" * (ORDER - 1)
    joined = "".join([pad + w + "\x03" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(lengths + ORDER) - (lengths + ORDER)
    n = lengths + 1
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum())) + ORDER - 1
    return np.stack([codes[at - k] for k in range(ORDER - 1, -1, -1)], 1), n


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    with np.errstate(over="ignore"):
        key = np.full(len(grams), grams.shape[1], np.uint64)
        for j in range(grams.shape[1]):
            key = (key ^ (grams[:, j] + np.uint64(1))) * MULTIPLIER
            key ^= key >> np.uint64(29)
    return key


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in the sorted ``keys``; -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Sparse:
    """Sorted hashes; hash i has the entries ``start[i]`` to ``start[i + 1]``, each a language and a value."""

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(per: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        """From each language's hashes and values."""
        keys, value = (np.concatenate([x[i] for x in per]) for i in (0, 1))
        lang = np.repeat(np.arange(len(per), dtype=np.int16), [len(x[0]) for x in per])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return Sparse(keys[first], np.append(first, len(keys)), lang[order], value[order].astype(np.float32))

    def entries(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``wanted`` that are there, with language and value."""
        at = find(self.keys, wanted)
        rows = np.flatnonzero(at >= 0)
        begin = self.start[at[rows]]
        n = self.start[at[rows] + 1] - begin
        which = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(rows, n), self.lang[which], self.value[which]


@dataclass
class LanguageModel:
    langs: list[str]
    #: Per order from 1: log10 probabilities by n-gram, and log10 backoff weights by context (none for order 1).
    grams: list[Sparse]
    contexts: list[Sparse | None]
    #: log10 probability of an unseen symbol per language.
    unseen: np.ndarray
    #: Highest accepted cross entropy per language.
    limits: np.ndarray

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """Interpolated log10 P(last symbol | the others) for rows of code points, per language."""
        out = np.tile(self.unseen, (len(grams), 1))
        for k in range(1, grams.shape[1] + 1):
            part = grams[:, grams.shape[1] - k :]
            if k > 1:
                row, lang, weight = self.contexts[k - 1].entries(gram_keys(part[:, :-1]))
                out[row, lang] += weight
            row, lang, value = self.grams[k - 1].entries(gram_keys(part))
            out[row, lang] = value
        return out

    def word_figures(self, words: list[str]) -> dict[str, np.ndarray]:
        cleaned = [clean(w) for w in words]
        grams, n = windows(cleaned)
        _, first, again = np.unique(gram_keys(grams), return_index=True, return_inverse=True)
        lp = segment_sums(self.log_probs(grams[first])[again], n)
        letters = n - 1
        lp[letters == 0] = 0
        return {"lp": lp, "letters": letters, "symbols": np.where(letters > 0, n, 0)}


def fit(counts: dict[str, tuple[list[str], np.ndarray]]) -> LanguageModel:
    """Models from each language's distinct words and their counts."""
    langs = sorted(counts)
    per = []  # per language: list over orders of (grams, counts)
    for lang in langs:
        cleaned = [clean(w) for w in counts[lang][0]]
        grams, n = windows(cleaned)
        weight = np.repeat(np.asarray(counts[lang][1], np.float64), n)
        keep = np.repeat(np.array([bool(w) for w in cleaned]), n)
        grams, weight = grams[keep], weight[keep]
        orders = [None] * ORDER
        key, first, inverse = np.unique(gram_keys(grams), return_index=True, return_inverse=True)
        orders[ORDER - 1] = (grams[first], np.bincount(inverse, weight))
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
            g = orders[k][0][:, 1:]
            key, first, inverse = np.unique(gram_keys(g), return_index=True, return_inverse=True)
            orders[k - 1] = (g[first], np.bincount(inverse).astype(np.float64))
        per.append(orders)
    alphabet = len(np.unique(np.concatenate([o[0][0].ravel() for o in per]))) + 1
    probabilities, weights, unseen = [[] for _ in range(ORDER)], [[] for _ in range(ORDER)], []
    for orders in per:
        below = None  # sorted hashes and probabilities of the order below
        for k in range(1, ORDER + 1):
            g, c = orders[k - 1]
            keys = gram_keys(g)
            ctx_keys, ctx = np.unique(gram_keys(g[:, :-1]), return_inverse=True)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total, kinds = np.bincount(ctx, c), np.bincount(ctx)
            backoff = np.minimum(1, d * kinds / total)
            lower = 1 / alphabet if below is None else below[1][find(below[0], gram_keys(g[:, 1:]))]
            p = np.maximum(c - d, 0) / total[ctx] + backoff[ctx] * lower
            if k == 1:
                unseen.append(np.log10(backoff[0] / alphabet))
            order = np.argsort(keys)
            below = keys[order], p[order]
            probabilities[k - 1].append((keys, np.log10(p)))
            weights[k - 1].append((ctx_keys, np.log10(backoff)))
    return LanguageModel(langs, [Sparse.of(x) for x in probabilities], [Sparse.of(x) if k else None for k, x in enumerate(weights)], np.array(unseen), np.full(len(langs), np.inf))


def scorer(model: LanguageModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.word_figures) if model else None
        for batch in chunks(batches):
            rows = batch.num_rows
            flag = batch.column("held_out") if "held_out" in batch.schema.names else pa.array([False] * rows)
            best, score, entropy, ok = [None] * rows, np.zeros(rows), np.full(rows, np.nan), np.zeros(rows, bool)
            if memo is not None:
                memo.refresh()
                split = [(t or "").lower().split() for t in batch.column("text").to_pylist()]
                n = np.fromiter(map(len, split), np.int64, rows)
                index = memo.index([w for words in split for w in words])
                if len(index):
                    lp = segment_sums(memo.columns["lp"][index], n)
                    symbols = segment_sums(memo.columns["symbols"][index], n)
                    some = symbols > 0
                    ce = -lp / np.maximum(symbols, 1)[:, None]
                    win = ce.argmin(1)
                    lowest = ce.min(1)
                    gap = (ce - lowest[:, None]) * np.minimum(symbols, SCORE_CHARS)[:, None]
                    score = np.where(some, 1 / (10.0**-gap).sum(1), 0.0)
                    entropy = np.where(some, lowest, np.nan)
                    ok = some & (lowest <= model.limits[win])
                    best = [model.langs[w] if s else None for w, s in zip(win, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), flag, pa.array([b or "und" for b in best], pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(ok)],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return run


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    found: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(text.lower().split())
    for lang, words in found.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()), "word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})


def train(docs: DataFrame, may_learn: Column, docs_per_lang: int = DOCS_PER_LANG, calibration_per_lang: int = CALIBRATION_PER_LANG) -> LanguageModel | None:
    """Fit on about ``docs_per_lang`` documents of each language, chosen by a hash of doc_id; calibrate on others.

    ``docs`` has doc_id, text and lang; ``may_learn`` marks the rows that may be learnt from.
    """
    labelled = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    share = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(0.8, k / n))]), F.col("lang")), F.lit(0.0))
    rows = labelled.filter(draw < share(docs_per_lang)).mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, tuple[list[str], np.ndarray]] = {}
    langs = np.array(rows.column("lang").to_pylist())
    words, n = np.array(rows.column("word").to_pylist(), dtype=object), rows.column("n").to_numpy()
    for lang in sorted(set(langs)):
        of = langs == lang
        counts[lang] = (words[of].tolist(), n[of])
        if not any(clean(w) for w in counts[lang][0]):
            del counts[lang]
    if not counts:
        return None
    model = fit(counts)
    held = labelled.filter((draw >= 0.8) & (draw < 0.8 + F.least(F.lit(0.2), share(calibration_per_lang))))
    seen = held.select("doc_id", "text", F.lit(False).alias("held_out")).mapInArrow(scorer(model), SCHEMA).filter("cross_entropy is not null").select("lang_pred", "cross_entropy").toPandas()
    pooled = seen["cross_entropy"].to_numpy()
    for j, lang in enumerate(model.langs):
        ce = seen.loc[seen.lang_pred == lang, "cross_entropy"].to_numpy()
        if len(pooled):
            # Half the way from the calibrated upper tail to a uniform guess; clean texts lie far below it.
            high = np.quantile(ce if len(ce) >= LEAST_TEXTS else pooled, 0.99)
            model.limits[j] = high + 0.5 * max(0.0, -model.unseen[j] - high)
    return model


def identify(docs: DataFrame, model: LanguageModel | None, is_held_out: Column | None = None) -> DataFrame:
    """Predict every row of ``docs`` (doc_id, text). Narrow; the model is bounded by its sample."""
    flag = F.lit(False) if is_held_out is None else is_held_out
    return docs.select("doc_id", "text", flag.alias("held_out")).mapInArrow(scorer(model), SCHEMA)


def language_id(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Learn from rows whose crc32(doc_id) modulo ``modulus`` is not ``remainder``, predict all."""
    held = held_out(F.col("doc_id"), modulus, remainder)
    return identify(docs, train(docs.select("doc_id", "text", "lang"), ~held), held)


def keep_identified(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """The documents, with all their columns, whose language is identified and not rejected; learns like ``language_id``."""
    held = held_out(F.col("doc_id"), modulus, remainder)
    return keep_rows(docs, scorer(train(docs.select("doc_id", "text", "lang"), ~held)))
