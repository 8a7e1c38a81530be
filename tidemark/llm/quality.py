"""Quality rules by tokeniser fertility.

Public vocabularies, applied to every word, tell how well a text resembles
the prose they were made from: characters per token of two vocabularies, and for
one of them the share of tokens that are byte fallbacks and the entropy of
the token distribution. Texts outside the fixed bands of their script are
rejected, and so are those far from the corpus' own distribution: quartiles of
all documents that pass the base rules, by language (column ``lang``) and
script, or by script where a language has under ``LEAST`` such documents or is
null. A text may differ from the median by ``SPREAD`` quartile ranges, and by
more, with the root of its length, if it is shorter than the median.

Defined cases: a null or empty text has no word, fails the base rules and is
not kept; equal texts of one ``lang`` get equal rows; rows are never merged; a
table without ``lang`` is judged by script, and by the fixed bands alone where
a script has too few documents; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import Memo, Scratch, chunks, segment_sums, utf8
from tidemark.llm.textstats import n_dup_lines, n_symbols, repeat_words, word_chars


@dataclass(frozen=True)
class Band:
    """Limits for a script: characters per token, byte-fallback share, entropy in bits (for texts of 50 tokens or more)."""

    chars_low: float
    chars_high: float
    fallback_high: float
    entropy_low: float


#: Rejection bands by script; characters per token of piece_bpe_32k.
BANDS = {
    "latin": Band(1.25, 6.0, 0.05, 2.5),
    "cyrillic": Band(1.0, 6.0, 0.05, 3.0),
    "greek": Band(0.6, 6.0, 0.30, 3.0),
    "cjk": Band(0.3, 3.0, 0.60, 3.0),
    "other": Band(0.2, 6.0, 0.90, 2.0),
}
#: Vocabularies beside the first, whose characters per token count too.
OTHERS = ("byte_bpe_50k.json",)
#: Quartile ranges around the median, documents that quartiles need, and the least range as a share of the median.
SPREAD, LEAST, NARROW = 3.0, 50, 0.01
#: Figures with quartiles; entropy has no upper limit.
JUDGED = ("chars_per_token", *(f"other_{i}" for i in range(len(OTHERS))), "token_entropy")
#: Script ranges of code points (fixed values); the first that fits counts.
SCRIPTS = (("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))), ("greek", ((0x370, 0x3FF),)), ("cyrillic", ((0x400, 0x52F),)), ("cjk", ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))))
NAMES = [*(name for name, _ in SCRIPTS), "other"]

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, chars_per_token double, fallback_share double, token_entropy double"
)
#: What limits need besides.
FIGURES = SCHEMA + ", n_tokens long" + "".join(f", other_{i} double" for i in range(len(OTHERS)))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Fertility:
    """Token figures of words under a sentencepiece vocabulary."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.others = [Tokenizer.from_file(public_tokenizers.path(x)) for x in OTHERS]
        for t in self.others:
            t.encode_special_tokens = True
        n = self.sp.get_piece_size()
        self.vocab = n
        self.fallback = np.array([self.sp.is_byte(i) or self.sp.is_unknown(i) for i in range(n)])
        self.flat = np.empty(0, np.int32)
        self.used = 0
        self.memo = Memo(self.figures)

    def refresh(self) -> None:
        self.memo.refresh()
        if not self.memo:
            self.used = 0

    def figures(self, words: list[bytes]) -> dict[str, np.ndarray]:
        strings = [w.decode("utf-8", "replace") for w in words]
        ids = self.sp.encode(strings, num_threads=1)
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(n.sum()))
        need = self.used + len(flat)
        if need > len(self.flat):
            grown = np.empty(max(need, 2 * len(self.flat), 1 << 16), np.int32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : need] = flat
        begin = self.used + np.cumsum(n) - n
        self.used = need
        others = np.array([[len(x) for x in t.encode_batch_fast(strings, add_special_tokens=False)] for t in self.others], np.int32).T
        return {"n": n, "begin": begin.astype(np.int64), "fallback": segment_sums(self.fallback[flat].astype(np.int64), n), "letters": letters_of(strings), "others": others}


def letters_of(strings: list[str]) -> np.ndarray:
    """Letters of each script in each string."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "replace"), np.uint32)
    distinct, which = np.unique(codes, return_inverse=True)
    script = np.array([script_of(c) if chr(c).isalpha() else -1 for c in distinct.tolist()], np.int64)[which]
    some = script >= 0
    owner = np.repeat(np.arange(len(strings)), lengths)
    return np.bincount(owner[some] * len(NAMES) + script[some], minlength=len(strings) * len(NAMES)).reshape(-1, len(NAMES)).astype(np.int32)


def script_of(code: int) -> int:
    for i, (_, ranges) in enumerate(SCRIPTS):
        if any(a <= code <= b for a, b in ranges):
            return i
    return len(SCRIPTS)


def entropies(tokens: np.ndarray, lengths: np.ndarray, vocab: int) -> np.ndarray:
    """Bits of the token distribution of each text."""
    owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    keys, counts = np.unique(owner * vocab + tokens, return_counts=True)
    of = keys // vocab
    p = counts / lengths[of]
    return np.bincount(of, -p * np.log2(p), minlength=len(lengths))


def verdicts(script: np.ndarray, chars: np.ndarray, fallback: np.ndarray, entropy: np.ndarray, tokens: np.ndarray, bands: dict[str, Band]) -> np.ndarray:
    low, high, most, least = (np.array([getattr(bands[name], k) for name in NAMES])[script] for k in ("chars_low", "chars_high", "fallback_high", "entropy_low"))
    return (chars >= low) & (chars <= high) & (fallback <= most) & ((entropy >= least) | (tokens < 50))


def rules(model: str, bands: dict[str, Band], held: list[str]):
    """The columns ``held`` of each document and its figures, with the verdict of the fixed bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(model)
        memo = fertility.memo
        for batch in chunks(batches):
            fertility.refresh()
            texts = utf8(batch)
            split = [t.split() for t in texts]
            n = np.fromiter(map(len, split), np.int64, len(split))
            index = memo.index([w for words in split for w in words])
            chars = np.fromiter(map(word_chars, texts), np.int64, len(texts))
            repeated = repeat_words(index, n)
            if len(index):
                per = memo.columns["n"][index]
                tokens = segment_sums(per.astype(np.int64), n)
                total = int(per.sum())
                at = np.repeat(memo.columns["begin"][index] - (np.cumsum(per, dtype=np.int64) - per), per) + np.arange(total)
                entropy = entropies(fertility.flat[at], tokens, fertility.vocab)
                fallback = segment_sums(memo.columns["fallback"][index].astype(np.int64), n)
                others = segment_sums(memo.columns["others"][index].astype(np.int64), n)
                letters = segment_sums(memo.columns["letters"][index].astype(np.int64), n)
                script = np.where(letters.any(1), letters.argmax(1), len(NAMES) - 1)
            else:
                tokens = fallback = np.zeros(len(texts), np.int64)
                others = np.zeros((len(texts), len(OTHERS)), np.int64)
                entropy, script = np.zeros(len(texts)), np.full(len(texts), len(NAMES) - 1)
            some = np.maximum(tokens, 1)
            per_token, share = chars / some, fallback / some
            failed = (n < 10) | (100 * repeated > 20 * n)
            kept = ~failed & verdicts(script, per_token, share, entropy, tokens, bands)
            values = [
                batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(chars), pa.array(np.fromiter(map(n_symbols, texts), np.int64, len(texts))),
                pa.array(np.fromiter(map(n_dup_lines, texts), np.int64, len(texts))), pa.array(repeated), pa.array(failed), pa.array(kept),
                pa.array([NAMES[i] for i in script]), pa.array(per_token), pa.array(share), pa.array(entropy), pa.array(tokens), *(pa.array(chars / np.maximum(x, 1)) for x in others.T),
            ]
            figures = pa.StructArray.from_arrays(values, names=[x.split()[0] for x in FIGURES.split(", ")])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), figures], names=[*held, "figures"])

    return run


def corpus_limits(found: DataFrame) -> DataFrame:
    """Quartiles of each figure by lang (null: all of them) and script, on a grid of thousandths so that no order of rows matters."""
    values = [F.col(f"figures.{c}") for c in JUDGED] + [F.log2("figures.n_tokens")]
    cells = F.explode(F.array([F.struct(F.lit(c).alias("name"), F.round(v, 3).alias("value")) for c, v in zip([*JUDGED, "length"], values, strict=True)]))
    rows = found.filter("not figures.base_failed and figures.n_tokens > 0").select("lang", "figures.script", cells.alias("c"))
    counts = rows.groupBy("lang", "script", "c.name", "c.value").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("script", "name", "value").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "script", "name", "value", "n")
    group = Window.partitionBy("lang", "script", "name")
    summed = counts.filter("lang is not null").unionByName(whole).select("*", F.sum("n").over(group.orderBy("value")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = [F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value"))).alias(f"q{k}") for k, q in ((1, 0.25), (2, 0.5), (3, 0.75))]
    quarters = summed.filter(f"total >= {LEAST}").groupBy("lang", "script", "name").agg(*at)
    figure = lambda c, v: F.max(F.when(F.col("name") == c, v))
    width = F.greatest(F.col("q3") - F.col("q1"), NARROW * F.col("q2")) * SPREAD
    return quarters.groupBy("lang", "script").agg(F.struct(*[figure(c, F.struct(F.col("q2").alias("middle"), width.alias("width"))).alias(c) for c in JUDGED], figure("length", F.pow(F.lit(2.0), F.col("q2"))).alias("length")).alias("limits"))


def fits(limits: Column) -> Column:
    """Whether the figures lie in the corpus' limits; true where there are none."""
    wider = F.greatest(F.lit(1.0), F.sqrt(limits["length"] / F.greatest(F.col("figures.n_tokens"), F.lit(1))))
    good = F.lit(True)
    for c in JUDGED:
        away = F.col(f"figures.{c}") - limits[c]["middle"]
        far = (away < -limits[c]["width"] * wider) & (F.col("figures.n_tokens") >= 50) if c == "token_entropy" else F.abs(away) > limits[c]["width"] * wider
        good = good & ~far
    return F.coalesce(good, F.lit(True))


def judged(docs: DataFrame, columns: list[str], model: str | None, bands: dict[str, Band] | None) -> DataFrame:
    """``columns`` of the documents and ``figures``, whose ``kept`` is the verdict of the fixed bands and the corpus' own.

    Texts are tokenized once; figures meet a few rows of limits by broadcast. A worker's memory is bounded by a text chunk and the word memo.
    """
    scratch = Scratch(docs.sparkSession)
    added = "lang" not in docs.columns
    docs = docs.withColumn("lang", F.lit(None).cast("string")) if added else docs
    held = columns if "lang" in columns else [*columns, "lang"]
    docs = docs.select(*dict.fromkeys([*held, "doc_id", "text"]))
    schema = StructType([*(docs.schema[c] for c in held), StructField("figures", StructType.fromDDL(FIGURES))])
    found = scratch.save(docs.mapInArrow(rules(model or default_model(), bands or BANDS, held), schema))
    limits = scratch.save(corpus_limits(found))
    own = limits.filter("lang is not null").select(F.col("lang").alias("own_lang"), F.col("script").alias("own_script"), F.col("limits").alias("own"))
    all_ = limits.filter("lang is null").select(F.col("script").alias("any_script"), F.col("limits").alias("any"))
    met = found.join(F.broadcast(own), (F.col("lang") == F.col("own_lang")) & (F.col("figures.script") == F.col("own_script")), "left").join(F.broadcast(all_), F.col("figures.script") == F.col("any_script"), "left")
    kept = F.col("figures.kept") & fits(F.coalesce("own", "any"))
    return met.select(*columns, F.col("figures").withField("kept", kept).alias("figures"))


def quality_rules(docs: DataFrame, model: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """One row per document: base statistics, fertility figures and the verdict ``kept``."""
    return judged(docs, [], model, bands).select(*[f"figures.{x.split()[0]}" for x in SCHEMA.split(", ")])


def keep_good(docs: DataFrame, model: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """The documents, with all their columns, that the rules keep."""
    return judged(docs, docs.columns, model, bands).filter("figures.kept").select(*docs.columns)
