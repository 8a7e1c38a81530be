"""Exact per-text statistics, worked out for a chunk of texts at once.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; that is what
``bytes.split()`` yields.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import splitmix

#: The symbol characters that the base statistics count, and ASCII white space.
SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5


def word_chars(text: bytes) -> int:
    """Code points in words."""
    return len(text.translate(None, WHITE + CONTINUATION))


def n_symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def n_dup_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeat_words(index: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text: words in windows of ``window`` words that the text holds twice or more.

    ``index`` numbers the words of all texts in a row, equal words alike. A
    window's key is a sum of independent 64-bit mixes, so two different
    windows of one text meet with a chance of about 2**-64.
    """
    n = len(index)
    if n < window:
        return np.zeros(len(lengths), np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(over="ignore"):
        base = splitmix(index.astype(np.uint64))
        key = np.zeros(n - window + 1, np.uint64)
        for j in range(window):
            key = key * np.uint64(0x9FB21C651E98DF25) + base[j : n - window + 1 + j]
        key = splitmix(key) ^ splitmix(owner[: n - window + 1].astype(np.uint64) + np.uint64(1 << 40))
    whole = owner[: n - window + 1] == owner[window - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at])]
    sorted_keys = key[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = np.zeros(n, bool)
    starts[order[twice]] = True
    covered = starts.copy()
    for j in range(1, window):
        covered[j:] |= starts[:-j]
    return np.bincount(owner[covered], minlength=len(lengths)).astype(np.int64)
