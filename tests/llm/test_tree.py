"""The suffix tree's counts against plain ones."""

from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import pst
from tidemark.llm.common import shrink


def test_suffix_tree_counts():
    """Counts of (context, next symbol) equal a plain count, for texts that are empty, short or repeat."""
    symbols = pst.Symbols(np.empty(0, np.int64))
    symbols.rare, symbols.end, symbols.begin, symbols.base = 3, 4, 5, 6
    texts = [[], [0], [0, 1, 2, 3], [0, 1, 0, 1, 0, 1], [2, 2, 2], [0, 1, 2, 3]]
    rows = [[5, *t, 4] for t in texts]
    packed = pa.RecordBatch.from_arrays([pa.array([shrink(np.array(sum(half, []), np.int32)) for half in (rows[:2], rows[2:])], pa.binary())], names=["symbols"])
    for depth in (1, 2, 3):
        want = Counter((tuple(r[i - depth : i]), r[i]) for r in rows for i in range(depth, len(r)))
        members = sorted({c for c, _ in want})
        codes = np.zeros(len(members), np.int64)
        for k in range(depth):
            codes = pst.extend(codes, np.array([m[k] for m in members], np.int32))
        order = np.argsort(codes)
        got = Counter()
        for out in pst.next_counter(symbols, codes[order], depth)(iter([packed])):
            for r in out.to_pylist():
                got[members[order[r["context"]]], r["next"]] += r["n"]
        assert got == want
