"""Suffix and common-prefix arrays of many short texts by external induced sorting.

The text is a row of positive symbols in which each document piece ends with
a 0; comparison stops there. The sorted suffixes that start a rising stretch
(LMS) come from recursion on the names of the stretches; all others are
induced from them in order. A priority queue holds tuples (suffix, length of
the prefix it shares with the tuple before it), by first symbol and then in
the order of arrival, which induction makes the sorted order; beyond a budget
it lies in a file on disk. The prefix that two induced suffixes share is one
more than the least one between their sources, so it is carried along and no
text is compared again.

Tuples are taken in batches: all buckets from the least on that have all their
tuples, since nothing more can arrive in them.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of tuples that a queue keeps in memory.
BUDGET = 256 << 20
#: Buckets that one batch looks ahead for, and tuples it takes, at most.
AHEAD, BATCH = 4096, 1 << 20


def room(n: int, kind: type, budget: int) -> np.ndarray:
    """An array in memory, or in a private scratch file of the task if it is larger than the budget."""
    if n * np.dtype(kind).itemsize <= budget:
        return np.empty(n, kind)
    with tempfile.TemporaryFile(prefix="tidemark-queue-") as file:
        return np.memmap(file, kind, "w+", shape=(n,))


def range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values[first..last]`` (both included, first <= last) for each query."""
    out = np.empty(len(first), values.dtype)
    if not len(first):
        return out
    span = last - first + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    table, width = values, 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[first[at]], table[last[at] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def stretch_ends(text: np.ndarray) -> np.ndarray:
    """Last position of the run of equal symbols that each position is in."""
    n = len(text)
    end = np.arange(n, dtype=np.int32)
    end[:-1][text[:-1] == text[1:]] = n
    return np.minimum.accumulate(end[::-1])[::-1]


class Queue:
    """Tuples in buckets of known sizes, taken in the order of the buckets."""

    def __init__(self, sizes: np.ndarray, budget: int):
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.head = self.start.copy()
        total = int(self.end[-1]) if len(sizes) else 0
        self.pos, self.lcp = room(total, np.int32, budget), room(total, np.int32, budget)

    def arrive(self, source_lcp: np.ndarray, at: np.ndarray, pos: np.ndarray, bucket: np.ndarray) -> None:
        """Predecessors ``pos`` of the batch's tuples number ``at``, for ``bucket``; ``source_lcp`` is that of the whole batch.

        A batch starts with a bucket, whose first suffix shares nothing with
        those before; so what comes first into a bucket from a batch shares
        just its own symbol with the arrivals from earlier batches.
        """
        if not len(at):
            return
        order = np.argsort(bucket, kind="stable")
        at, pos, bucket = at[order], pos[order], bucket[order]
        head = np.ones(len(at), bool)
        head[1:] = bucket[1:] != bucket[:-1]
        first, inner = np.flatnonzero(head), np.flatnonzero(~head)
        to = bucket[first]
        shared = np.empty(len(at), np.int32)
        shared[inner] = range_min(source_lcp, at[inner - 1] + 1, at[inner]) + 1
        shared[first] = self.head[to] > self.start[to]
        sizes = np.diff(first, append=len(at))
        slot = np.arange(len(at)) + np.repeat(self.head[to] - first, sizes)
        self.pos[slot], self.lcp[slot] = pos, shared
        self.head[to] += sizes

    def repeat(self, bucket: int, before: np.ndarray) -> None:
        """Complete a bucket by the suffixes that put its symbol before those in it, once, twice, and so on.

        ``before`` tells how often the symbol comes before each position.
        Suffixes with one more of the symbol come after all with one less, in
        the same order, and share one symbol more.
        """
        i, j, end = int(self.start[bucket]), int(self.head[bucket]), int(self.end[bucket])
        base, base_lcp = self.pos[i:j], self.lcp[i:j]
        times = before[base]
        which = np.repeat(np.arange(j - i), times)
        more = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + 1
        order = np.argsort(more, kind="stable")
        which, more = which[order], more[order]
        shared = more.copy()
        inner = np.flatnonzero(more[1:] == more[:-1]) + 1
        shared[inner] += range_min(base_lcp, which[inner - 1] + 1, which[inner])
        self.pos[j:end], self.lcp[j:end] = base[which] - more, shared
        self.head[bucket] = end

    def ready(self, bucket: int) -> int:
        """The bucket after the last one, from ``bucket`` on, that has all its tuples, within the limits of a batch."""
        ahead = slice(bucket, bucket + AHEAD)
        short = self.head[ahead] < self.end[ahead]
        n = int(short.argmax()) if short.any() else len(short)
        if n > 1:
            n = max(1, int(np.searchsorted(self.end[bucket : bucket + n], self.start[bucket] + BATCH, "right")))
        return bucket + n


def merged(pos: np.ndarray, lcp: np.ndarray, bucket: np.ndarray, more: np.ndarray, more_lcp: np.ndarray, more_bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted batches as one, by bucket; in a bucket the first batch comes first."""
    if not len(more):
        return pos, lcp
    if not len(pos):
        return more, more_lcp
    order = np.argsort(np.concatenate([bucket, more_bucket]), kind="stable")
    return np.concatenate([pos, more])[order], np.concatenate([lcp, more_lcp])[order]


class Inducer:
    def __init__(self, text: np.ndarray, alphabet: int, budget: int):
        self.text, self.alphabet, self.budget = text, alphabet, budget
        n = len(text)
        end = stretch_ends(text)
        self.s_type = (text == 0) | (text < np.append(text[1:], text.dtype.type(0))[end])
        self.run = end
        self.run -= np.arange(-1, n - 1, dtype=np.int32)
        self.before = stretch_ends(text[::-1])[::-1]
        self.before += np.arange(1 - n, 1, dtype=np.int32)
        self.l_sizes = np.bincount(text[~self.s_type], minlength=alphabet)
        self.s_sizes = np.bincount(text[self.s_type & (text > 0)], minlength=alphabet)

    def falling(self, seeds: np.ndarray, seed_lcp: np.ndarray) -> Queue:
        """The L-type suffixes in order."""
        text, queue = self.text, Queue(self.l_sizes, self.budget)
        cut = np.searchsorted(text[seeds], np.arange(self.alphabet + 1))
        c = 0
        while c < self.alphabet:
            to = queue.ready(c)
            if to == c:
                queue.repeat(c, self.before)
                continue
            i, j = int(queue.start[c]), int(queue.end[to - 1])
            own = seeds[cut[c] : cut[to]]
            own_lcp = seed_lcp[cut[c] : cut[to]].copy()
            self.border(queue, own, own_lcp, text[own])
            pos, lcp = merged(queue.pos[i:j], queue.lcp[i:j], text[queue.pos[i:j]], own, own_lcp, text[own])
            before = pos - 1
            at = np.flatnonzero((before >= 0) & ~self.s_type[before] & (text[before] != text[pos]))
            before = before[at]
            queue.arrive(lcp, at, before, text[before])
            c = to
        return queue

    def border(self, queue: Queue, own: np.ndarray, own_lcp: np.ndarray, bucket: np.ndarray) -> None:
        """What the first of each bucket's ``own`` suffixes shares with the last of the other type before it: the shorter run of the symbol."""
        if not len(own):
            return
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        at = bucket[first]
        some = queue.end[at] > queue.start[at]
        shared = np.zeros(len(first), np.int32)
        shared[some] = np.minimum(self.run[queue.pos[queue.end[at[some]] - 1]], self.run[own[first[some]]])
        own_lcp[first] = shared

    def climbing(self, low: Queue) -> Queue:
        """The S-type suffixes in falling order; bucket b of the queue is that of symbol alphabet - 1 - b."""
        text, top = self.text, self.alphabet - 1
        queue = Queue(self.s_sizes[::-1], self.budget)
        c = 0
        while c < top:  # not symbol 0
            to = min(queue.ready(c), top)
            if to == c:
                queue.repeat(c, self.before)
                continue
            i, j = int(queue.start[c]), int(queue.end[to - 1])
            a, b = int(low.start[top - to + 1]), int(low.end[top - c])
            own, own_lcp = low.pos[a:b][::-1], np.append(low.lcp[a:b], 0)[1:][::-1].astype(np.int32)
            self.border(queue, own, own_lcp, top - text[own])
            pos, lcp = merged(queue.pos[i:j], queue.lcp[i:j], top - text[queue.pos[i:j]], own, own_lcp, top - text[own])
            before = pos - 1
            at = np.flatnonzero((before >= 0) & self.s_type[before] & (text[before] > 0) & (text[before] != text[pos]))
            before = before[at]
            queue.arrive(lcp, at, before, top - text[before])
            c = to
        return queue

    def induce(self, seeds: np.ndarray, seed_lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes (but those at a 0) in order, and what each shares with the one before it, from sorted LMS suffixes."""
        low = self.falling(seeds, seed_lcp)
        high = self.climbing(low)
        n_low, n_high = len(low.pos), len(high.pos)
        up = high.pos[::-1]
        up_lcp = np.append(high.lcp[1:], 0)[::-1].astype(np.int32)
        symbol = self.text[up]
        self.border(low, up, up_lcp, symbol)
        sa, lcp = room(n_low + n_high, np.int32, self.budget), room(n_low + n_high, np.int32, self.budget)
        s_before = np.cumsum(self.s_sizes) - self.s_sizes
        here = np.arange(n_low) + s_before[self.text[low.pos]]
        sa[here], lcp[here] = low.pos, low.lcp
        here = np.arange(n_high) + low.end[symbol]
        sa[here], lcp[here] = up, up_lcp
        return sa, lcp


def suffix_lcp(text: np.ndarray, alphabet: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes of ``text`` (ends with 0) that don't start at a 0, sorted, and their common prefixes.

    Symbols are below ``alphabet``; suffixes that are equal up to their 0 come in any order.
    """
    text = np.asarray(text, np.int32)
    work = Inducer(text, alphabet, budget)
    s = work.s_type
    is_lms = (text == 0) | (s & np.append(False, ~s[:-1]))
    lms = np.flatnonzero(is_lms)
    seeds = lms[np.argsort(text[lms], kind="stable")]
    rough, _ = work.induce(seeds, np.zeros(len(seeds), np.int32))
    zeros = lms[text[lms] == 0]
    rough = np.concatenate([zeros, rough[is_lms[rough]]])  # LMS suffixes by their stretches
    rank = np.full(len(text), -1, np.int32)
    rank[lms] = np.arange(len(lms), dtype=np.int32)
    following = np.append(lms[1:], len(text) - 1)
    differ, shared = neighbours(2 * text + s, rough, following[rank[rough]] - rough)
    name_in_order = np.cumsum(differ) - 1
    names = np.empty(len(lms), np.int32)
    names[rank[rough]] = name_in_order
    n_names = int(name_in_order[-1]) + 1
    lcp = np.zeros(len(lms), np.int32)
    if n_names == len(lms):
        order = rough
        lcp[1:] = with_run(text, work.run, order[:-1], order[1:], shared[1:])
    else:
        ranked, equal = suffix_lcp(np.append(names + 1, np.int32(0)), n_names + 1, budget)
        order = lms[ranked]
        # Where k names are shared, the text shares their stretches and then what two different names share.
        between = shared[differ]  # what each name shares with the one before it
        a, b, k = ranked[:-1], ranked[1:], equal[1:]
        x, y = names[a + k], names[b + k]
        lcp[1:] = lms[a + k] - lms[a] + with_run(text, work.run, lms[a + k], lms[b + k], range_min(between, x + 1, y))
    return work.induce(order, lcp)


def with_run(text: np.ndarray, run: np.ndarray, a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Common prefixes of suffixes whose symbols and types agree for ``shared``: then a rising run of a symbol may meet a falling one of it."""
    x, y = a + shared, b + shared
    meet = (text[x] == text[y]) & (text[x] != 0)
    return shared + np.where(meet, np.minimum(run[x], run[y]), 0)


def neighbours(typed: np.ndarray, order: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For LMS suffixes ordered by their stretches: whether each stretch differs from the one before; if so, how many symbols agree, types included.

    ``typed`` is twice the symbol, plus 1 for S-type; a 0 is 1.
    """
    n = len(order)
    differ, shared = np.ones(n, bool), np.zeros(n, np.int32)
    active = np.arange(1, n)
    a, b = order[:-1], order[1:]
    depth = 0
    while len(active):
        x, y = typed[a[active - 1] + depth], typed[b[active - 1] + depth]
        go = (x == y) & (x != 1)
        shared[active[~go]] = depth
        active = active[go]
        same = (length[active - 1] == length[active]) & (length[active] == depth)
        differ[active[same]] = False
        active = active[~same]
        depth += 1
    return differ, shared
