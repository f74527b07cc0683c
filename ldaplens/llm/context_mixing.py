"""Numeric core of operator 11: hashed-context bit predictors, gated logistic mixing, adaptive refinement.

A text is coded as its bytes (A-Z lowered) and one end byte, eight binary decisions a byte, high bit
first. For every decision each predictor looks up what followed its context in the training texts: a
hash of some of the last four bytes. Their log odds are mixed with weights chosen by a gate (how often
the longest context was seen) and by the bit's place in the byte; the mixed probability is averaged
with a table that refines it by how often equally sure predictions came true. Weights and table are
learned online from what the same text has coded before: within a block of bytes they stand still,
after it they take one step. Every text starts from the same state, so its score does not depend on its
neighbours, and the probabilities of all texts sum to one.

Everything here works on the arrays of one chunk: up to ``DOCS`` pieces of texts and ``CHUNK`` bytes.
All predictors see parts of one window of five bytes, so what they say is looked up once per distinct
window of a chunk, and a position only needs the number of its window.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BITS = 20
CHUNK = 1 << BITS  # positions of one chunk, pads and ends included
PAD = 4  # zero bytes before a piece: the context of its first byte
PIECE = CHUNK - PAD - 1  # a longer text goes on in the next chunk, with its state and fresh contexts
DOCS = 8192
END = b"\xff"  # never part of UTF-8

#: Bytes of the window that make each predictor's context; the window is oldest << 32 | ... | last << 8 | byte.
CONTEXTS = (0xFFFF00, 0xFFFFFF00, 0xFFFFFFFF00)
LONGEST = 2
DELTA = 0.4  # added to both counts of a decision
START = (0.1, 0.3, 0.7)  # weights before anything is coded
RATE = 0.4
DAMP = 16.0
GATES = 4  # two bits of a position's group
SEEN = (0.5, 2.5, 15.5)  # a gate's bounds on the count of the longest context
STEPS = 12  # buckets of sureness, half a unit of log odds each
TRUST = 24.0  # observations the untouched refinement counts for
SLICE = 8192  # positions handled at once


@cache
def _block_of() -> np.ndarray:
    """Number of the block that holds an offset: eight blocks each of 64, 128, ... bytes, then of 4096."""
    sizes = [64 << min(i // 8, 6) for i in range(2048)]
    return np.repeat(np.arange(2048, dtype=np.uint64), sizes)[:CHUNK].copy()


def contexts(windows: np.ndarray, predictor: int) -> np.ndarray:
    """Keys ``hash of the context (54 bits) << 8 | byte`` of windows for one predictor."""
    h = (windows & np.uint64(CONTEXTS[predictor])) + np.uint64(predictor + 1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(10)) << np.uint64(8) | windows & np.uint64(255)


class Chunk:
    """The coded bytes of some pieces of texts."""

    def __init__(self, pieces: list[bytes], last: list[bool]):
        """``pieces`` are lowered bytes; ``last`` tells whether a piece ends its text."""
        head = bytes(PAD)
        b = np.frombuffer(b"".join(x for p, e in zip(pieces, last) for x in (head, p, END if e else b"")), np.uint8)
        self.sizes = sizes = np.array([len(p) + e for p, e in zip(pieces, last)], np.int64)
        self.n = n = int(sizes.sum())
        window = np.zeros(max(len(b) - PAD, 0), np.uint64)
        for back in range(PAD, -1, -1):
            window <<= np.uint64(8)
            window |= b[PAD - back:len(b) - back]
        before = np.cumsum(sizes) - sizes
        place = np.arange(n, dtype=np.int32)
        self.windows = window[place + np.repeat(np.arange(len(sizes), dtype=np.int32) * np.int32(PAD), sizes)]
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        self.offset = place - np.repeat(before.astype(np.int32), sizes)

    def distinct(self, train: np.ndarray | None = None):
        """Sorted distinct windows, with their counts over ``train`` positions or each position's number."""
        if not self.n:
            return self.windows, np.zeros(0, np.int64 if train is not None else np.int32)
        packed = self.windows << np.uint64(BITS)
        packed |= np.arange(self.n, dtype=np.uint64)
        packed.sort()
        where = (packed & np.uint64(CHUNK - 1)).astype(np.int32)
        packed >>= np.uint64(BITS)
        new = np.empty(self.n, bool)
        new[0] = True
        np.not_equal(packed[1:], packed[:-1], out=new[1:])
        firsts = np.flatnonzero(new)
        if train is not None:
            run = np.cumsum(train[where], dtype=np.int64)
            upto = run[np.append(firsts[1:], self.n) - 1]
            return packed[firsts], np.diff(upto, prepend=0)
        row = np.empty(self.n, np.int32)
        row[where] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        return packed[firsts], row


class Predictors:
    """What the predictors say of windows, looked up once per window of a part.

    ``keys`` are the counted keys of all predictors, sorted, with their ``counts``; the count of a node
    of the byte's tree is a difference of running sums over its range of bytes.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.run = np.concatenate([np.zeros(1), np.cumsum(counts, dtype=np.float64)])
        # known windows, sorted, and the row of each in the arrays below, which grow by doubling
        self.windows, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.odds = [np.empty((1 << 17, 8), np.float32) for _ in CONTEXTS]
        self.gate = np.empty(1 << 17, np.uint64)

    def _look_up(self, windows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Each predictor's log odds in favour of the eight decisions of each window, and its gate."""
        out, gate, keys, run = [], None, self.keys, self.run
        for k in range(len(CONTEXTS)):
            pairs, back = np.unique(contexts(windows, k), return_inverse=True)
            x = np.empty((len(pairs), 8), np.float32)
            low = pairs & ~np.uint64(255)
            start, stop = run[np.searchsorted(keys, low)], run[np.searchsorted(keys, low + np.uint64(256))]
            above = stop - start
            if k == LONGEST:
                gate = np.searchsorted(SEEN, above).astype(np.uint64)[back]
            for level in range(8):  # a decision halves its node, so one bound is new
                half = np.uint64(128 >> level)
                high = pairs & half != 0
                low |= half
                middle = run[np.searchsorted(keys, low)]
                low &= pairs | ~half
                start, stop = np.where(high, middle, start), np.where(high, stop, middle)
                n = stop - start
                x[:, level] = np.log((n + DELTA) / (above - n + DELTA))
                above = n
            out.append(x[back])
        return out, gate

    def rows(self, windows: np.ndarray) -> np.ndarray:
        """Rows of ``odds`` and ``gate`` that hold these sorted distinct windows."""
        at = np.searchsorted(self.windows, windows)
        known = np.zeros(len(windows), bool)
        inside = at < len(self.windows)
        known[inside] = self.windows[at[inside]] == windows[inside]
        new = windows[~known]
        if len(new):
            odds, gate = self._look_up(new)
            n = len(self.windows)
            while n + len(new) > len(self.gate):
                self.odds, self.gate = [np.concatenate([o, np.empty_like(o)]) for o in self.odds], np.concatenate([self.gate, self.gate])
            for old, more in zip([*self.odds, self.gate], [*odds, gate]):
                old[n:n + len(new)] = more
            whole = np.concatenate([self.windows, new])
            order = np.argsort(whole, kind="stable")  # two sorted runs
            self.windows = whole[order]
            self.at = np.concatenate([self.at, np.arange(n, n + len(new), dtype=np.int32)])[order]
            at = np.searchsorted(self.windows, windows)
        return self.at[at]


class State:
    """Weights and refinement tables of ``docs`` texts, all at their start."""

    def __init__(self, docs: int):
        self.w = [np.full((docs * GATES, 8), x, np.float32) for x in START]
        sure = 1 / (1 + np.exp(-(np.arange(STEPS) + 0.5) / 2))
        self.right = np.tile((TRUST * (sure - 0.5)).astype(np.float32), (docs, 8, 1))
        self.seen = np.full((docs, 8, STEPS), TRUST, np.float32)
        #: rate of coming true, less a half, by signed sureness: negated and reversed, 0 for undecided, as it is
        self.edge = np.zeros((docs, 8, 2 * STEPS + 1), np.float32)
        self.update(0, docs)
        #: the undecided cell of each text's eight tables
        self.cells = np.arange(docs * 8).reshape(docs, 8) * (2 * STEPS + 1) + STEPS

    def update(self, i: int, j: int) -> None:
        """Make the edges of texts i to j - 1 anew."""
        rate = self.right[i:j] / self.seen[i:j]
        self.edge[i:j, :, STEPS + 1:] = rate
        np.negative(rate[:, :, ::-1], out=self.edge[i:j, :, :STEPS])

    def take(self, i: int) -> tuple:
        """The state of one text, to go on with in a later chunk."""
        return [w[i * GATES:(i + 1) * GATES].copy() for w in self.w], self.right[i].copy(), self.seen[i].copy()

    def put(self, kept: tuple) -> None:
        """Go on with a kept state as text 0."""
        for w, old in zip(self.w, kept[0]):
            w[:GATES] = old
        self.right[0], self.seen[0] = kept[1:]
        self.update(0, 1)


def score(chunk: Chunk, predictors: Predictors, state: State) -> np.ndarray:
    """Natural log probability of every piece."""
    result = np.zeros(len(chunk.sizes))
    if not chunk.n:
        return result
    windows, row = chunk.distinct()
    chunk.windows = None  # not needed any more
    row = predictors.rows(windows)[row]
    odds, gate = predictors.odds, predictors.gate
    # within a block the order of bytes is free: equal texts and gates go together
    packed = ((_block_of()[chunk.offset] << np.uint64(13) | chunk.doc) << np.uint64(2) | gate[row]) << np.uint64(BITS)
    packed |= np.arange(chunk.n, dtype=np.uint64)
    packed.sort()
    row = row[(packed & np.uint64(CHUNK - 1)).astype(np.int32)]
    packed >>= np.uint64(BITS)
    group = (packed & np.uint64(DOCS * GATES - 1)).astype(np.int32)
    edges = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1], [True]]))
    block = packed >> np.uint64(2)
    firsts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    step = (block[firsts[:-1]] >> np.uint64(13)).astype(np.int64)
    i = 0
    while i < len(firsts) - 1:  # one block of different texts each, as many as fill a slice
        j = int(np.searchsorted(firsts, firsts[i] + SLICE, "right")) - 1
        j = max(i + 1, min(j, int(np.searchsorted(step, step[i], "right"))))
        s, e = int(firsts[i]), int(firsts[j])
        bounds = edges[np.searchsorted(edges, s):np.searchsorted(edges, e) + 1] - s
        _advance([o.take(row[s:e], 0, mode="clip") for o in odds], group[s:e], bounds, state, result)
        i = j
    return result


_ROW = np.ones(8, np.float32)


def _advance(x, group, bounds, state, result) -> None:
    """Code one block of some texts from the predictors' log odds ``x``, then learn from it."""
    edges = bounds[:-1]
    heads = group[edges]
    text = group >> 2
    first, stop = int(text[0]), int(text[-1]) + 1
    z = state.w[0].take(group, 0, mode="clip")
    z *= x[0]
    for k in range(1, len(x)):
        part = state.w[k].take(group, 0, mode="clip")
        part *= x[k]
        z += part
    p = np.minimum(z, 60)
    np.maximum(p, -60, out=p)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1
    np.reciprocal(p, out=p)
    # refinement: how often predictions as sure as this one came true so far
    side = (z > 0).view(np.int8) - (z < 0).view(np.int8)
    z *= 2
    np.minimum(z, STEPS - 1, out=z)
    np.maximum(z, 1 - STEPS, out=z)
    cell = z.astype(np.intp)
    cell += side
    cell += (state.cells[first:stop] - int(state.cells[first, 0]) + STEPS).take(text - first, 0, mode="clip")
    q = state.edge[first:stop].ravel().take(cell, mode="clip")
    q += p
    q += np.float32(0.5)
    q *= np.float32(0.5)
    np.log(q, out=q)
    np.add.at(result, text[edges], np.add.reduceat(q @ _ROW, edges, dtype=np.float64))
    np.subtract(1, p, out=p)
    rate = (RATE / (bounds[1:] - edges + DAMP)).astype(np.float32)[:, None]
    for k in range(len(x)):
        x[k] *= p
        step = np.add.reduceat(x[k], edges, 0)
        step *= rate
        state.w[k][heads] += step
    shape = stop - first, 8, 2 * STEPS + 1
    found = np.bincount(cell.ravel(), minlength=shape[0] * shape[1] * shape[2]).reshape(shape)
    wrong, right = found[:, :, STEPS - 1::-1], found[:, :, STEPS + 1:]
    seen = wrong + right
    seen[:, :, 0] += found[:, :, STEPS]
    state.seen[first:stop] += seen
    state.right[first:stop] += 0.5 * (right - wrong)
    state.update(first, stop)
