"""Vectorised text helpers for code inside tasks: words, rolling hashes, minimisers."""

from __future__ import annotations

import re

import numpy as np

#: White space as the contract has it: space and 0x09-0x0D. bytes.split() uses the same.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
GAP = re.compile(rb"[\x20\x09-\x0d]")
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORDS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


def space_table() -> np.ndarray:
    """True for bytes inside words."""
    table = np.ones(256, bool)
    table[list(SPACE)] = False
    return table


class Words:
    """Words of several texts: byte spans in ``buf``, 64-bit hashes, and for each text
    the range [ptr[i], ptr[i+1]) of its words. ``hashed``: with hashes."""

    def __init__(self, raw: list[bytes], table: np.ndarray, hashed: bool = True):
        sep = bytes([int(np.flatnonzero(~table)[0])])
        self.buf = sep.join(raw) + sep
        data = np.frombuffer(self.buf, np.uint8)
        inside = table[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw))
        self.ptr = np.searchsorted(self.start, np.concatenate(([0], np.cumsum(sizes))))
        n = self.end - self.start
        self.hash = np.zeros(len(n), np.uint64)
        if len(n) and hashed:
            power = np.ones(int(n.max()), np.uint64)
            power[1:] = np.uint64(_P)
            power = np.cumprod(power)
            for i in range(0, len(n), _WORDS):  # a block of words at a time: less memory
                a, b, m = self.start[i], self.end[min(i + _WORDS, len(n)) - 1], n[i : i + _WORDS]
                first = np.cumsum(m) - m
                letters = data[a:b][inside[a:b]].astype(np.uint64) + np.uint64(1)
                letters *= power[np.arange(len(letters)) - np.repeat(first, m)]
                self.hash[i : i + _WORDS] = mix(np.add.reduceat(letters, first) + m.astype(np.uint64) * np.uint64(_Q))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]]


def window_hash(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive values, by doubling."""
    size = len(values) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    done, done_n, cur, cur_n, left = None, 0, values, 1, n
    while True:
        step = np.uint64(pow(_Q, cur_n, 1 << 64))
        if left & 1:
            if done is None:
                done = cur
            else:
                k = min(len(done), len(cur) - done_n)
                done = done[:k] * step + cur[done_n : done_n + k]
            done_n += cur_n
        left >>= 1
        if not left:
            return mix(done[:size])
        k = len(cur) - cur_n
        cur, cur_n = cur[:k] * step + cur[cur_n : cur_n + k], cur_n * 2


def window_argmin(order: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values, the place of its smallest (40 leading bits), leftmost
    on ties."""
    n = len(order) - w + 1
    out = np.zeros(max(n, 0), np.int64)
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(n, 0), 1 << 22):
        part = order[at : at + (1 << 22) + w - 1]
        cur = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        size, span = len(part) - w + 1, 1
        while span * 2 <= w:
            cur = np.minimum(cur[:-span], cur[span:])
            span *= 2
        cur = np.minimum(cur[:size], cur[w - span : w - span + size])
        out[at : at + size] = (cur & low).astype(np.int64) + at
    return out


def merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans [from, to) that the given ones cover, in order and apart."""
    order = np.argsort(starts, kind="stable")
    a = np.asarray(starts)[order]
    reach = np.maximum.accumulate(a + np.asarray(lengths)[order]) if len(a) else a
    first = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))[: len(a)]
    return a[first], reach[np.concatenate((first[1:], [len(a)]))[: len(first)] - 1]


def without(units, begins: np.ndarray, ends: np.ndarray):
    """The parts of a sequence beside the given spans."""
    at = 0
    for a, b in zip(begins.tolist(), ends.tolist()):
        yield units[at:a]
        at = b
    yield units[at:]


def pieces(raw: bytes, most: int = 1 << 20):
    """A text in parts of about ``most`` bytes that begin with white space, but the first;
    a part is longer only where a word is."""
    at = 0
    while at < len(raw):
        gap = GAP.search(raw, at + most) if at + most < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end
