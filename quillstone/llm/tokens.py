"""Words and shingles of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK)
        _powers[:] = [np.cumprod(np.full(size, b, U)) for b in (U(_BASE), U(pow(_BASE, -1, 1 << 64)))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs without white space; buf ends in white space."""
    gap = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap))))
    return edge[0::2], edge[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for ascending spans: differences of a rolling polynomial, in blocks."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = max(int(np.searchsorted(ends, base + _BLOCK, "right")), at + 1)
        top = int(ends[upto - 1])
        power, inverse = powers(top - base)
        total = np.concatenate((np.zeros(1, U), np.cumsum((buf[base:top].astype(U) + U(1)) * power[: top - base])))
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        at = upto
    return out


def hash_runs(buf: np.ndarray, n: int) -> np.ndarray:
    """`hash_spans` of all runs of n."""
    size = max(0, len(buf) - n + 1)
    out = np.empty(size, U)
    for at in range(0, size, _BLOCK):
        upto = min(size, at + _BLOCK)
        power, inverse = powers(upto - at + n)
        total = np.concatenate((np.zeros(1, U), np.cumsum((buf[at : upto + n - 1].astype(U) + U(1)) * power[: upto - at + n - 1])))
        out[at:upto] = mix((total[n:] - total[:-n]) * inverse[: upto - at] + U(n * 0xD6E8FEB86659FD93 % 2**64))
    return out


class Words:
    """The words of texts (bytes, UTF-8). doc: position of each word's text; hash: 64 bits of it."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.starts, self.ends = word_bounds(self.buf)
        self.hash = hash_spans(self.buf, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, one more at the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of each run of n words; a shorter text has its whole sequence as one."""
        h, doc = self.hash, self.doc
        size = len(h) - n + 1
        if size > 0:
            acc = np.full(size, U(n))
            for j in range(n):
                acc = mix(acc * U(0xFF51AFD7ED558CCD) + h[j : j + size])
            ok = doc[:size] == doc[n - 1 :]
            docs, hashes = doc[:size][ok], acc[ok]
        else:
            docs, hashes = np.empty(0, np.int64), np.empty(0, U)
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if len(short):
            more = np.empty(len(short), U)
            for k, d in enumerate(short):
                acc = np.full(1, U(self.counts[d]))
                for x in h[self.first[d] : self.first[d + 1]]:
                    acc = mix(acc * U(0xFF51AFD7ED558CCD) + x)
                more[k] = acc[0]
            docs, hashes = np.concatenate((docs, short)), np.concatenate((hashes, more))
            order = np.argsort(docs, kind="stable")
            docs, hashes = docs[order], hashes[order]
        return docs, hashes
