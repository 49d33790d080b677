"""Hashes of the words of many texts at once, on numpy.

A word is a run of letters, digits, underscores and bytes beyond ASCII in the lower-cased UTF-8 text. Words are hashed
from prefix sums of a polynomial over the bytes, so any prefix of a word costs one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together, so that tables stay in the processor's cache.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Holds the tables; one lives in each task."""

    def __init__(self) -> None:
        byte = np.arange(256, dtype=np.uint64)
        self.value = mix(byte + np.uint64(0x5851F42D4C957F2D))
        word = np.zeros(256, np.uint8)
        word[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
        self.word = word
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table))

    def spans(self, texts: list[str]) -> Iterator[tuple[int, int, Words]]:
        """Consecutive texts [first, last) and their words."""
        first, size, batch = 0, 0, []
        for i, text in enumerate(texts):
            raw = (text or "").lower().encode()
            if batch and size + len(raw) > CHUNK:
                yield first, i, Words(self, batch)
                first, size, batch = i, 0, []
            batch.append(raw)
            size += len(raw) + 1
        if batch:
            yield first, len(texts), Words(self, batch)


class Words:
    """The words of a few texts: ``start`` and ``size`` in bytes, ``text`` the place of their text, ``hash``."""

    def __init__(self, hasher: Hasher, raws: list[bytes]):
        buffer = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        hasher._grow(len(buffer) + 1)
        self.hasher, self.count = hasher, len(raws)
        inside = np.concatenate([[0], hasher.word[buffer], [0]]).astype(np.int8)
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        end = np.flatnonzero(edge == -1)
        self.size = end - self.start
        self.buffer = buffer
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hasher.value[buffer] * hasher.power[: len(buffer)])])
        lengths = np.array([len(r) + 1 for r in raws], np.int64)
        self.ends = np.cumsum(lengths)  # of the texts, in bytes
        self.begins = self.ends - lengths
        bounds = np.searchsorted(self.start, self.ends)  # words before each text's end
        self.first = np.concatenate([[0], bounds[:-1]])
        self.last = bounds
        self.text = np.repeat(np.arange(len(raws)), self.last - self.first)
        self.hash = self.prefix(self.size)

    def prefix(self, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of each word."""
        return mix((self.sums[self.start + size] - self.sums[self.start]) * self.hasher.inverse[self.start])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words within a text, and their text; a shorter text is one run of its words."""
        n = len(self.hash)
        factors = [pow(_BASE, k + 1, 1 << 64) for k in range(width)]
        count = self.last - self.first
        if n >= width:
            run = self.hash[: n - width + 1] * np.uint64(factors[0])
            for k in range(1, width):
                run = run + self.hash[k : n - width + 1 + k] * np.uint64(factors[k])
            whole = self.text[: n - width + 1] == self.text[width - 1 :]
            run, text = mix(run)[whole], self.text[: n - width + 1][whole]
        else:
            run, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            more = np.zeros(len(short), np.uint64)
            for j, t in enumerate(short):
                for k, h in enumerate(self.hash[self.first[t] : self.last[t]].tolist()):
                    more[j] = np.uint64((int(more[j]) + h * factors[k]) & MASK)
            run, text = np.concatenate([run, mix(more)]), np.concatenate([text, short])
            order = np.argsort(text, kind="stable")
            run, text = run[order], text[order]
        return run, text
