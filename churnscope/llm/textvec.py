"""Whole texts as numpy arrays: many documents laid end to end, worked on at once.

Runs inside Spark tasks on Arrow batches. A block holds about ``BLOCK_BYTES``
of text (or one longer document), which bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20

_U = np.uint64
# Multipliers of the hashes: arbitrary odd 64-bit numbers.
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))

WHITE_BYTES = np.zeros(256, bool)
WHITE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one-to-one)."""
    h = (h ^ (h >> _U(30))) * _MIX[0]
    h = (h ^ (h >> _U(27))) * _MIX[1]
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of the hash base and of its inverse, as long as the longest block so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()  # built anew where it is needed, not sent

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2))
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and document number of every word of a block, in order."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    solid = ~WHITE_BYTES[buf]
    if not solid.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.of(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * up, out=total[1:])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[1]
    first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    return mix(h), np.searchsorted(first, start, "right") - 1


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of every document of a block, as (hash, document number).

    Sorted by document, then hash. A document with fewer words has its whole
    sequence as its only shingle; one without words has none.
    """
    w, d = words(texts)
    n = len(texts)
    per = np.bincount(d, minlength=n)
    acc = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        acc = mix(acc * _BASE + w[j : len(w) - k + 1 + j])
    whole = d[k - 1 :] == d[: len(w) - k + 1] if len(w) >= k else np.zeros(0, bool)
    h, of = mix(acc[whole] + _U(k)), d[: len(acc)][whole]
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        at = np.cumsum(per) - per
        more = []
        for i in short:
            one = np.zeros(1, np.uint64)
            for x in w[at[i] : at[i] + per[i]]:
                one = mix(one * _BASE + x)
            more.append(mix(one + _U(per[i]))[0])
        h, of = np.concatenate([h, np.array(more, np.uint64)]), np.concatenate([of, short])
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.uint32), kind="stable")]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]
