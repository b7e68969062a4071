"""Word shingle sets of whole texts as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import numpy as np

from .common import mix64

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; A-Z count as a-z.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
R = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """R^0 .. R^n modulo 2^64."""
    global _powers
    while len(_powers) <= n:
        k = len(_powers)
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * R)])
        assert len(_powers) == 2 * k
    return _powers


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word ``[^\\x20\\x09-\\x0D]+`` in order; A-Z lower-cased."""
    base = offsets[0]
    data = data[base : offsets[-1]]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = SPACE[data]
    inside = ~space
    starts = inside.copy()
    starts[1:] &= space[:-1]
    edges = offsets[1:-1] - base
    edges = edges[edges < n]
    starts[edges] = inside[edges]  # a text begins a word of its own
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = space.copy()
    stop[edges] = True
    close = np.append(np.flatnonzero(stop), n)
    end = close[np.searchsorted(close, at, side="right")]
    p = powers(n)
    total = np.zeros(n + 1, np.uint64)
    # Horner from the right: the hash of a word is its suffix sum over the power of its start
    np.cumsum((BYTE[data] * inside) * p[:n], out=total[1:])
    raw = (total[end] - total[at]) * p[n - at]  # shifted to a common power
    length = (end - at).astype(np.uint64)
    doc = np.searchsorted(offsets - base, at, side="right") - 1
    return mix64(raw * inverse(n) + length), doc


def inverse(n: int) -> np.uint64:
    """R^-n modulo 2^64."""
    return np.uint64(pow(int(R), -n, 1 << 64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number), distinct and sorted by both: shingles of ``size`` words, or all words of a shorter text."""
    h, doc = words(data, offsets)
    if not len(h):
        return h, doc
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, len(h)))
    parts, owners = [], []
    if len(h) >= size:
        m = len(h) - size + 1
        acc = np.zeros(m, np.uint64)
        for j in range(size):
            acc = mix64(acc * R + h[j : j + m])
        good = doc[:m] == doc[size - 1 :]
        parts.append(acc[good])
        owners.append(doc[:m][good])
    for k in range(1, size):  # whole sequences of k words
        at = first[count == k]
        acc = np.full(len(at), k, np.uint64)
        for j in range(k):
            acc = mix64(acc * R + h[at + j])
        parts.append(acc)
        owners.append(doc[at])
    acc, own = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((acc, own))
    acc, own = acc[order], own[order]
    keep = np.ones(len(acc), bool)
    keep[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
    return acc[keep], own[keep]
