"""Code point arrays and rolling hashes, shared by the operators that look into text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) <= n:
        m = max(n + 1, 1 << 20)
        step = np.full(m, _BASE, np.uint64)
        step[0] = 1
        inv = np.full(m, _BASE_INV, np.uint64)
        inv[0] = 1
        _POW, _INV = np.multiply.accumulate(step), np.multiply.accumulate(inv)
    return _POW, _INV


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row (uint32), and the offsets of the texts (len + 1)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points that begin at each position; the last k - 1 positions have none."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    pw, inv = _powers(n)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * pw[:n], out=acc[1:])
    return mix((acc[k:] - acc[:-k]) * inv[: n - k + 1])


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over the w values from each position on; length len(x) - w + 1."""
    if len(x) < w:
        return x[:0]
    s = 1
    y = x
    while 2 * s <= w:
        y = op(y[:-s], y[s:])
        s *= 2
    return op(y[: len(x) - w + 1], y[w - s : w - s + len(x) - w + 1])


def slices(texts: list[str], chars: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about that many characters together, so that the arrays over them stay small."""
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > chars:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)
