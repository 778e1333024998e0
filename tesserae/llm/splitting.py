"""Oversized items cut at natural boundaries, with overlap.

Cohesion between the words before and after each gap is measured over a sliding block; a valley of it marks a change
of topic. Within each window that the size limit leaves, the deepest valley becomes the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SENTENCE = re.compile(r"(?:[.!?;…。！？][\"')\]”’]*\s+|\s*\n\s*|[。！？])")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"\w+")


def _gaps(text: str) -> list[int]:
    """Positions after sentence ends and line breaks, inside the text."""
    return [m.end() for m in _SENTENCE.finditer(text) if 0 < m.end() < len(text)]


def _depths(text: str, gaps: list[int], block: int) -> np.ndarray:
    """Depth of the similarity valley at each gap: how far the block similarity rises to its left and right.

    The counts of both blocks slide along the words, so the time is linear in the text.
    """
    n = len(gaps)
    if n == 0:
        return np.zeros(0)
    words, at = [], []
    ids: dict[str, int] = {}
    for m in _TOKEN.finditer(text):
        words.append(ids.setdefault(m.group().lower(), len(ids)))
        at.append(m.start())
    cut = np.searchsorted(np.asarray(at, np.int64), np.asarray(gaps, np.int64)) if at else np.zeros(n, np.int64)
    left, right = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64)
    dot = ll = rr = 0
    sims = np.zeros(n)
    a = b = c = 0  # left block is [a, b), right block is [b, c)
    for g in range(n):
        p = int(cut[g])
        lo, hi = max(0, p - block), min(len(words), p + block)
        while c < hi:
            w = words[c]
            dot += left[w]
            rr += 2 * right[w] + 1
            right[w] += 1
            c += 1
        while b < p:
            w = words[b]
            dot -= left[w]
            rr -= 2 * right[w] - 1
            right[w] -= 1
            dot += right[w]
            ll += 2 * left[w] + 1
            left[w] += 1
            b += 1
        while a < lo:
            w = words[a]
            dot -= right[w]
            ll -= 2 * left[w] - 1
            left[w] -= 1
            a += 1
        sims[g] = dot / np.sqrt(ll * rr) if ll and rr else 0.0
    # climb from each gap while the similarity does not fall
    up_l, up_r = sims.copy(), sims.copy()
    for g in range(1, n):
        if up_l[g - 1] >= sims[g] and sims[g - 1] >= sims[g]:
            up_l[g] = up_l[g - 1]
    for g in range(n - 2, -1, -1):
        if up_r[g + 1] >= sims[g] and sims[g + 1] >= sims[g]:
            up_r[g] = up_r[g + 1]
    return up_l + up_r - 2 * sims


def cut_points(text: str, limit: int, overlap: int, block: int = 30) -> list[int]:
    """Where the text is cut: every piece, with the overlap before it, has at most limit characters.

    In each window the deepest valley in its second half wins, the last on ties; without a sentence end there, the
    deepest in the first half (of the first window, beyond the overlap); without that, the last white space in either
    half; without that, the limit itself (not between a letter and its combining mark, if it can be helped).
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    if len(text) <= limit:
        return []
    gaps = _gaps(text)
    depth, where = _depths(text, gaps, block), np.asarray(gaps, np.int64)
    spaces = np.asarray([m.end() for m in _SPACE.finditer(text)], np.int64)
    cuts, start = [], 0
    while len(text) - start + (overlap if cuts else 0) > limit:
        hi = start + limit - (overlap if cuts else 0)
        # the last piece may be short, but a cut must leave more than the overlap behind it
        least = start + (1 if cuts else overlap + 1)
        lo = max(least, start + (hi - start) // 2)
        i, j = np.searchsorted(where, [lo, hi + 1])
        if i == j:
            i = np.searchsorted(where, least)
        if i < j:
            k = j - 1 - int(np.argmax(depth[i:j][::-1]))
            cut = int(where[k])
        else:
            i, j = np.searchsorted(spaces, [least, hi + 1])
            cut = int(spaces[j - 1]) if i < j else hi
            if i >= j:
                while cut > lo and 0x300 <= ord(text[cut]) <= 0x36F:
                    cut -= 1
        cuts.append(cut)
        start = cut
    return cuts


def pieces(text: str, limit: int, overlap: int, block: int = 30) -> list[tuple[int, int]]:
    """(begin, end) of the pieces; from the second on each begins overlap characters before its cut."""
    cuts = cut_points(text, limit, overlap, block)
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def split_oversized(df: DataFrame, text: str, limit: int = 1500, overlap: int = 200, block: int = 30) -> DataFrame:
    """Pieces of the items of df whose text has more than limit characters.

    Gives the other columns of df, then piece (int, from 0), begin and end (int, code points of the text), piece_text.
    Columns of df with those names are dropped. Items within the limit, empty and null texts give no rows; repeated
    rows give repeated pieces; ties between valleys go to the later one. Pieces without their overlaps, put together,
    are the text. Only oversized rows leave the JVM, and nothing is shuffled.
    """
    keep = [c for c in df.columns if c not in (text, "piece", "begin", "end", "piece_text")]
    big = df.where(F.char_length(f"`{text}`") > limit).select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias("piece_text"))
    schema = big.select(*[f"`{c}`" for c in keep]).schema
    for name, kind in (("piece", T.IntegerType()), ("begin", T.IntegerType()), ("end", T.IntegerType()), ("piece_text", T.StringType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            row, num, lo, hi, out = [], [], [], [], []
            for i, t in enumerate(rb.column(rb.num_columns - 1).to_pylist()):
                for n, (a, b) in enumerate(pieces(t, limit, overlap, block)):
                    row.append(i)
                    num.append(n)
                    lo.append(a)
                    hi.append(b)
                    out.append(t[a:b])
            take = pa.array(row, pa.int64())
            cols = [rb.column(i).take(take) for i in range(rb.num_columns - 1)]
            cols += [pa.array(num, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "piece", "begin", "end", "piece_text"])

    return big.mapInArrow(run, schema)
