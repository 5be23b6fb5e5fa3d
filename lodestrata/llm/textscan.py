"""Vectorised scans of whole text columns: words, window hashes, anchors.

The functions work on one *chunk*: the UTF-8 bytes of several documents laid end
to end (``buf``) and the document borders (``off``, one more entry than there are
documents).  Nothing here loops over characters, words or windows in Python.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: Random values for bytes and odd multipliers, the same in every process.
BYTE_A = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BYTE_B = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
BASE = U(0x5851F42D4C957F2D)
BASE_B = U(0x2545F4914F6CDD1D)


def inverse(odd: int) -> np.uint64:
    """The inverse of an odd number modulo 2**64."""
    x, y = int(odd), 1
    for _ in range(7):
        y = y * (2 - x * y) % 2**64
    return U(y)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n; kept between chunks."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, inverse(base)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        have = _POWERS[int(base)] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> U(31))
    h *= U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def prefix(values: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Prefix sums of a polynomial hash, one more entry than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base)[0], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hashes of the stretches start..end (end excluded) from prefix sums."""
    inv = powers(len(pre), base)[1]
    return mix((pre[end] - pre[start]) * inv[start])


def byte_class(members: str) -> np.ndarray:
    """A table of 256 flags from a set of excluded ASCII characters."""
    flags = np.ones(256, bool)
    flags[np.frombuffer(members.encode("ascii"), np.uint8)] = False
    return flags


#: Words of whitespace-separated text: ``[^\x20\x09-\x0D]+``.
SPACED = byte_class(" \t\n\v\f\r")
#: Words of letters and digits: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (byte positions) and, per document border, the number of words before it."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = member[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = off[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """One 64-bit hash per word; other: an independent second hash."""
    table, base = (BYTE_B, BASE_B) if other else (BYTE_A, BASE)
    return spans(prefix(table[buf], base), starts, ends, base)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items, len(h) - k + 1 of them (none if shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * ODD[0]
    for j in range(1, k):
        out += h[j : j + n] * ODD[j]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values; len(x) - w + 1 of them."""
    if len(x) < w:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < w:
        x = np.minimum(x[: len(x) - (w - have)], x[w - have :])
    return x


#: Bits of a position inside a chunk; the rest of an anchor's sort key is its hash.
POS_BITS = 32
_LOW = U((1 << POS_BITS) - 1)


def anchors(h: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive gram hashes the position of the least (the leftmost of equals)."""
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    return (sliding_min(key, w) & _LOW).astype(np.int64)


def superwindows(h: np.ndarray, w: int, span: int, item_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor.

    h: gram hashes at each item; a window is ``span`` items and so ``w`` grams;
    item_off: document borders in items.  Equal windows choose the same anchor,
    wherever they stand, so all occurrences of a window meet under its hash.
    Returns document number, first window's item, number of windows, anchor's item.
    """
    at = anchors(h, w)
    total = item_off[-1]
    doc_len = np.diff(item_off)
    valid = np.zeros(total + 1, np.int8)
    has = doc_len >= span
    valid[item_off[:-1][has]] += 1
    valid[item_off[1:][has] - span + 1] -= 1
    ok = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)[: len(at)]
    s = np.flatnonzero(ok)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    a = at[s]
    new = np.empty(len(s), bool)
    new[0] = True
    # the next document's first window can't follow directly: the last span - 1 items start none
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
    if span == 1:
        new |= np.isin(s, item_off)
    first = np.flatnonzero(new)
    start = s[first]
    n = np.diff(np.append(first, len(s)))
    doc = np.searchsorted(item_off, start, side="right") - 1
    return doc, start, n, a[first]
