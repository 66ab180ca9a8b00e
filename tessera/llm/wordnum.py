"""Words of whole batches of texts as arrays: bounds, 64-bit hashes and rolling hashes, all in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased before hashing.
Hashes are polynomials modulo 2**64 in an odd base, so that a span's hash is a difference of
prefix sums times an inverse power; mix() then spreads the bits.
"""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Sum over each span of values[i] * base ** (i - start), modulo 2**64."""
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=pre[1:])
    return (pre[ends] - pre[starts]) * powers(inverse(base), len(values) + 1)[starts]


def lower(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and n + 1 offsets of each text's words among them."""
    n = len(raw)
    ink = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:n]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    return mix(span_sums(lower(raw).astype(np.uint64) + np.uint64(1), starts, ends, base))


def gram_hashes(words: np.ndarray, k: int, base: int = BASES[1]) -> np.ndarray:
    """Hashes of the k-word windows starting at each word but the last k - 1."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - k + 1)
    return mix(span_sums(words, at, at + k, base))


def slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each window of w values, by doubling; len(x) - w + 1 results."""
    span, out = 1, x
    while span < w:
        step = min(span, w - span)
        out = op(out[:-step], out[step:])
        span += step
    return out
