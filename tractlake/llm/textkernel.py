"""Vectorised text kernels shared by the operators: words, shingles, windows.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z are
lower-cased. Both rules act on UTF-8 bytes, so they never split a character.
"""

from __future__ import annotations

import numpy as np

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes handled at once by the vectorised kernels.
SLICE_BYTES = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.empty(size, dtype=U64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] = sum of (byte+1) * MULT**position over data[i:j]."""
    out = np.empty(len(data) + 1, dtype=U64)
    out[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers(_MULT, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes in each [start, end), wherever they stand."""
    raw = (prefix[end] - prefix[start]) * powers(_INV, len(prefix))[start]
    return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    values = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    return [b"" if x is None else x for x in values.to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Index ranges of neighbouring texts of about ``limit`` bytes together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and the bounds of each text in them."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    space = _SPACE[data]
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[0] = False
    np.logical_not(space, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    hashes = span_hashes(prefix_hashes(data), start, end)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    bounds[1:] = np.searchsorted(start, ends)
    return hashes, bounds


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out = out * U64(_MULT) + words[j : j + n]
    return mix(out + U64(k))


def shingles_in_order(words: np.ndarray, bounds: np.ndarray, k: int):
    """Per text the hashes of its k-word shingles, in order and with repeats.

    A text with fewer words, but some, has its whole sequence as its one shingle.
    """
    runs = combine(words, k)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield runs[lo : hi - k + 1]
        elif hi > lo:
            yield combine(words[lo:hi], hi - lo)
        else:
            yield runs[:0]


def shingle_sets(texts: list[bytes], k: int):
    """Per text the sorted distinct hashes of its k-word shingles."""
    for lo, hi in slices(texts):
        words, bounds = word_hashes(texts[lo:hi])
        for run in shingles_in_order(words, bounds, k):
            run = np.sort(run)
            yield run[np.concatenate(([True], run[1:] != run[:-1]))] if len(run) else run


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
