"""Hashes of words and character n-grams of whole texts, in numpy, the same in every process.

Words are runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. Texts are worked through in
blocks, so that memory doesn't grow with the longest text beyond the arrays returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20  #: bytes or characters worked on at once
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n + 1).bit_length())
    if size not in _tables:
        _tables[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _tables[size]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    return edge[::2], edge[1::2]


def _hash_block(data: bytes) -> np.ndarray:
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash per word, in order."""
    if len(data) <= BLOCK:
        return _hash_block(data)
    out, at = [], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not _SPACE[data[end]]:  # a block ends at white space
            end += 1
        out.append(_hash_block(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash per run of k words; of all words together where there are fewer; none without words."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return h + np.uint64(len(words) if len(words) < k else k)


def char_grams(text: str, sizes: range, bits: int) -> Iterator[np.ndarray]:
    """Buckets (of 2**bits) of all character n-grams, block by block."""
    overlap = sizes[-1] - 1
    for at in range(0, max(1, len(text)), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK + overlap].encode("utf-32-le", "surrogatepass"), np.uint32)
        last = at + BLOCK >= len(text)
        one = codes * np.uint32(2654435761) + np.uint32(40503)
        h = np.zeros(len(codes) + 1, np.uint32)
        for n in range(1, sizes[-1] + 1):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193 * 16 + 13) + (one[n - 1 :] ^ (one[n - 1 :] >> np.uint32(15)))
            if n in sizes:
                x = h if last else h[:BLOCK]
                x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D) + np.uint32(n)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
                yield x >> np.uint32(32 - bits)
