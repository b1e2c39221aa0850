"""Vectorised word and shingle hashing over batches of texts (numpy inside Spark tasks).

Words are runs of bytes outside \\x20 and \\x09-\\x0D, with A-Z lower-cased, over the UTF-8
bytes of a whole text. A word's hash is 64 bits wide; equal words have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to a block's length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _BLOCK + (_BLOCK >> 4))
        have = np.full(size, _U(base & ((1 << 64) - 1)))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * _BLOCK:
            _powers[base] = have
    return have[:n]


def _block_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one block of bytes."""
    white = _WHITE[buf]
    edge = np.empty(len(buf) + 1, dtype=bool)
    edge[0] = not white[0]
    edge[-1] = not white[-1]
    np.not_equal(white[1:], white[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(buf) + 1)[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def hash_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of all words of blob, block by block."""
    starts, hashes, at, n = [], [], 0, len(blob)
    whole = np.frombuffer(blob, dtype=np.uint8)
    while at < n:
        end = min(n, at + _BLOCK)
        while end < n:  # a block ends at white space; a longer word lengthens its block
            white = np.flatnonzero(_WHITE[whole[end : end + 4096]])
            if len(white):
                end += int(white[0])
                break
            end = min(n, end + 4096)
        s, h = _block_words(whole[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def chunks(texts: list[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters each; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def words_of(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in a row, and the bounds of each text among them (length n + 1)."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    blob = b" ".join(raw)
    if lower:
        blob = blob.lower()  # of bytes: A-Z only
    starts, hashes = hash_words(blob)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return hashes, np.searchsorted(starts, offsets)


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingle hashes of one text; shorter texts are one shingle, none has none."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    take = min(k, n)
    x = np.zeros(n - take + 1, dtype=np.uint64)
    for j in range(take):
        x = mix(x * _U(3) + words[j : n - take + 1 + j])
    return np.unique(x + _U(take))
