"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

Words are runs of bytes outside white space.  Hashing is vectorised over the bytes of a
batch: a polynomial over random byte codes by prefix sums, then a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
# Bytes hashed at once; longer words make longer pieces, so nothing is ever cut.
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers), a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = mix(np.arange(1, 257, dtype=_U) * _BASE)
_CODES[65:91] = _CODES[97:123]  # A-Z count as a-z
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, _PIECE + 1)
        full = np.full(size, base, dtype=_U)
        full[0] = 1
        have = np.cumprod(full, dtype=_U)
        if size <= 2 * _PIECE:
            _powers[key] = have
    return have


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def word_spans(texts: pa.Array, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begin and end of every word in order, and where each text's words begin (n + 1 places).

    ``gap`` marks the bytes that separate words; texts are separate too.
    """
    data, offsets = _buffers(texts)
    word = ~gap[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans are in the order of their beginnings, ASCII case is ignored."""
    out = np.empty(len(starts), dtype=_U)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(starts, starts[i] + _PIECE, "right")), i + 1)
        a, b = starts[i], int(ends[i:j].max())
        sums = np.zeros(b - a + 1, dtype=_U)
        np.cumsum(_CODES[data[a:b]] * _power(_BASE, b - a, "up")[: b - a], dtype=_U, out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        value = (sums[e] - sums[s]) * _power(_INVERSE, b - a + 1, "down")[s]
        out[i:j] = mix(value + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and for each text where its words begin (n + 1 places)."""
    data, starts, ends, at = word_spans(texts)
    return span_hashes(data, starts, ends), at


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    words, at = word_hashes(texts)
    m = len(words) - k + 1
    if m > 0:
        grams = np.full(m, k, dtype=_U)
        for j in range(k):
            grams = mix(grams * _BASE + words[j : j + m])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            h = np.full(1, b - a, dtype=_U)
            for j in range(a, b):
                h = mix(h * _BASE + words[j : j + 1])
            yield h
        else:
            yield np.zeros(0, dtype=_U)
