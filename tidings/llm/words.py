"""Words and shingles of whole texts as 64-bit hashes, computed over the bytes of an Arrow batch at once.

A word is a maximal run of characters outside ``\\x20`` and ``\\x09``-``\\x0D``; A-Z count as a-z. Only ASCII bytes are
looked at, so UTF-8 is never cut inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: The bytes of terms: ASCII letters and digits, and every character beyond ASCII.
TERM = np.arange(256) >= 0x80
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=_U)
        steps[0] = 1
        known = np.cumprod(steps, dtype=_U)
        if n <= 8 * CHUNK_BYTES:
            _POWERS[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public splitmix64 constants), so that all bits of a hash are usable."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end and the offset of each text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, wherever it stands."""
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data)), out=sums[1:])
    hashes = (sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start]
    return mix(hashes + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _chunk(data: np.ndarray, cuts: np.ndarray, of_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end places of the words in ``data``; ``cuts`` are places no word reaches across."""
    is_word = of_words[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = ~is_word[:-1]
    fresh[cuts] = True
    last = np.ones(len(data), dtype=bool)
    last[:-1] = ~is_word[1:]
    last[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(is_word & fresh)
    ends = np.flatnonzero(is_word & last) + 1
    return starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch in order: their hashes, and for each text the place of its first word (one place more at
    the end). Bytes are taken in chunks that end between words, so memory doesn't grow with a text's length unless one
    single word does."""
    hashes, _, first = word_spans(data, offsets, 0)
    return hashes, first


def word_hashes_of(texts: pa.Array, of_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for the maximal runs of other bytes than those of words: ``of_words`` marks them."""
    hashes, _, first = word_spans(*batch_bytes(texts), 0, of_words)
    return hashes, first


def word_spans(data: np.ndarray, offsets: np.ndarray, suffix: int, of_words: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, with the hashes of the words' last ``suffix`` bytes where that isn't 0."""
    starts, hashes, suffixes, at = [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, _U)], 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        while end < len(data):
            gaps = np.flatnonzero(~of_words[data[max(at, end - 4096) : end]])
            if len(gaps):
                end = max(at, end - 4096) + int(gaps[-1]) + 1
                break
            cut = offsets[np.searchsorted(offsets, end, side="right") - 1]
            if cut > at:
                end = int(cut)
                break
            end = min(end + CHUNK_BYTES, len(data))
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        lowered = _LOWER[data[at:end]]
        s, e = _chunk(lowered, inside.astype(np.int64), of_words)
        starts.append(s + at)
        hashes.append(span_hashes(lowered, s, e))
        if suffix:
            suffixes.append(span_hashes(lowered, np.maximum(s, e - suffix), e))
        at = end
    return np.concatenate(hashes), np.concatenate(suffixes), np.searchsorted(np.concatenate(starts), offsets)


_WEIGHTS = mix(np.arange(1, SHINGLE + 1, dtype=_U)) | _U(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles; all its words as one shingle where there are
    fewer; nothing without words."""
    hashes, first = word_hashes(*batch_bytes(texts))
    n = len(hashes) - SHINGLE + 1
    if n > 0:
        rolled = hashes[:n] * _WEIGHTS[0]
        for k in range(1, SHINGLE):
            rolled += hashes[k : k + n] * _WEIGHTS[k]
        rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(rolled[a : b - SHINGLE + 1])
        elif b > a:
            few = (hashes[a:b] * _WEIGHTS[: b - a]).sum(dtype=_U)
            yield mix(np.array([few + _U(int(b - a))], dtype=_U))
        else:
            yield np.zeros(0, _U)


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets; the smaller is looked up in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
