"""Word tokens of a batch of texts as numpy arrays, without a Python object per word.

A token is a maximal run of ASCII letters and digits and of non-ASCII characters, lower-cased for
ASCII and Latin-1 letters. Its hash is a polynomial of its bytes modulo 2 ** 64, mixed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))
SLICE = 1 << 20  # bytes hashed at once


class Tokens(NamedTuple):
    hashes: np.ndarray  # uint64, all documents of the batch one after another
    first: np.ndarray  # int64, the first token of each document, and the number of tokens


def lowered(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[upper] += 0x20
    return out


def tokens(texts: pa.Array) -> Tokens:
    """Null texts have no tokens."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0 or texts.null_count == n:
        return Tokens(np.empty(0, np.uint64), np.zeros(n + 1, np.int64))
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    low, high = bounds[0], bounds[-1]
    raw = np.frombuffer(data, np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
    bounds = bounds - low
    if not len(raw):
        return Tokens(np.empty(0, np.uint64), np.zeros(n + 1, np.int64))
    text = lowered(raw)
    word = _IS_WORD[text]
    cut = np.zeros(len(text) + 1, dtype=bool)
    cut[bounds] = True
    open_ = word.copy()
    open_[1:] &= ~word[:-1] | cut[1:-1]
    close = word.copy()
    close[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(open_), np.flatnonzero(close) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        k = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
        a, b = starts[i], ends[k - 1]
        lengths = np.diff(np.append(starts[i:k], b))
        place = np.arange(b - a) - np.repeat(starts[i:k] - a, lengths)
        value = (text[a:b].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095] * word[a:b]
        hashes[i:k] = np.add.reduceat(value, starts[i:k] - a)
        i = k
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    return Tokens(hashes, np.searchsorted(starts, bounds))
