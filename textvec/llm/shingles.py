"""Vectorised hashing of words and word n-grams of a batch of texts, on the raw UTF-8 bytes.

Words are `[^\\x20\\x09-\\x0D]+`.  All functions work on a whole batch at once: `hashes` holds one
64-bit hash per word, texts one after another, and `counts` the number of words of each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import LOWER

_MIX1, _MIX2, _BASE, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_FOLD = np.frombuffer(LOWER, dtype=np.uint8)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Masks of the lowest k bytes.
_CUT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit matters to every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


#: Bytes up to which words are hashed eight bytes at a time, all words at once; longer ones one by one.
LANES = 64


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the places where its texts begin, one more at the end."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that stand one after another, and the number of each text's; space: the bytes between words."""
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), counts
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[begins[begins > 0] - 1] = word[begins[begins > 0] - 1]
    counts += np.diff(np.searchsorted(starts, offsets))
    return starts, np.flatnonzero(last) + 1, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    size = ends - starts
    # eight bytes at any place as one number; a word's last number is cut to its own bytes
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mixed(size.astype(np.uint64) * _BASE)
    left = np.where(size <= LANES, size, 0)
    some = np.flatnonzero(left)
    at, left = starts[some], left[some]
    while len(some):
        own = lanes[at] & _CUT[np.minimum(left, 8)]
        h[some] = mixed(h[some] ^ own)
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LANES).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return h


def word_hashes(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the texts of a column; fold: A-Z count as a-z."""
    data, offsets = text_buffer(column)
    starts, ends, counts = word_spans(data, offsets)
    return span_hashes(_FOLD[data] if fold else data, starts, ends), counts


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words, over the batch as a whole (texts' ends included).

    Runs of 1, 2, 4, ... words are joined two by two and mixed each time; two runs of the largest
    such size, which may overlap, make n.
    """
    if len(h) < n:
        return np.empty(0, np.uint64)
    size, out = 1, h
    while size * 2 <= n:
        out = mixed(out[:-size] * _STEP + out[size:])
        size *= 2
    return mixed(out[: len(h) - n + 1] * _STEP + out[n - size : n - size + len(h) - n + 1]) if size < n else out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    if len(x) < n:
        return np.empty(0, x.dtype)
    size = 1
    out = x
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if size < n else out


def inside(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the batch) of the n-grams that lie in one text, and the text of each."""
    ends = np.cumsum(counts)
    many = np.maximum(0, counts - n + 1)
    text = np.repeat(np.arange(len(counts)), many)
    starts = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends - counts, many)
    return starts, text
