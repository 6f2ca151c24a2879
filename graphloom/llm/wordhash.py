"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so a word is the
same whether it is cut from UTF-8 bytes or from code points. All hashes are
64-bit and made of bijective mixing steps: a word's blocks of 8 bytes are mixed with their place
before they are added up, a run's hashes are mixed in pairs. No polynomial is evaluated, whose
terms regular texts could make cancel. All takes a few numpy passes, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by one Python worker; a longer text stands alone.
CHUNK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STRIDE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What is left of a block of 8 bytes of which only the first so many count.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype="<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the words in data, and how many words each text has.

    limits: the texts' offsets into data, len(texts) + 1 of them; a text's end
    also ends a word.
    """
    inside = ~_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(limits) - 1, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = limits[:-1][limits[:-1] < len(data)]
    begin[cut] = inside[cut]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = limits[1:][limits[1:] > 0] - 1
    finish[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.diff(np.searchsorted(starts, limits))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; lower folds A-Z. Words of up to 8 bytes have different hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = _LOWER[data] if lower else data
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    out = mix((blocks[starts] & _MASKS[np.minimum(lengths, 8)]) ^ _STRIDE)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) // 8
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        owner = np.repeat(long, more)
        part = blocks[starts[owner] + 8 * place] & _MASKS[np.minimum(lengths[owner] - 8 * place, 8)]
        out[long] += np.add.reduceat(mix(part ^ mix((place.astype(np.uint64) + np.uint64(1)) * _STRIDE)), first)
    return mix(out + lengths.astype(np.uint64) * _ODD)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + b * _ODD)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values, for one sequence or several laid end to end: runs of one, two, four and so on, joined as the bits of k say."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, covered, run, size = None, 0, hashes, 1
    while True:
        if k & size:
            out = run[:n] if out is None else _joined(out, run[covered : covered + n])
            covered += size
        if covered == k:
            return out
        run, size = _joined(run[:-size], run[size:]), 2 * size


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive runs of texts of about CHUNK_BYTES; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        part = offsets[row : stop + 1]
        yield row, data[part[0] : part[-1]], part - part[0]
        row = stop


def hashed_words(column: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words' offsets by text) for each chunk of texts."""
    for row, data, limits in text_chunks(column):
        starts, ends, counts = word_bounds(data, limits)
        yield row, word_hashes(data, starts, ends, lower), np.concatenate([[0], np.cumsum(counts)])
