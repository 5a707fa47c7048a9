"""Vectorised word scanning over whole Arrow batches.

A batch's texts lie one after another in one UTF-8 buffer. Bytes are classed by a table of 256 entries,
words are the runs of word bytes inside each text, and a word's 64-bit value is mixed from its bytes,
eight at a time for all words at once, so no Python code runs per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)
LONG_WORD = 1024
#: Sub-batches hold about so many bytes of text (and one text at least), which bounds a worker's memory.
SLICE_BYTES = 1 << 20


def word_table(kind: str) -> np.ndarray:
    """``alnum``: ASCII letters and digits and everything beyond ASCII; ``nonspace``: all but 0x20 and 0x09-0x0D."""
    t = np.zeros(256, bool)
    if kind == "alnum":
        t[0x30:0x3A] = t[0x61:0x7B] = t[0x41:0x5B] = True
        t[0x80:] = True
    else:
        t[:] = True
        t[0x20] = False
        t[0x09:0x0E] = False
    return t


LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[0x41:0x5B] += 32


def text_buffer(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = pc.fill_null(array, "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    off = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` balanced by bytes of ``column``."""
    _, off = text_buffer(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = min(end, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _values(low: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A value for each word: its bytes in groups of eight, mixed one group after another; the length is mixed in.

    Words of over LONG_WORD bytes (text without any separators) are digested whole.
    """
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    groups = np.ndarray((len(low),), dtype="<u8", buffer=padded, strides=(1,))
    value = length.astype(U) * U(0x9E3779B97F4A7C15)
    rows = np.flatnonzero(length <= LONG_WORD)
    done = 0
    while len(rows):
        left = length[rows] - done
        part = groups[first[rows] + done] & _MASK[np.minimum(left, 8)]
        value[rows] = mix(value[rows] ^ part) + U(done)
        done += 8
        rows = rows[left > 8]
    for i in np.flatnonzero(length > LONG_WORD):
        value[i] = int.from_bytes(hashlib.blake2b(low[first[i] : first[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return value


def words(data: np.ndarray, off: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, document) of every word, A-Z lower-cased, in order. ``start`` is a byte position in ``data``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER_TABLE[data]
    inside = word_table(kind)[low]
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    flips = np.concatenate([[0] * bool(inside[0]), flips, [n] * bool(inside[-1])]).astype(np.int64)
    cut = np.unique(off[(off > 0) & (off < n)])
    cut = cut[inside[cut - 1] & inside[cut]]  # one text ends in a word and the next begins with one
    first, last = flips[0::2], flips[1::2]
    if len(cut):
        at = np.searchsorted(first, cut)
        first, last = np.insert(first, at, cut), np.insert(last, at - 1, cut)
    value = _values(low, first, last - first)
    return value, first, np.searchsorted(off, first, "right") - 1


def word_value(word: str) -> int:
    """The value of one word, as ``words`` gives it."""
    b = np.frombuffer(word.encode(), np.uint8)
    v, _, _ = words(b, np.array([0, len(b)]), "nonspace")
    return int(v[0])


def chain(values: np.ndarray, n: int) -> np.ndarray:
    """The value of each run of ``n`` consecutive entries."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = values[:m].copy()
    for k in range(1, n):
        out = mix(out * U(0x9E3779B97F4A7C15) + values[k : k + m])
    return out
