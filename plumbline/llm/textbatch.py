"""Vectorised views of Arrow string batches: bytes, tokens, hashes, shingles.

Everything works on the UTF-8 bytes of many texts laid end to end, so that a
batch costs a few numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:  # arrays of over 256 kB go back to the system when they are freed, so that idle workers stay small
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 1 << 18)
except (OSError, AttributeError):  # another C library
    _libc = None

U64 = np.uint64
#: Text bytes that one numpy pass works on; bounds a worker's memory.
CHUNK_BYTES = 1 << 20
def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have at least so many bytes."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= least and batch.num_rows:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
    if sum(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len+1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with about ``limit`` bytes of text; a longer text is a chunk alone."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


#: Masks of the first 0 to 8 bytes of a block.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _salts(nth: np.ndarray, seed: int) -> np.ndarray:
    return mix(nth.astype(U64) * U64(0x9E3779B97F4A7C15) + U64((seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % 2**64))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal bytes wherever they stand.

    A range is cut into blocks of eight bytes; every block is mixed with its
    place before the blocks are summed, so no relation between the bytes of two
    ranges that is linear modulo 2**64 makes their hashes equal.  Different
    seeds give independent hashes.
    """
    starts, sizes = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    block = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    total = mix((block[starts] & _MASKS[np.minimum(sizes, 8)]) ^ _salts(np.zeros(1, np.int64), seed))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) >> 3
        first = np.cumsum(more) - more
        of = np.repeat(np.arange(len(long)), more)
        nth = np.arange(len(of)) - first[of] + 1
        own = block[starts[long][of] + 8 * nth] & _MASKS[np.minimum(sizes[long][of] - 8 * nth, 8)]
        total[long] += np.add.reduceat(mix(own ^ _salts(np.arange(int(more.max()) + 1), seed)[nth]), first)
    return mix(total ^ mix(sizes.astype(U64) + U64(seed)))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes that stay within one text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def is_space(data: np.ndarray) -> np.ndarray:
    """Space, tab, line feed, vertical tab, form feed, carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without white space), and len+1 offsets into them by text."""
    starts, ends = runs(~is_space(data), offsets)
    return hash_ranges(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(tokens: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words; a shorter text that has words gives one, of all its words."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(sizes)), counts)
    at = offsets[:-1][doc] + (np.arange(out[-1]) - out[:-1][doc])
    total = np.zeros(out[-1], U64)
    end = offsets[1:][doc]
    for k in range(width):
        here = np.minimum(at + k, max(len(tokens) - 1, 0))
        part = mix(tokens[here] + U64((k + 1) * 0xA0761D6478BD642F % 2**64)) if len(tokens) else total
        total += np.where(at + k < end, part, U64(0))
    return mix(total), out


def unique_by_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], np.searchsorted(doc[keep], np.arange(len(offsets)))
