"""Numpy and Arrow helpers that the operators run inside Spark tasks.

Every function works on one Arrow batch. ``slices`` cuts a batch by bytes, so the memory of a
task is bounded by ``SLICE_BYTES`` plus its longest text, never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 12 << 20


def plain_texts(column: pa.Array) -> pa.Array:
    """The column as large strings with null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` of at most about ``limit`` bytes of text; one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
    for i, start in enumerate(edges):
        stop = edges[i + 1] if i + 1 < len(edges) else batch.num_rows
        yield batch.slice(start, stop - start)


def list_offsets(lists: pa.Array) -> np.ndarray:
    """Offsets of a list or string array from 0, for its flattened values."""
    ends = np.asarray(pc.list_value_length(lists) if not pa.types.is_large_string(lists.type) else pc.binary_length(lists), dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ends)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a large string array as one uint8 array, and the offsets of its rows."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def from_bytes(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Large string array over ``flat`` cut at ``offsets``."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[starts[i] : starts[i] + lengths[i]]`` over all i."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    at = np.arange(ends[-1], dtype=np.int64)
    at += np.repeat(starts - (ends - lengths), lengths)
    return values[at]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def segment_ids(offsets: np.ndarray) -> np.ndarray:
    """Number of the segment of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= _MIX[0]
        x ^= x >> np.uint64(27)
        x *= _MIX[1]
        x ^= x >> np.uint64(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts with A-Z lower-cased, flattened, and row offsets."""
    flat, offsets = text_bytes(texts)
    lists = pc.split_pattern(from_bytes(_FOLD[flat], offsets), " ")
    found, ends = lists.flatten(), list_offsets(lists)
    full = np.asarray(pc.binary_length(found)) > 0
    kept = np.concatenate([[0], np.cumsum(full)])
    return found.filter(pa.array(full)), kept[ends]


def word_hashes(found: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each different word is hashed once a batch."""
    import xxhash

    coded = found.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return hashes[np.asarray(coded.indices)] if len(hashes) else np.zeros(0, np.uint64)
