"""Vectorised word arithmetic on Arrow columns, shared by the text operators.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), as in every contract here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the pair hash; any odd constants of high weight do.
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def slices(batch, column: str, limit: int = 4 << 20):
    """Zero-copy slices of a batch or table with about `limit` bytes of text each, one row at least: a worker's arrays
    follow the slice, not the batch that Spark happens to send."""
    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        part = np.cumsum(sizes.astype(np.int64)) // limit
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def column(batch, name: str) -> pa.Array:
    """The column as one array with null texts as empty ones."""
    col = batch.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return _rebuilt(pc.fill_null(col.cast(pa.large_string()), ""))


def _rebuilt(texts: pa.Array, table: np.ndarray | None = None) -> pa.Array:
    """The texts in buffers of their own that begin at 0, their bytes mapped by a table.  Arrow's ascii_lower returns broken
    texts for some slices of longer arrays, so no kernel gets a slice and lower() does without it."""
    if not len(texts):
        return pa.array([], pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    body = body if table is None else table[body]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(np.ascontiguousarray(body)))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased."""
    return _rebuilt(texts, _LOWER)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """bounds, codes, vocabulary: the words of text i are vocabulary[codes[bounds[i]:bounds[i + 1]]]."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.r_[0, np.cumsum(keep.to_numpy(zero_copy_only=False))]
    ends = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]
    coded = flat.filter(keep).dictionary_encode()
    return kept[ends.astype(np.int64)].astype(np.int64), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def raw(vocabulary: pa.Array) -> list[bytes]:
    return vocabulary.cast(pa.large_binary()).to_pylist()


def hashes(vocabulary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each vocabulary entry, the same in every process."""
    return hash_bytes(raw(vocabulary), seed)


def hash_bytes(items: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in items), np.uint64, len(items))


def flat_ids(items: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ends, ids: the 32-bit ids of items[codes[i]] are ids[ends[i]:ends[i + 1]]."""
    size = (np.fromiter(map(len, items), np.int64, len(items)) // 4)[codes] if len(items) else np.empty(0, np.int64)
    data = pa.array(items, pa.large_binary()).take(pa.array(codes)).buffers()[2]
    return np.r_[0, np.cumsum(size)], np.frombuffer(data, "<u4", int(size.sum())) if data is not None else np.empty(0, "<u4")


def mix(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> np.uint64(32))
    z = z * _C
    return z ^ (z >> np.uint64(29))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of (a, b), order kept."""
    return mix(a * _A + b * _B)


def window_hashes(x: np.ndarray, length: int, known: dict | None = None) -> np.ndarray:
    """Names of all windows of `length` items, by doubling: a window is named by the two halves that cover it.  known: names
    of shorter windows by length, to go on from."""
    if length == 1:
        return x
    if known and length in known:
        return known[length]
    half = (length + 1) // 2
    h = window_hashes(x, half, known)
    return pair(h[: len(h) - (length - half)], h[length - half :]) if len(x) >= length else np.empty(0, np.uint64)


def leftmost_min(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost least item of every window of `span` items, by doubling."""
    at, size, low = np.arange(len(h)), 1, h
    while size < span:
        step = min(size, span - size)
        left = low[:-step] <= low[step:]
        at, low = np.where(left, at[:-step], at[step:]), np.where(left, low[:-step], low[step:])
        size += step
    return at


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(keys), bool)
    i = np.searchsorted(known, keys)
    return known[np.minimum(i, len(known) - 1)] == keys
