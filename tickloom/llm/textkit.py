"""Vectorised text primitives shared by the corpus operators.

Everything here works on the UTF-8 bytes of an Arrow string column, a slice
of a few megabytes at a time, so a worker's memory is bounded by the slice and
by the longest single document, never by the partition.

Conventions: a null text is an empty one; words are maximal runs of bytes
other than space and 0x09-0x0D; units never cross from one row to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: One odd-looking 64-bit value for each byte, so that sums of powers of the base are well spread.
BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

_powers = np.ones(1, _U)
_inverse = np.ones(1, _U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, _U(base), _U)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            globals()[name] = table
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(32)
    return x


class Prefix:
    """Polynomial hashes of any range of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        p, self.inverse = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, _U)
        np.cumsum(codes * p[: len(codes)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(_U))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def raw_text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows holding about `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each slice of a batch."""
    body, offsets = raw_text(column(batch, name))
    for lo, hi in slices(offsets, limit):
        yield lo, hi, body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross rows."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[edge] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[edge - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def run_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A 64-bit hash of each run; the byte sums are held a slice at a time."""
    out = np.empty(len(starts), _U)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        end = int(ends[hi - 1])
        out[lo:hi] = Prefix(code[body[base:end]]).of(starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out


class Words:
    """The words of a slice: byte ranges, row of each, and 64-bit hashes."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, lower: bool = False, word: np.ndarray | None = None):
        self.starts, self.ends = runs(~SPACE[body] if word is None else word[body], offsets)
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.hash = run_hashes(body, self.starts, self.ends, BYTE_CODE[LOWER] if lower else BYTE_CODE)
        #: first word of each row, and the end
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))


def shingle_hashes(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n words; a shorter non-empty row has its whole sequence as one."""
    h, first = words.hash, words.first
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    total = max(0, len(h) - n + 1)
    code = np.zeros(total, _U)
    for i in range(n):
        code = mix(code + h[i : i + total] + _U(i + 1)) if total else code
    row = words.row[:total]
    fits = row == words.row[n - 1 : n - 1 + total]
    rows, codes = row[fits], code[fits]
    if len(short):
        extra = np.array([int(_fold(h[first[r] : first[r + 1]])) for r in short], _U)
        rows, codes = np.concatenate([rows, short]), np.concatenate([codes, extra])
    return rows, codes


def _fold(h: np.ndarray) -> np.uint64:
    code = np.zeros(1, _U)
    for i, x in enumerate(h):
        code = mix(code + x + _U(i + 101))
    return code[0]


def packed(records: np.ndarray, bucket: np.ndarray, buckets: int, schema: pa.Schema) -> pa.RecordBatch:
    """One (bucket, payload) row for each bucket with records; record arrays go over a shuffle as blobs."""
    order = np.argsort(bucket, kind="stable")
    data = np.ascontiguousarray(records[order])
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges))
    offsets = np.append(edges[used], edges[-1]) * records.dtype.itemsize
    payload = pa.Array.from_buffers(pa.large_binary(), len(used), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), payload.cast(pa.binary())], schema=schema)


def unpacked(batches: list[pa.RecordBatch], dtype: np.dtype, name: str = "payload") -> np.ndarray:
    parts = [np.frombuffer(raw_text(column(b, name))[0].tobytes(), dtype) for b in batches]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
