"""Vectorised text kernels over Arrow batches.

Every function works on a whole slice of documents at once: ``data`` is the
UTF-8 bytes of all texts one after the other (uint8) and ``offs`` are the
``D + 1`` byte offsets of the documents in it.  A null text counts as empty.
Hashes are 64-bit polynomial hashes with fixed constants, so they agree
between executors, runs and retries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; bounds the temporary arrays, not the texts.
SLICE_BYTES = 1 << 20


def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x = x * U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


_BYTE = _splitmix(256, 7)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_Q = 0xC2B2AE3D27D4EB4F | 1
_QINV = pow(_Q, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}

#: The word separators of the contracts: space and U+0009 to U+000D.
SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` mod 2**64 for i below n."""
    got = _POW.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, U)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if size <= 8 * SLICE_BYTES:
            _POW[base] = got
    return got[:n]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end)."""
    if not len(starts):
        return np.empty(0, U)
    pre = np.empty(len(data) + 1, U)
    pre[0] = 0
    np.cumsum(_BYTE[data] * powers(_R, len(data)), out=pre[1:])
    h = (pre[ends] - pre[starts]) * powers(_RINV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(U) * U(0x632BE59BD9B4E019))


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive values: len - k + 1 of them."""
    n = len(values)
    if n < k:
        return np.empty(0, U)
    pre = np.empty(n + 1, U)
    pre[0] = 0
    np.cumsum(values * powers(_Q, n), out=pre[1:])
    return mix((pre[k:] - pre[: n + 1 - k]) * powers(_QINV, n + 1)[: n + 1 - k] + U(k))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, and the D + 1 word offsets of the documents."""
    inside = ~SEP[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offs[(offs > 0) & (offs < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def owner(ptr: np.ndarray) -> np.ndarray:
    """The document index of each item, from the D + 1 item offsets."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def doc_grams(wordhash: np.ndarray, wptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie inside one document, and the word index where each begins."""
    g = gram_hash(wordhash, k)
    if not len(g):
        return g, np.empty(0, np.int64)
    doc = owner(wptr)
    ok = doc[: len(g)] == doc[k - 1 :]
    at = np.flatnonzero(ok)
    return g[at], at


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, data, offs) for slices of about ``limit`` bytes; a longer text is a slice of its own."""
    arr = batch.column(batch.schema.get_field_index(column)) if isinstance(batch, pa.RecordBatch) else batch
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    elif pa.types.is_string(arr.type) or pa.types.is_binary(arr.type):
        kind = np.int32
    else:
        arr, kind = arr.cast(pa.string()), np.int32
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    n = len(arr)
    if not n:
        return
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi - lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ranges [start, start + len)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def unique_per_doc(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each document in ascending order, and the D + 1 offsets."""
    d = owner(ptr)
    order = np.lexsort((values, d))
    v, d = values[order], d[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.searchsorted(d, np.arange(len(ptr)))
