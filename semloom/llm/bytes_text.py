"""UTF-8 text as numpy arrays: Arrow buffers, words, rolling hashes. No Python object per word or character."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one vectorised step works on; temporaries are some tens of times this. A longer document is a step of its own.
STEP_BYTES = 1 << 19
#: Text bytes after which a worker gives memory that it no longer uses back to the machine; it would keep it for the next stage otherwise.
TRIM_BYTES = 16 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RI = np.uint64(pow(int(_R), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}

#: Bytes of a word when punctuation separates: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of a word when only white space separates.
SOLID = np.zeros(256, bool)
SOLID[33:] = True
SOLID[127] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def to_string(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string array without nulls (a null becomes empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; offsets start at 0."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of whole texts, of about ``limit`` bytes each."""
    body, offsets = buffers(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    _used[0] += len(body)
    if _used[0] >= TRIM_BYTES:
        _used[0] = 0
        trim()


_used = [0]
_libc: list = []


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda _: 0)
    _libc[0](0)


def lower(b: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters (two bytes in UTF-8); other letters stay as they are."""
    out = _LOWER[b]
    if len(b) > 1:
        at = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)) + 1
        out[at] += 0x20
    return out


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the maximal runs of bytes that are inside, cut at text borders."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    first[full] = inside[full]
    end = offsets[1:][np.diff(offsets) > 0] - 1
    last[end] = inside[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("r", ())) < n:
        m = 1 << max(20, (n - 1).bit_length())
        r, ri = np.full(m, _R), np.full(m, _RI)
        r[0] = ri[0] = 1
        r, ri = np.multiply.accumulate(r), np.multiply.accumulate(ri)
        if m > 1 << 20:  # a long text; not kept
            return r, ri
        _pow["r"], _pow["ri"] = r, ri
    return _pow["r"], _pow["ri"]


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of b[starts[i]:ends[i]], from one running sum over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    r, ri = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * r[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * ri[starts] + (ends - starts).astype(np.uint64))


def hash_words(found: list[str]) -> np.ndarray:
    """``span_hashes`` of single strings, as they are."""
    if not found:
        return np.zeros(0, np.uint64)
    raw = [w.encode() for w in found]
    ends = np.cumsum([len(x) for x in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)


def per_text(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index, weights=weights, minlength=n)
