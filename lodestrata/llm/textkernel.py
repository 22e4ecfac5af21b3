"""Whole-batch numpy work on the UTF-8 bytes of an Arrow string column: words, their hashes, shingles.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased where asked. A word's 64-bit hash chains its
8-byte blocks through a keyed non-linear mix (xxh3 with a seed for long words), all words of a batch a block at a time: no
polynomial, so no family of words collides by its shape. exact_ids() numbers words by their bytes where equality counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEY = np.uint64(0x243F6A8885A308D3)
_BLOCK = np.uint64(0x13198A2E03707344)
#: The low bytes of a block that belong to a word of which so many bytes are left.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
BLOCKED = 64
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the len + 1 offsets of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = 4 * STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one longer row."""
    _, offsets = column_bytes(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of its first word (len + 1 numbers)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][(offsets[:-1] < offsets[1:])]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
    last[ends_at] = inside[ends_at]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) ^ _KEY)
    padded = np.append(np.ascontiguousarray(data), np.zeros(8, np.uint8))
    blocks = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    live = np.flatnonzero((sizes > 0) & (sizes <= BLOCKED))
    at, left, h = starts[live], sizes[live], out[live]
    while len(live):
        h = mix(h ^ mix((blocks[at] & _MASK[np.minimum(left, 8)]) + _BLOCK))
        out[live] = h
        on = left > 8
        live, at, left, h = live[on], at[on] + 8, left[on] - 8, h[on]
    for k in np.flatnonzero(sizes > BLOCKED).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), int(_KEY))
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each run of `sizes` items at `starts` of data equals that at `other_starts` of other."""
    out = np.ones(len(starts), bool)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(starts):  # in steps, so that memory stays bounded by the longest run
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        n, total = sizes[at:to], int(ends[to - 1] - (ends[at - 1] if at else 0))
        inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(starts[at:to], n) + inside] != other[np.repeat(other_starts[at:to], n) + inside]
        if differ.any():
            out[at + np.unique(np.repeat(np.arange(to - at), n)[differ])] = False
        at = to
    return out


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, the same for words of the same bytes only: hashes propose, bytes decide."""
    unique, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - starts
    wrong = sizes != sizes[first][code]
    fine = np.flatnonzero(~wrong)
    wrong[fine] = ~same_bytes(data, starts[fine], data, starts[first][code[fine]], sizes[fine])
    if wrong.any():  # other words of a known hash
        numbers: dict[bytes, int] = {}
        for k in np.flatnonzero(wrong).tolist():
            code[k] = len(unique) + numbers.setdefault(data[starts[k] : ends[k]].tobytes(), len(numbers))
    return code


def shingles(hashes: np.ndarray, firsts: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row its distinct n-word shingles as sorted hashes; fewer words make one shingle, no word none."""
    out = []
    if len(hashes) >= n:
        total = len(hashes) - n + 1
        s = np.full(total, np.uint64(n), np.uint64)
        for j in range(n):
            s = s * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + total]
            s ^= s >> np.uint64(29)
        s = mix(s)
    for lo, hi in zip(firsts[:-1], firsts[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(s[lo : hi - n + 1]))
        elif hi > lo:
            f = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for h in hashes[lo:hi]:
                    f = f * np.uint64(0xD6E8FEB86659FD93) + h
                    f ^= f >> np.uint64(29)
            out.append(mix(np.array([f])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def nested(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one numpy array a row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))
