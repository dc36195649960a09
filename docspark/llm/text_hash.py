"""Vectorised 64-bit hashes of words and of five-word shingles, over Arrow buffers.

Everything works on UTF-8 bytes without making Python strings: a batch of
texts is one byte buffer with offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U64 = np.uint64
#: Bytes hashed at once; bounds the arrays that a long text needs.
SEGMENT = 1 << 21
#: An odd multiplier, its inverse modulo 2**64, and those of a shingle's words.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_powers: dict[str, np.ndarray] = {}

_bytes = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, the rest as it is.
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: Words as runs of bytes other than ASCII white space.
NOT_SPACE = ~np.isin(_bytes, [0x20, *range(0x09, 0x0E)])
#: Words as runs of ASCII letters and digits and of everything outside ASCII.
WORD_CHARACTERS = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U64) * _U64(_BASE))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        out = np.full(max(n, SEGMENT + 1), _BASE if which == "up" else _INVERSE, dtype=_U64)
        out[0] = 1
        _powers[which] = have = np.cumprod(out, dtype=_U64)
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets into them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    found = np.frombuffer(offsets, np.int64 if wide else np.int32)
    found = found[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[found[0] : found[-1]], found - found[0]


def groups(offsets: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows of about ``size`` bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words in order, and the row of each."""
    if len(data) == 0:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    inside = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    out = np.empty(len(starts), _U64)
    k = 0
    while k < len(starts):  # by segments that hold whole words
        m = max(k + 1, int(np.searchsorted(ends, starts[k] + SEGMENT, "right")))
        low, high = starts[k], ends[m - 1]
        n = int(high - low)
        part = _BYTE_VALUES[LOWER[data[low:high]]]
        part *= _power("up", n)
        sums = np.zeros(n + 1, _U64)
        np.cumsum(part, out=sums[1:])
        s = starts[k:m] - low
        out[k:m] = (sums[ends[k:m] - low] - sums[s]) * _power("down", n + 1)[s]
        k = m
    return mix(out), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside a row, and the row of each.

    With ``short``, a row of fewer words gives one hash of its whole sequence.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    m = n - size + 1
    out, at = np.zeros(0, _U64), np.zeros(0, np.int64)
    if m > 0:
        total = words[:m] * _U64(_PLACES[0])
        for j in range(1, size):
            total += words[j : j + m] * _U64(_PLACES[j])
        whole = rows[:m] == rows[size - 1 :]
        out, at = mix(total[whole] + _U64(size)), rows[:m][whole]
    if short:
        of, begin, count = np.unique(rows, return_index=True, return_counts=True)
        few = np.flatnonzero(count < size)
        if len(few):
            extra = [
                sum(int(words[begin[i] + j]) * _PLACES[j] for j in range(count[i])) + int(count[i]) & (1 << 64) - 1
                for i in few
            ]
            out = np.concatenate([out, mix(np.array(extra, _U64))])
            at = np.concatenate([at, of[few]])
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows begins in the sorted ``rows``; n + 1 values."""
    return np.searchsorted(rows, np.arange(n + 1))
