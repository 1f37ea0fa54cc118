"""Words of a batch of texts as numpy arrays over the Arrow buffer.

A word is a maximal run of bytes other than space and 0x09-0x0D, which for
UTF-8 text is the regular expression ``[^\\x20\\x09-\\x0D]+``.  No Python
string is made: texts stay in Arrow's contiguous buffer and words are
offsets into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and their offsets (one more than texts); null: empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0]:offs[-1]]
    return data, offs - offs[0]


def pieces(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together (one text at least),
    so that temporary arrays stay small whatever the batch holds."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first
    word.  ``word`` marks the bytes of words, where they are not the usual ones."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    if word is None:
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = ~word[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    start = np.flatnonzero(word & (before | cut[:-1]))
    end = np.flatnonzero(word & (after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which any span's hash is a difference."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][:len(data)], out=total[1:])
    return total


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(start):
        return np.empty(0, np.uint64)
    total = running(data) if total is None else total
    down = _powers(len(data) + 1)[1]
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
