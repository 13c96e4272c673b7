"""Words of whole texts as arrays of 64-bit hashes, and hashes of word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
CHUNK = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def split(text: str | None, lower: bool = False) -> list[bytes]:
    raw = text.encode() if text else b""
    return (raw.lower() if lower else raw).split()  # bytes: A-Z alone are lowered, ASCII white space alone splits


def _letters(lower: bool) -> np.ndarray:
    """A 64-bit number for each byte; with lower, A-Z stand for a-z."""
    at = np.arange(256, dtype=np.uint64)
    if lower:
        at[65:91] += np.uint64(32)
    return mixed(mixed((at + np.uint64(1)) * _MUL))


_TABLES = {lower: _letters(lower) for lower in (False, True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(CHUNK + 1, _BASE), _powers(CHUNK + 1, pow(_BASE, -1, 1 << 64))


def word_hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begin): hashes of all words (runs without ASCII white space) of a column of texts, and where each row's
    words begin among them, with one more place for the end. A null text has no words.

    A word's hash is a polynomial over its bytes, taken from running sums over the column's bytes, a piece at a time.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    inside = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)  # a row begins here
    cut[at] = True
    first = np.nonzero(inside & (np.append(True, ~inside[:-1]) | cut[:-1]))[0]
    last = np.nonzero(inside & (np.append(~inside[1:], True) | cut[1:]))[0]
    out = np.empty(len(first), dtype=np.uint64)
    table, i = _TABLES[lower], 0
    while i < len(first):
        lo = first[i]
        j = max(i + 1, int(np.searchsorted(last, lo + CHUNK)))  # whole words, at least one
        n = int(last[j - 1] + 1 - lo)
        up, down = (_UP, _DOWN) if n <= CHUNK else (_powers(n + 1, _BASE), _powers(n + 1, pow(_BASE, -1, 1 << 64)))
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[raw[lo : lo + n]] * up[:n], out=run[1:])
        a, z = first[i:j] - lo, last[i:j] + 1 - lo
        out[i:j] = mixed((run[z] - run[a]) * down[a] + (z - a).astype(np.uint64) * _MUL)
        i = j
    return out, np.searchsorted(first, at)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    out = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k):
        out = out * _MUL + h[i : len(h) - k + 1 + i]
    return mixed(out)


def sequence(h: np.ndarray) -> np.uint64:
    """A hash of the whole run of words and its length."""
    return np.uint64(xxhash.xxh64_intdigest(h.tobytes(), seed=len(h)))

