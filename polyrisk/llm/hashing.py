"""Vectorised 64-bit hashes of words, word windows and byte windows.

A string's hash is sum(T[byte_i] * B**i) modulo 2**64 with a fixed random
table T and an odd base B, so one cumulative sum over a buffer gives the hash
of every substring; a finaliser spreads the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same table with A-Z hashed as a-z.
LOWER_TABLE = TABLE.copy()
LOWER_TABLE[65:91] = TABLE[97:123]
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
#: Odd multipliers of the places in a window of words.
PLACES = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 1 << 21:
            _powers[base] = have
    return have


def finalise(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(buf: np.ndarray, table: np.ndarray = TABLE, base: int = BASE) -> np.ndarray:
    """S with S[j] - S[i] = hash of buf[i:j] times B**i."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * powers(len(buf) + 1, base)[0][: len(buf)], out=out[1:])
    return out


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    return finalise((sums[ends] - sums[starts]) * powers(len(sums), base)[1][starts])


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words ``[^\\x20\\x09-\\x0D]+``; none crosses a row's bounds."""
    solid = ~SPACE[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = solid[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z as a-z) and each row's first word.

    Returns (hash per word, bounds) with row r's words at bounds[r]:bounds[r+1].
    """
    buf, offsets = string_buffer(column)
    starts, ends = word_spans(buf, offsets)
    hashes = window_hashes(prefix_sums(buf, LOWER_TABLE), starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of ``width`` words and each row's bounds among them.

    A row with fewer words (but at least one) has one window: all its words.
    """
    total, count = len(hashes), np.diff(bounds)
    mixed = np.zeros(max(total - width + 1, 0), np.uint64)
    for k in range(width):
        if len(mixed):
            mixed += hashes[k : k + len(mixed)] * PLACES[k]
    n = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_bounds = np.zeros(len(count) + 1, np.int64)
    np.cumsum(n, out=out_bounds[1:])
    place = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    short = np.flatnonzero((count > 0) & (count < width))
    out = np.zeros(out_bounds[-1], np.uint64)
    full = np.ones(out_bounds[-1], bool)
    full[out_bounds[short]] = False
    out[full] = mixed[place[full]]
    for k in range(width - 1):
        rows = short[count[short] > k]
        out[out_bounds[rows]] += hashes[bounds[rows] + k] * PLACES[k]
    out[out_bounds[short]] += count[short].astype(np.uint64) * PLACES[width]
    return finalise(out), out_bounds
