"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), with A-Z folded to lower case. A word's hash is
a polynomial over its bytes modulo 2**64, read off a running sum and then mixed, so whole batches are hashed without a Python
loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_LOOSE = np.full(256, 32, np.uint8)
_LOOSE[48:58] = np.arange(48, 58)
_LOOSE[97:123] = np.arange(97, 123)
_LOOSE[65:91] = np.arange(97, 123)
_LOOSE[128:] = np.arange(128, 256)

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_pows: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _pows.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK + 1), base, np.uint64)
        x[0] = 1
        have = _pows[base] = np.multiply.accumulate(x)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into runs of rows of about ``block`` bytes: (first row, end row, bytes, offsets in bytes).

    Nulls count as empty; one longer text makes a run of its own.
    """
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in ``raw``, and for each text the index of its first word (with the total at the end)."""
    solid = ~_SPACE[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = solid
    after = before[1:].copy()
    cut = offsets[1:-1]
    cut = cut[cut < len(raw)]
    left = before[:-1].copy()
    left[cut] = False
    right = np.empty(len(raw), bool)
    right[:-1] = after[1:]
    right[-1:] = False
    right[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(solid & ~left)
    ends = np.flatnonzero(solid & ~right) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span ``raw[start:end]`` (spans in order, not overlapping), A-Z folded to lower case."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        at, to = int(starts[i]), int(ends[j - 1])
        part = raw[at:to]
        part = (_LOWER[part] if fold else part).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(part * _powers(_P, to - at), out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix64((sums[e] - sums[s]) * _powers(_P_INV, to - at)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def loose(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the Latin-1 capitals (C3 80 to C3 9E but for the multiplication sign) in lower case, and every
    ASCII character but letters and digits as a space. Lengths stay."""
    out = _LOOSE[raw]
    capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[1:][capital] += np.uint8(32)
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's first word (with the total at the end)."""
    starts, ends, first = word_spans(raw, offsets)
    return span_hashes(raw, starts, ends), first


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` neighbouring words: entry i covers words i to i+n-1."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix64(out + words[k : k + m] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
    return out
