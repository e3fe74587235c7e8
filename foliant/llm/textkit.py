"""Vectorised text primitives over Arrow buffers (numpy, no loop over rows).

A *word* is, after lower-casing, a longest run of ASCII letters and digits and of non-ASCII
characters below U+3000; every character from U+3000 on (ideographs, kana, Hangul, emoji) is a
word of its own.  All other ASCII characters separate words.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: For words that are whatever stands between ASCII white space.
SPACED = np.arange(256) > 32
#: Bytes of text worked on at once; bounds a worker's memory at about 40 times this.
CHUNK = 2_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and the offsets of its values."""
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, at, data = arr.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None or off[0] == off[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def filled(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col, "")


def strings(col: pa.Array) -> list[str]:
    """The texts, '' for null.  Bytes that aren't UTF-8 (surrogates, overlong forms, beyond U+10FFFF: columns may
    hold them, and no other step decodes them) are read as U+FFFD."""
    found = filled(col)
    try:
        return found.to_pylist()
    except UnicodeDecodeError:
        binary = pa.large_binary() if pa.types.is_large_string(found.type) else pa.binary()
        return [x.decode("utf-8", "replace") for x in found.view(binary).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + size, side="right")))
            yield b.slice(at, end - at)
            at = end


def counts_of(off: np.ndarray) -> np.ndarray:
    return np.diff(off)


def ragged(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count[0]-1, 0, 1, ... count[1]-1, ..."""
    count = np.asarray(count, np.int64)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def reduce_sum(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x over the segments between the offsets; empty segments give 0."""
    out = np.zeros((len(off) - 1, *x.shape[1:]), x.dtype)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(x, off[:-1][full], axis=0)
    return out


class Words:
    """``hash`` of each word, ``off``: the words of value i are off[i]:off[i+1];
    ``start`` and ``size`` in bytes of ``data``, the lower-case text with offsets ``byte_off``."""

    def __init__(self, arr: pa.Array, mask: np.ndarray = WORD, lower: bool = True) -> None:
        self.data, self.byte_off = data, off = raw(pc.utf8_lower(filled(arr)) if lower else filled(arr))
        if not len(data):
            self.hash, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.size, self.off = self.start, np.zeros(len(off), np.int64)
            return
        inside = mask[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        first = off[:-1][off[:-1] < off[1:]]
        begin[first] = inside[first]
        lead = data >= 0xE3
        if lead.any():
            whole = (data & 0xC0) != 0x80
            single = lead[whole][np.cumsum(whole) - 1]
            after = np.zeros_like(single)
            after[1:] = single[:-1]
            begin |= inside & whole & (single | after)
        self.start = np.flatnonzero(begin)
        b = data[inside]
        at = np.flatnonzero(begin[inside])
        self.size = np.diff(np.append(at, len(b)))
        if len(at):
            pos = ragged(self.size)
            power = np.cumprod(np.full(int(self.size.max()), BASE, np.uint64), dtype=np.uint64)
            self.hash = mix(np.add.reduceat(BYTE[b] * power[pos], at))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.off = np.searchsorted(self.start, off)

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of the words that are longer, and the places of these words."""
        at = np.flatnonzero(self.size > size)
        h = np.full(len(at), size * BASE % 2**64, np.uint64)
        for j in range(size):
            h = (h ^ BYTE[self.data[self.start[at] + j]]) * MULT[j]
        return mix(h), at


def shingles(hashes: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and their offsets; a value of 1 to k-1 words gives one, of all its words."""
    n = np.diff(off)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(off[:-1], count) + ragged(count)
    end = np.repeat(off[1:], count)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        p = at + j
        ok = p < end
        h += np.where(ok, hashes[np.minimum(p, len(hashes) - 1)] * MULT[j], np.uint64(0)) if len(at) else h
    return mix(h), out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def words_of(text: str | None) -> list[bytes]:
    """The same words, slowly; for tests and small tables."""
    import re

    found = re.findall(rb"[\xe3-\xf7][\x80-\xbf]+|(?:[0-9a-z]|[\xc2-\xe2][\x80-\xbf]+)+", (text or "").lower().encode())
    return found


class Lookup:
    """The place of 64-bit hashes in a sorted array of distinct ones; -1 where there is none."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values.astype(np.uint64))
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.values)) * 64))))
        self.mask = np.uint64((1 << min(bits, 26)) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[self.values & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are there, and their places."""
        at = np.flatnonzero(self.seen[h & self.mask])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[place] == h[at]
        return at[ok], place[ok]
