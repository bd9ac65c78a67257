"""Vectorised scans over the bytes of Arrow text columns.

Every text operator of this subpackage that leaves the JVM works on whole Arrow batches:
a batch is cut into pieces of a few megabytes, the texts of a piece are one byte array
with document offsets, and words, hashes and windows are numpy arrays over it. A null
text has no bytes. One text is never cut, so memory follows the longest text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WINDOW = 0xD6E8FEB86659FD93
_WINDOW_INV = pow(_WINDOW, -1, 1 << 64)
#: Numbers whose powers are in a table, and that are summed at a time; a power of two.
_BLOCK = 1 << 15


class _Kept(dict):
    """A cache that stays where it is: functions travel with an empty one."""

    def __reduce__(self):
        return _Kept, ()


_POWERS: dict[int, np.ndarray] = _Kept()


def space_words() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def plain_words() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ (text in lower case)."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte array for all texts and len + 1 offsets into it; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of about `limit` text bytes, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times, for all i."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each document's offsets into those."""
    inside = table[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _BLOCK) + 1, base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64, from two small tables however large the exponents."""
    high = at // _BLOCK
    out = powers(pow(base, _BLOCK, 1 << 64), int(high.max(initial=0)) + 1)[high]
    out *= powers(base, _BLOCK)[at % _BLOCK]
    return out


def weighted_sums(x: np.ndarray, base: int, plus: int = 0) -> np.ndarray:
    """For each place, the sum of (x[i] + plus) * base**i over all i before it, modulo 2**64; little is held besides."""
    sums = np.zeros(len(x) + 1, np.uint64)
    for a in range(0, len(x), _BLOCK):
        part = x[a : a + _BLOCK].astype(np.uint64)
        part += np.uint64(plus)
        part *= powers(base, len(part))
        part *= np.uint64(pow(base, a, 1 << 64))
        part[0] = (int(part[0]) + int(sums[a])) % (1 << 64)
        np.cumsum(part, out=sums[a + 1 : a + 1 + len(part)])
    return sums


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64 bits stirred, so that any of them can serve as a bucket."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each byte span, from prefix sums modulo 2**64."""
    sums = weighted_sums(buf, _BASE, 1)
    h = (sums[ends] - sums[starts]) * power_at(_BASE_INV, starts)
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(word_hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of `width` words inside one document each.

    Returns the first word of each window, its hash, and document offsets into those.
    """
    sums = weighted_sums(word_hashes, _WINDOW)
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    at = spread(offsets[:-1], counts)
    h = mixed((sums[at + width] - sums[at]) * power_at(_WINDOW_INV, at))
    return at, h, np.concatenate([[0], np.cumsum(counts)])


def gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after the other, with their offsets; with gap, that byte after each."""
    lengths = ends - starts
    if gap is None:
        return buf[spread(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(offsets[-1]), gap, np.uint8)
    out[spread(offsets[:-1], lengths)] = buf[spread(starts, lengths)]
    return out, offsets


def squeezed(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, all lowest bytes first, which later compression likes."""
    x = np.ascontiguousarray(x, "<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return struct.pack("<IB", len(x), width) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unsqueezed(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The numbers (uint64), and where the bytes after them begin."""
    n, width = struct.unpack_from("<IB", data, at)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 5).reshape(width, n).T
    return wide.reshape(-1).view("<u8"), at + 5 + n * width


class HashIndex:
    """Places of 64-bit hashes among up to some millions of them; numpy arrays only."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(8, int(len(hashes)).bit_length())
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.bucket = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in `keys`, -1 where it isn't there."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        at, stop = self.bucket[slot], self.bucket[slot + 1]
        rest = np.flatnonzero(at < stop)
        at, stop, h = at[rest], stop[rest], h[rest]
        while len(rest):
            same = self.keys[at] == h
            out[rest[same]] = at[same]
            on = ~same & (at + 1 < stop)
            rest, at, stop, h = rest[on], at[on] + 1, stop[on], h[on]
        return out
