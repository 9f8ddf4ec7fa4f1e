"""Vectorised word and n-gram hashes over the UTF-8 bytes of an Arrow string column.

A batch is cut into blocks of rows; per block, a few passes of numpy find the words of all rows and
hash them eight bytes at a time, so no Python loop runs over words, save over those of more than
LONG_WORD bytes, which are digested one by one. Runs of words are hashed by doubling: a run of 2n
words by the hashes of its halves. Every step is mixed, so that no structure of a text, such as
sequences that cancel each other in a polynomial, makes two runs alike. Hashes of 64 bits only find
candidates; what a result hangs on is compared by words or by 128-bit digests of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows are handled together up to this many bytes; a longer row is a block of its own.
BLOCK_BYTES = 1 << 20

#: Longer words are digested one by one.
LONG_WORD = 64
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_FRONT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_class(members: bytes, invert: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return ~out if invert else out


#: Words of the space-separated kind: everything but 0x20 and 0x09 to 0x0D.
SPACED = byte_class(b" \t\n\x0b\x0c\r", invert=True)
#: ASCII lower case by table.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mix(a * _ODD + b)


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number, zeros past the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def front(eight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of numbers of eight bytes the first n bytes, 0 to 8 of them."""
    return eight & _FRONT[n]


def ranges_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes raw[start:end] for each range."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + _GOLD)
    eight = lanes(raw)
    live = np.flatnonzero(size <= LONG_WORD)
    at = starts[live]
    left = size[live]
    while len(live):
        out[live] = combine(out[live], front(eight[at], np.minimum(left, 8)))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > LONG_WORD).tolist()
    if long:
        data = raw.tobytes()
        for i in long:
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def runs_hash(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k values from each place on, where there are so many, by doubling."""
    if k > len(values):
        return np.zeros(0, np.uint64)
    out, have = values, 1
    while have < k:
        step = min(have, k - have)
        out = combine(out[:-step], out[step:])
        have += step
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and len + 1 offsets; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes together, or one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(stop, rows)
        row = stop


class Words:
    """The words of consecutive rows: starts and ends in raw, row of each, first word of each row, hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        self.raw, self.offsets = raw, offsets
        rows = len(offsets) - 1
        inside = member[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        if len(raw):
            before[offsets[:-1][offsets[:-1] < len(raw)]] = False
            after[offsets[1:] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets, "left")
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.counts)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = ranges_hash(self.raw, self.starts, self.ends)
        return self._hashes

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of k words within a row; a row of fewer words, but not none, is one run."""
        heads = np.flatnonzero(self.first[1:][self.row] - np.arange(len(self.starts)) >= k)
        found, places = [runs_hash(self.hashes, k)[heads]], [heads]
        for n in range(1, k):
            firsts = self.first[:-1][self.counts == n]
            if len(firsts):
                out = np.full(len(firsts), n, np.uint64)
                for i in range(n):
                    out = combine(out, self.hashes[firsts + i])
                found.append(out)
                places.append(firsts)
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        return np.concatenate(found)[order], place[order]


def column_words(column: pa.Array, member: np.ndarray, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, Words) for each block of the column."""
    raw, offsets = text_bytes(column)
    for row, stop in blocks(offsets, limit):
        part = raw[offsets[row] : offsets[stop]]
        yield row, stop, Words(LOWER[part] if lower else part, offsets[row : stop + 1] - offsets[row], member)
