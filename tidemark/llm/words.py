"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space and 0x09 to 0x0D; in UTF-8 these
bytes never occur inside a longer character, so splitting bytes is splitting
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Byte ranges up to this length are hashed in steps of eight bytes at once, longer ones each for itself.
SHORT = 64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours in h."""
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += h[j : len(h) - k + 1 + j]
    return mixed(out)


class Text:
    """Some rows of a text column: their bytes, and where each row begins and ends."""

    def __init__(self, column: pa.Array, first: int):
        column = column.cast(pa.large_string())
        self.first, self.n = first, len(column)
        _, offsets, data = column.buffers()
        if len(column) == 0 or offsets is None:
            self.at, self.bytes = np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
            return
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.at = at - at[0]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[at[0] : at[-1]]

    def words(self, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and its row; words are parted by the bytes that `apart` marks."""
        b = self.bytes
        if len(b) == 0:
            none = np.zeros(0, np.int64)
            return none, none, none
        word = ~apart[b]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edges = self.at[1:-1]
        edges = edges[(edges > 0) & (edges < len(b))]
        begins[edges] = word[edges]
        ends[edges - 1] = word[edges - 1]
        start = np.flatnonzero(begins)
        row = np.searchsorted(self.at[1:], start, side="right")
        return start, np.flatnonzero(ends) + 1, row

    def spaced(self, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with A-Z as a-z and one space for each run of `apart` after a word, and where each old byte is now.

        Words of a row that follow each other are one range of these bytes, joined by single spaces.
        """
        word = ~apart[self.bytes]
        keep = word.copy()
        keep[1:] |= word[:-1]
        place = np.cumsum(keep)
        place -= keep
        return np.where(word, _FOLD[self.bytes], np.uint8(0x20))[keep], place

    def hashes(self, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
        """64-bit hash of each byte range; with fold, A-Z count as a-z.

        Every eight bytes are mixed into the hash by a bijection, so ranges of up
        to eight bytes never collide and others as rarely as random values do.
        """
        data = np.zeros(len(self.bytes) + 8, np.uint8)
        data[:-8] = _FOLD[self.bytes] if fold else self.bytes
        lanes = np.ndarray(len(self.bytes) + 1, "<u8", data.data, strides=(1,))
        length = end - start
        h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        todo, at = np.arange(len(start)), start
        for k in range(0, SHORT, 8):
            left = length[todo] - k
            h[todo] = mixed(h[todo] ^ (lanes[at] & _MASK[np.minimum(left, 8)]))
            more = left > 8
            if not more.any():
                return h
            todo, at = todo[more], at[more] + 8
        for i in todo:
            h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
        return h


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[Text]:
    """The column cut between rows into parts of about `limit` bytes and at most `rows` rows, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    row = 0
    while row < len(column):
        stop = min(row + rows, max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1))
        yield Text(column.slice(row, stop - row), row)
        row = stop
