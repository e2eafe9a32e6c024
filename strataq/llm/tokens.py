"""Words of whole columns of text as numpy arrays of 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows are taken in chunks of about so many bytes of text; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Bytes of a chunk that are gone through at a time.
PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _bytes_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


TABLE = _bytes_table(7)
#: The same with A-Z as a-z.
FOLDED = TABLE.copy()
FOLDED[65:91] = TABLE[97:123]
#: \x20 and \x09-\x0D
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]).cumprod(dtype=np.uint64) for b in (_ODD, _INV))
    up, down = _powers[size]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each run, from one running sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of some PIECE bytes that end at a blank; a longer word is within one."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        while end < n:
            cut = np.flatnonzero(BLANK[data[max(at, end - PIECE) : end]])
            if len(cut):
                end = max(at, end - PIECE) + int(cut[-1]) + 1
                break
            end = min(end + PIECE, n)
        yield at, end
        at = end


class Words:
    """Words of some texts: hashes, byte spans within data, and first[i]:first[i + 1], the words of text i.

    What is as long as the bytes is made for a piece at a time, so a very long text costs memory by its words alone.
    """

    __slots__ = ("data", "ends", "first", "hashes", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        self.data = data
        table = FOLDED if fold else TABLE
        starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, end in _pieces(data):
            part = data[at:end]
            inside = np.zeros(end - at + 2, bool)
            inside[1:-1] = ~BLANK[part]
            first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
            # texts follow one another without a blank
            cut = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "left")] - at
            cut = cut[inside[cut] & inside[cut + 1]]
            first[cut] = last[cut] = True
            s, e = np.flatnonzero(first), np.flatnonzero(last)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(run_hashes(table[part], s, e))
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in (starts, ends, hashes))
        self.first = np.searchsorted(self.starts, offsets)

    def text(self, i: int, j: int) -> bytes:
        return self.data[self.starts[i] : self.ends[j - 1]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of about so many bytes each."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(column: pa.Array, *, fold: bool, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    for i, j, data, offsets in chunks(column, most):
        yield i, j, Words(data, offsets, fold)


def grams(w: Words, k: int, *, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and first[i]:first[i + 1] of text i.

    short: a text of fewer words, but not none, has one run of them all.
    """
    n = np.diff(w.first)
    count = np.maximum(n - k + 1, 0)
    if short:
        count = np.where((n > 0) & (n < k), 1, count)
    first = np.concatenate([[0], np.cumsum(count)])
    starts = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], count)
    ends = np.minimum(starts + k, np.repeat(w.first[1:], count))
    return run_hashes(w.hashes, starts, ends), first
