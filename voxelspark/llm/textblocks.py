"""Words of whole texts as numpy arrays over Arrow buffers.

A block is a run of rows whose texts lie next to each other in one byte buffer. Words are byte ranges; their
64-bit hashes come from prefix sums of a polynomial in the bytes, so no Python object is made per word.
Blocks hold about ``BLOCK_BYTES`` of text (a longer text is a block by itself), whatever the batch holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE, _MUL, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15 | 1), _U(0xD6E8FEB86659FD93), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_INV = _U(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words cut at white space: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables[:] = [_powers(_BASE, max(n, BLOCK_BYTES + 1)), _powers(_INV, max(n, BLOCK_BYTES + 1))]
    return _tables


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), which are ordered and disjoint."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK_BYTES, "right")))
        part = buf[lo : int(ends[j - 1])]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _MUL)
        i = j
    return out


def hash_word(word: str | bytes) -> int:
    """The hash that a single word gets."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(hash_ranges(raw, np.array([0]), np.array([len(raw)]))[0])


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k neighbours in h; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    acc = np.full(n, _U(k), _U)
    for j in range(k):
        acc = acc * _MUL + h[j : j + n]
    return mix(acc)


class Block:
    """Words of consecutive texts: ``starts``/``ends`` are byte ranges in ``buf`` (A-Z lowered), ``first[i]:first[i+1]`` are text i's words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.buf, self.offsets = LOWER[raw], offsets
        inside = table[self.buf]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        begin[full] = inside[full]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        end[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.buf, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return raw, o - o[0]


def slices(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes of text, or one longer text."""
    raw, offs = texts_of(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def blocks(column: pa.Array, table: np.ndarray):
    """(first row, end row, Block) over a string column."""
    for i, j, raw, offs in slices(column):
        yield i, j, Block(raw, offs, table)


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): k-word shingles of each text, text i's at first[i]:first[i+1]. Fewer words than k, but not none: the sequence is one shingle."""
    h = block.hashes()
    n = block.counts
    many = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(first[-1], _U)
    run = chain(h, k)
    enough = n >= k
    # the run hashes that do not cross a text's end, in order
    keep = np.zeros(len(h) + 1, np.int32)
    np.add.at(keep, block.first[:-1][enough], 1)
    np.add.at(keep, block.first[1:][enough] - k + 1, -1)
    inside = np.cumsum(keep)[: len(run)] > 0
    slot = np.ones(first[-1], bool)
    short = np.flatnonzero((n > 0) & ~enough)
    slot[first[:-1][short]] = False
    out[slot] = run[inside]
    for i in short:
        out[first[i]] = chain(h[block.first[i] : block.first[i + 1]], int(n[i]))[0]
    return out, first
