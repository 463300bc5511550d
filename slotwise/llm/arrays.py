"""Words and rolling hashes of Arrow text columns, as NumPy arrays.

A batch of texts becomes one byte buffer with a separator after every text, so
that words, windows and hashes of all its texts come from a few array passes.
A word of at most 32 bytes is hashed eight bytes at a time, mixed after each step. The
hash of a longer one sums its bytes' random values, each times a random odd factor of its
place in the word: powers of a base would do for windows of a few words, but modulo
2^64 they make regular words of 1,024 bytes collide whatever the base. Windows are
polynomials modulo 2^64 over the hashes of their words, mixed at the end; where a
hash decides, two of them with different bases are used (128 bits).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_BASE, BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
PIECE_BYTES, PIECE_ROWS = 1_000_000, 4096
HASHED_BYTES = 1 << 17
BLOCK, SHORT_WORD = 8, 32
FEW_WORDS = 4


def byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2^64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        steps = np.full(n + 1, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def place_factors(n: int) -> np.ndarray:
    """A random odd factor for each of the places 0..n-1."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(WORD_BASE)) | np.uint64(1)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that a piece holds about a megabyte of text, in 4096 rows at most.

    What earlier batches and tasks of the worker freed goes back to the system before each batch.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        give_back()
        _, offsets = text_buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + PIECE_BYTES, side="right")) - 1
            end = min(max(end, start + 1), start + PIECE_ROWS, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
BYTES_KEPT = np.array([(1 << 8 * n) - 1 for n in range(BLOCK + 1)], np.uint64)
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def ordered(keys: np.ndarray) -> np.ndarray:
    """Order of unsigned keys, equal ones as they come.

    Sorts numbers of the keys' upper bits and the place; only where keys differ in the
    lower bits alone are the keys sorted themselves.
    """
    if len(keys) == 0:
        return np.zeros(0, np.int64)
    bits = len(keys).bit_length()
    free = 64 - max(int(keys.max()).bit_length(), 1)
    packed = ((keys << np.uint64(free)) >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << bits) - 1)).view(np.int64)
    in_order = keys[order]
    return np.argsort(keys, kind="stable") if (in_order[1:] < in_order[:-1]).any() else order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct unsigned keys in order, the number of each key, and copies of each."""
    order = ordered(keys)
    in_order = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
    first = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return in_order[first], number, np.diff(np.append(first, len(keys)))


class Words:
    """Words of all texts of a column, in order.

    ``kinds`` tells for each byte whether it belongs to a word. ``hash`` is a
    64-bit hash per word, ``doc`` the row of each word, ``first`` the number of
    the first word of each row (one entry more than rows).
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, kinds: np.ndarray, lower: bool = False):
        data, offsets = text_buffers(column)
        rows = len(offsets) - 1
        padded = np.full(len(data) + rows + 1 + BLOCK, 0x20, np.uint8)
        self.bytes = padded[:-BLOCK]
        # the eight bytes from each byte on
        self._blocks = np.ndarray(len(self.bytes), "<u8", padded, strides=(1,))
        self.offsets = offsets + np.arange(rows + 1)
        for i in range(rows):
            a = self.offsets[i]
            self.bytes[a : a + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
        if lower:
            upper = (self.bytes >= 0x41) & (self.bytes <= 0x5A)
            self.bytes[upper] |= 0x20
        inside = kinds[self.bytes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(rows), self.count)
        self.hash = self._hashes()

    def heads(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The first ``size`` bytes, eight at most, from each byte of ``at``, as a number."""
        return self._blocks[at] & BYTES_KEPT[np.minimum(size, BLOCK)]

    def _hashes(self) -> np.ndarray:
        """A hash per word; a slice of words at a time, as arrays per word or byte are many times the text."""
        length = self.end - self.start
        out = np.empty(len(length), np.uint64)
        step = max(1, HASHED_BYTES // BLOCK)
        for a in range(0, len(length), step):
            start, size = self.start[a : a + step], length[a : a + step]
            h = mix(self.heads(start, size) ^ mix(size.astype(np.uint64)))
            for done in range(BLOCK, SHORT_WORD, BLOCK):
                more = np.flatnonzero(size > done)
                if len(more) == 0:
                    break
                h[more] = mix(self.heads(start[more] + done, size[more] - done) ^ h[more])
            out[a : a + step] = h
        long = np.flatnonzero(length > SHORT_WORD)
        out[long] = self._long_hashes(self.start[long], length[long])
        return out

    def _long_hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        values, factors = byte_values(), place_factors(int(length.max(initial=0)))
        ends = np.cumsum(length)
        out = np.empty(len(length), np.uint64)
        a = 0
        while a < len(length):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + HASHED_BYTES, side="right")))
            size, begin = length[a:b], ends[a:b] - length[a:b] - done  # begin: of each word in what is hashed here
            place = np.arange(ends[b - 1] - done) - np.repeat(begin, size)
            data = self.bytes[np.repeat(start[a:b], size) + place]
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * factors[place], dtype=np.uint64, out=sums[1:])
            out[a:b] = mix(sums[begin + size] - sums[begin] + size.astype(np.uint64))
            a = b
        return out

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words inside one text."""
        if len(self) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self) - size + 1] == self.doc[size - 1 :])

    def rolling(self, size: int, base: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``size`` words from each position of ``at``."""
        if size <= FEW_WORDS:
            total = self.hash[at]
            for k in range(1, size):
                total += self.hash[at + k] * np.uint64(pow(base, k, 2**64))
            return mix(total)
        up, down = powers(base, len(self))
        sums = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], dtype=np.uint64, out=sums[1:])
        return mix((sums[at + size] - sums[at]) * down[at])


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a run of ``size`` from any of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Per row, the kept words joined by one space."""
    data = words.bytes.copy()
    data[words.end[keep]] = 0x20
    change = np.zeros(len(data) + 1, np.int8)
    change[words.start[keep]] = 1
    ends = words.end[keep] + 1
    change[ends] -= 1
    mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    packed = data[mask]
    sizes = np.where(keep, words.end - words.start + 1, 0)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    bounds = sums[words.first]
    out = packed.tobytes()
    return pa.array(
        [out[a : b - 1].decode() if b > a else "" for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
        pa.string(),
    )


def give_back() -> None:
    """Return memory that earlier chunks freed to the system; both allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values ``values[bounds[i]:bounds[i+1]]``, without copying."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]
    )
