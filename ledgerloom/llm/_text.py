"""Vectorised words, word hashes, exact word numbers and word-window hashes over Arrow string columns.

Texts are worked on as UTF-8 bytes. Every separator class used here is ASCII, so a byte table decides word
membership without decoding. Work is cut into blocks of whole rows of about ``BLOCK_BYTES``, which bounds memory
whatever the batch; one longer text is a block of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_INV = pow(_BASE, -1, 1 << 64)


def byte_class(separators: bytes) -> np.ndarray:
    """256 booleans, true for bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words ``[^\x20\x09-\x0D]+``.
NON_SPACE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Words longer than this are hashed by a cryptographic digest.
LONG_WORD = 96


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self) -> None:
        self.pow = np.ones(1, U)
        self.inv = np.ones(1, U)

    def upto(self, n: int) -> None:
        while len(self.pow) < n + 1:
            k = len(self.pow)
            self.pow = np.concatenate([self.pow, self.pow * U(pow(_BASE, k, 1 << 64))])
            self.inv = np.concatenate([self.inv, self.inv * U(pow(_INV, k, 1 << 64))])


POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges (first, last) whose bytes stay under the limit where single rows allow it."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to
    pa.default_memory_pool().release_unused()


class Words:
    """The words of a block of rows: byte spans, the row of each word, and row_ptr with the words of each row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: np.ndarray = SAME) -> None:
        offsets = offsets - offsets[0]
        n = len(raw)
        self.raw = raw if fold is SAME else fold[raw]
        self.offsets = offsets
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = table[self.raw]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut)).astype(np.int64)
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut)).astype(np.int64)
        self.row_ptr = np.searchsorted(self.starts, offsets, "left").astype(np.int64)
        self.count = np.diff(self.row_ptr)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self._hashes(self.ends)

    def prefix_hashes(self, k: int) -> np.ndarray:
        """A hash of each word's first k bytes (of the whole word if shorter)."""
        return mix(self._hashes(np.minimum(self.ends, self.starts + k)) + U(k * 7919))

    def _hashes(self, ends: np.ndarray) -> np.ndarray:
        """Eight bytes at a time, each step through the finaliser, so that no arithmetic relation between words carries over."""
        length = ends - self.starts
        out = mix(length.astype(U) + U(_BASE))
        if not len(length):
            return out
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.raw, np.zeros(8, np.uint8)]), 8)
        open_ = np.flatnonzero(length <= LONG_WORD)
        for step in range(0, LONG_WORD, 8):
            open_ = open_[length[open_] > step]
            if not len(open_):
                break
            chunk = np.ascontiguousarray(eight[self.starts[open_] + step]).view(U).ravel()
            left = np.minimum(length[open_] - step, 8).astype(U)
            chunk &= U(0xFFFFFFFFFFFFFFFF) >> (U(64) - left * U(8))
            out[open_] = mix((out[open_] ^ chunk) * U(_BASE))
        for i in np.flatnonzero(length > LONG_WORD):
            word = self.raw[self.starts[i] : ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def numbers(self) -> np.ndarray:
        """A number for each word; equal numbers are equal bytes, compared and not only hashed."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        size = self.ends - self.starts
        off = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(int(off[-1])) + np.repeat(self.starts - off[:-1], size)
        data = pa.py_buffer(np.ascontiguousarray(self.raw[place]))
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), data])
        return words.dictionary_encode().indices.to_numpy().astype(np.int64)

    def fits(self, k: int) -> np.ndarray:
        """For each word, whether k words from it on lie in its row."""
        return np.arange(len(self.starts)) + k <= self.row_ptr[self.row + 1]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of h[i:i+k] for each i where the array has k more; empty if there is none."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    POWERS.upto(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * POWERS.pow[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * POWERS.inv[: n - k + 1] + U(k))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value (the first among equals) in each run of width values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = values[:n].copy()
    where = np.arange(n, dtype=np.int64)
    for j in range(1, width):
        other = values[j : j + n]
        less = other < best
        best[less] = other[less]
        where[less] = np.flatnonzero(less) + j
    return where


def runs(position: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of consecutive positions over which all of same stay equal."""
    if not len(position):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(position), bool)
    new[1:] = position[1:] != position[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(position))


def split_binary(values: np.ndarray, order: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[order] cut at cuts (len groups + 1), each piece as one binary value."""
    width = values.dtype.itemsize
    data = np.ascontiguousarray(values[order] if order is not None else values)
    off = (cuts.astype(np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


_ZSTD = pa.Codec("zstd", 3)


def pack(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each value of a string or binary array compressed, and its size; nulls are empty."""
    raw, offsets = buffers(column)
    data = memoryview(raw)
    out = [_ZSTD.compress(data[a:b], asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return pa.array(out, pa.binary()), pa.array(np.diff(offsets).astype(np.int32))


def unpack(packed: pa.Array, sizes: pa.Array) -> pa.Array:
    """The binary values that pack() compressed."""
    data = [_ZSTD.decompress(x.as_buffer(), n, asbytes=True) if n else b"" for x, n in zip(packed, sizes.to_pylist())]
    return pa.array(data, pa.large_binary())


def gram_numbers(numbers: np.ndarray, k: int) -> np.ndarray:
    """A number for numbers[i:i+k] at each i where the array has k more; equal numbers are equal runs (by prefix doubling)."""
    if len(numbers) < k:
        return np.zeros(0, np.int64)
    rank, length = np.unique(numbers, return_inverse=True)[1].astype(np.int64), 1
    while length < k:
        step = min(length, k - length)
        both = rank[: len(rank) - step] * (len(numbers) + 1) + rank[step:]
        rank, length = np.unique(both, return_inverse=True)[1].astype(np.int64), length + step
    return rank


def digest(data: bytes) -> bytes:
    """128 bits of the SHA-256 of a text's words, given its bytes as folded: runs of white space are one space."""
    return hashlib.sha256(b" ".join(data.split())).digest()[:16]
