"""Vectorised scanning of Arrow text batches.

Every text operator of this subpackage reads whole texts as one UTF-8 byte buffer with
document offsets and works on NumPy arrays over it, so no Python code runs per word or per
byte.  Hashes mix after every eight bytes or every item, so no input makes them collide by its
structure as it does with sums of powers; where equality decides a result, `equal_ranges` compares
the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at a time; bounds the memory of one step (a longer
#: document is a step of its own).
STEP_BYTES = 1 << 20
#: Most keys that `sliding_argmin` takes at a time, as a power of two.
PLACE_BITS = 22
#: Ranges of more bytes are hashed and compared one by one.
LONG_RANGE = 1024

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_A, _B, _SEED = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0x2545F4914F6CDD1D)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two things in order, from their hashes."""
    x = a * _A
    x ^= x >> _U(32)
    x += b
    x *= _B
    x ^= x >> _U(29)
    return x


def octets(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on, as a number; zeros follow the end."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 8,), "<u8", padded, strides=(1,))


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """The hash of bytes [start, end) for each pair: eight bytes at a time, the few long ranges by BLAKE2."""
    eight = octets(buf) if eight is None else eight
    size = ends - starts
    h = mix(size.astype(np.uint64) ^ _SEED)
    long = np.flatnonzero(size > LONG_RANGE)
    for k in long.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]], digest_size=8).digest(), "little")
    live, at, left = None, starts, size
    if len(long):
        live = np.flatnonzero(size <= LONG_RANGE)
        at, left = starts[live], size[live]
    while len(at):
        piece = eight[at] & _MASK[np.minimum(left, 8)]
        if live is None:
            h = join(h, mix(piece))
        else:
            h[live] = join(h[live], mix(piece))
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return mix(h)


def equal_ranges(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """Whether `size` bytes from a equal those from b, byte by byte, for each pair."""
    eight = octets(buf) if eight is None else eight
    same = np.ones(len(a), bool)
    live = np.flatnonzero((a != b) & (size > 0))
    long = live[size[live] > LONG_RANGE]
    for k in long.tolist():
        same[k] = np.array_equal(buf[a[k] : a[k] + size[k]], buf[b[k] : b[k] + size[k]])
    live = live[size[live] <= LONG_RANGE]
    at, to, left = a[live], b[live], size[live]
    while len(live):
        ok = ((eight[at] ^ eight[to]) & _MASK[np.minimum(left, 8)]) == 0
        same[live[~ok]] = False
        more = np.flatnonzero(ok & (left > 8))
        live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
    return same


class Windows:
    """Hashes of every run of k consecutive items, for any k, built from runs of half the length.

    Items are bytes or 64-bit words that are hashes already.
    """

    def __init__(self, items: np.ndarray):
        self.n = len(items)
        if items.dtype == np.uint8:  # runs of eight bytes are read as they are
            self.least, self.levels = 8, {8: mix(octets(items)[: max(0, self.n - 7)])}
        else:
            self.least, self.levels = 1, {1: items}
        self.items = items

    def level(self, k: int) -> np.ndarray:
        if k not in self.levels:
            half = self.level(k // 2)
            m = max(0, self.n - k + 1)
            self.levels[k] = join(half[:m], half[k // 2 : k // 2 + m])
        return self.levels[k]

    def of(self, k: int) -> np.ndarray:
        """One hash for each of the n - k + 1 runs."""
        m = self.n - k + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        if k < self.least:
            at = np.arange(m)
            return range_hashes(self.items, at, at + k)
        h, done = None, 0
        for p in range(k.bit_length() - 1, -1, -1):
            if k >> p & 1:
                if 1 << p < self.least:  # the last few bytes: a run that overlaps
                    part, done = self.level(self.least)[k - self.least :][:m], k
                else:
                    part = self.level(1 << p)[done:][:m]
                    done += 1 << p
                h = part if h is None else join(h, part)
                if done == k:
                    break
        return mix(h)


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets; a null text is an empty one."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def steps(offs: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold at most `limit` bytes each, or one document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def scan(col: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one after the last, bytes, offsets) of each step over a column."""
    buf, offs = text_buffer(col)
    for i, j in steps(offs, limit):
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each document the index of its first word.

    A word is a run of bytes other than 0x20 and 0x09-0x0D inside one document.
    """
    if not len(buf):
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    a, b = offs[:-1][full], offs[1:][full] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def of_docs(first: np.ndarray) -> np.ndarray:
    """The document of each item, given the index of each document's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_argmin(key: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost smallest key of every w consecutive ones."""
    n = len(key) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # the low bits hold the position, so the smallest is the leftmost of equals; as many bits for every length
    bits = _U(PLACE_BITS)
    packed = ((key >> bits) << bits) | np.arange(len(key), dtype=np.uint64)
    low = (_U(1) << bits) - _U(1)
    if w == 1:
        return np.arange(n)
    pad = -len(key) % w
    blocks = np.concatenate([packed, np.full(pad, ~_U(0), np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)
