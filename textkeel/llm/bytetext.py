"""Whole-batch text primitives in numpy over the UTF-8 bytes of an Arrow column.

A batch of texts is one byte array plus offsets. Words, word hashes, shingles and
windows are computed for all of them at once, without a Python loop over words.
Hashes are polynomial prefix hashes modulo 2**64 over a random byte table, passed
through a finalizer; two values are equal iff their bytes are, up to 64-bit
collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte classes of words: everything but ASCII white space; letters, digits and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
ALNUM[:0x80] = False
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, U(base), U)
    steps[:1] = U(1)
    return np.cumprod(steps, dtype=U)


_POWERS = {base: _powers(base, _BLOCK) for base in (_BASE, _INV)}
_FAR = {base: pow(base, _BLOCK, 1 << 64) for base in (_BASE, _INV)}


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(col: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of about ``limit`` bytes; a text is never cut."""
    data, offs = column_bytes(col)
    n, at = len(offs) - 1, 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1))
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def order_of(x: np.ndarray) -> np.ndarray:
    """A stable ascending order of values that are not negative. Plain values are sorted several times faster
    than places, so each value's place stands in its low bits; where that leaves out low bits of the
    values, those that differ in them alone are put right by a sort of what is nearly sorted."""
    if x.size < 2:
        return np.arange(x.size)
    x = x.astype(U, copy=False)
    places = (x.size - 1).bit_length()
    cut = max(int(x.max()).bit_length() + places - 64, 0)
    packed = x >> U(cut)
    packed <<= U(places)
    packed |= np.arange(x.size, dtype=U)
    packed.sort()
    packed &= U((1 << places) - 1)
    order = packed.view(np.int64)
    if cut:
        ordered = x[order]
        if (ordered[1:] < ordered[:-1]).any():
            order = order[np.argsort(ordered, kind="stable")]
    return order


class Prefix:
    """Prefix hashes of a byte array: the hash of any [start, end) in O(1).
    Powers are made of those within a block and those of blocks, so none are kept for the whole array."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        n = data.size
        self.c = np.zeros(n + 1, U)
        near, far, total = _POWERS[_BASE], 1, U(0)
        for at in range(0, n, _BLOCK):
            own = self.c[at + 1 : at + 1 + _BLOCK]
            np.take(table, data[at : at + _BLOCK], out=own)
            own *= near[: own.size]
            own *= U(far)
            own[:1] += total
            np.cumsum(own, out=own)
            total, far = own[-1], far * _FAR[_BASE] & 0xFFFFFFFFFFFFFFFF
        self.near, self.far = _POWERS[_INV], _powers(_FAR[_INV], n // _BLOCK + 1)

    def _back(self, at: np.ndarray) -> np.ndarray:
        return self.near[at & (_BLOCK - 1)] * self.far[at >> 16]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.c[ends] - self.c[starts]) * self._back(starts))

    def windows(self, width: int) -> np.ndarray:
        n = max(self.c.size - width, 0)
        out = self.c[width:] - self.c[:n]
        for k, at in enumerate(range(0, n, _BLOCK)):
            own = out[at : at + _BLOCK]
            own *= self.near[: own.size]
            own *= self.far[k]
        return mix(out)


def sums_by_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    out = np.zeros(len(offs) - 1, np.int64)
    full = np.flatnonzero(np.diff(offs))
    if full.size:
        out[full] = np.add.reduceat(flags, offs[:-1][full], dtype=np.int64)
    return out


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and per text the range of its words (offsets)."""
    n = data.size
    w = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def row_of(offs: np.ndarray) -> np.ndarray:
    """For items numbered through all texts, the text of each."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def shingles(words: np.ndarray, offs: np.ndarray, k: int, short_whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the text of each; with ``short_whole``
    a text of fewer words, but not none, gives its whole sequence as one."""
    n = words.size
    rows = row_of(offs)
    m = max(n - k + 1, 0)
    h = np.zeros(m, U)
    for i in range(k):
        h = h * U(0xD6E8FEB86659FD93) + words[i : i + m]
    inside = rows[:m] == rows[k - 1 : k - 1 + m] if m else np.zeros(0, bool)
    h, r = mix(h[inside]), rows[:m][inside]
    if short_whole:
        count = np.diff(offs)
        few = np.flatnonzero((count > 0) & (count < k))
        if few.size:
            extra = np.array([_sequence(words[offs[i] : offs[i + 1]]) for i in few], U)
            h, r = np.concatenate([h, extra]), np.concatenate([r, few])
            order = np.argsort(r, kind="stable")
            h, r = h[order], r[order]
    return h, r


def _sequence(words: np.ndarray) -> int:
    x = words.size
    for w in words.tolist():
        x = (x * 0xA24BAED4963EE407 + w + 1) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([x], U))[0])


def by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's values; ``rows`` ascends."""
    return np.searchsorted(rows, np.arange(n + 1))


def pack40(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key, five bytes apiece."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(blob: bytes) -> np.ndarray:
    five = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((five.shape[0], 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").ravel()
