"""Vectorised access to the words of Arrow string batches.

A batch of texts is one byte buffer. Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]`` (those bytes never occur inside a multi-byte UTF-8
character, so byte runs and character runs agree). Hashes of 64 bits are made
without a Python object per word: bytes are taken eight at a time, words of a
window two halves at a time, and every step goes through a bijective mixer, so
no sum or product cancels over structured texts (equal-length words of up to
eight bytes never share a hash). Nulls are treated as empty texts by every
function here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by a Python worker; bounds memory, not results.
CHUNK_BYTES = 2 << 20
#: Longer spans of bytes are hashed one by one by the library.
LONG_SPAN = 256

_U = np.uint64
_ODD, _TURN = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_START = (np.arange(256) & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start .. start + count - 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes of each span; another seed gives independent hashes."""
    size = ends - starts
    out = mix(size.astype(_U) * _TURN + _U(seed))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    long = size > LONG_SPAN
    left, at = np.flatnonzero(~long), 0
    while len(left):
        part = eight[starts[left] + at] & _MASK[np.minimum(size[left] - at, 8)]
        out[left] = mix(out[left] ^ (part * _ODD + _U(at)))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(long).tolist():
        raw = hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(raw.digest(), "little")
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD + (b ^ (a >> _U(32))))


def window_hashes(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of values[i : i + width] for every i; halves are put together, so a window costs about log2(width) steps."""
    if len(values) < width:
        return np.zeros(0, _U)
    block, have, step = mix(values + _U(seed)), 0, 1
    out = block
    while True:
        if width & step:
            if have:
                n = len(values) - have - step + 1
                out = _pair(out[:n], block[have : have + n])
            else:
                out = block
            have += step
        if 2 * step > width:
            return out
        block = _pair(block[: len(block) - step], block[step:])
        step *= 2


class Texts:
    """Words of a slice of texts.

    ``starts``/``ends`` are byte offsets in ``buf``, ``doc`` the text's index in the
    slice, ``first`` the index of each text's first word (one more entry at the end).
    """

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        self.n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        lo = int(off[0])
        self.buf = np.frombuffer(data, np.uint8)[lo : int(off[-1])] if data is not None and off[-1] > lo else np.zeros(0, np.uint8)
        self.off = off - lo
        space = np.ones(len(self.buf) + 1, bool)
        np.take(_SPACE, self.buf, out=space[:-1])
        edge = np.zeros(len(self.buf) + 1, bool)  # a text's end also ends its last word
        edge[self.off] = True
        before = np.r_[True, space[:-1]] | edge
        self.starts = np.flatnonzero(~space & before)
        after = np.r_[space[1:] | edge[1:], True]
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """Hash of each word."""
        return span_hashes(self.buf, self.starts, self.ends, seed)

    def chars(self) -> np.ndarray:
        """Code points in each word."""
        sums = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(_START[self.buf], out=sums[1:])
        return sums[self.ends] - sums[self.starts]

    def windows(self, values: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of `width` words inside one text."""
        if len(values) < width:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        inside = np.flatnonzero(self.doc[: len(values) - width + 1] == self.doc[width - 1 :])
        return inside, window_hashes(values, width, seed)[inside]

    def per_text(self, index: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(index, weights, minlength=self.n)[: self.n]

    def spaced(self, which: np.ndarray) -> tuple[memoryview, list[int], list[int]]:
        """(bytes, starts, ends): the words with these rising numbers, those of a text joined by one space."""
        n = self.ends[which] - self.starts[which] + 1
        flat = np.append(self.buf, np.uint8(32))[ragged(self.starts[which], n)]
        ends = np.cumsum(n)
        flat[ends - 1] = 32
        bounds = np.append(0, ends)[np.searchsorted(which, self.first)]
        return memoryview(np.ascontiguousarray(flat)), bounds[:-1].tolist(), np.maximum(bounds[:-1], bounds[1:] - 1).tolist()


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most CHUNK_BYTES of text, or one row."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + CHUNK_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end
