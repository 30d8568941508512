"""Byte-level BPE of many words at once in numpy, for vocabularies with word ends.

Words of one length form a matrix of symbols. Every step finds each row's
lowest-ranked pair, merges it and looks up the two pairs that arise, until no row
has a pair left: the same merges, in the same order, as one word at a time.
"""

from __future__ import annotations

import json

import numpy as np
import regex

#: Code points below this have a context-free lower case and no combining marks.
PLAIN_BELOW = 0x250
_NONE = np.int32(2**31 - 1)


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in keep}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(keep)))
    return [out[b] for b in range(256)]


class BatchedBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"] + r"|\n")
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + self.end] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of each row, left-aligned, and how many there are."""
        n, width = symbols.shape
        size = np.full(n, width)
        rank = np.full((n, width), _NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self._rank(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(n)
        column = np.arange(width)
        while len(rows):
            sub = rank[rows]
            at = sub.argmin(axis=1)
            best = sub[np.arange(len(rows)), at]
            go = best < _NONE
            rows, at, best, sub = rows[go], at[go], best[go], sub[go]
            if not len(rows):
                break
            own = symbols[rows]
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            own = np.take_along_axis(own, shift, 1)
            sub = np.take_along_axis(sub, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            k = np.arange(len(rows))
            own[k, at] = self.merged[best]
            size[rows] -= 1
            sub[k, np.minimum(size[rows], width) - 1] = _NONE
            last = at + 1 >= size[rows]
            nxt = np.minimum(at + 1, width - 1)
            sub[k, at] = np.where(last, _NONE, self._rank(own[k, at], own[k, nxt]))
            has = at > 0
            sub[k[has], at[has] - 1] = self._rank(own[k[has], at[has] - 1], own[k[has], at[has]])
            symbols[rows], rank[rows] = own, sub
        return symbols, size

    def plain(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words have only characters below PLAIN_BELOW and no start of a special token."""
        odd = buf >= 0xC0 + (PLAIN_BELOW >> 6)
        odd[:-1] |= (buf[:-1] == ord("<")) & (buf[1:] == ord("|"))
        sums = np.r_[0, np.cumsum(odd)]
        return sums[ends] == sums[starts]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of plain words joined by line feeds."""
        parts = "\n".join(self.pattern.findall(text.lower()))
        raw = np.frombuffer(parts.encode() + b"\n", np.uint8)
        stop = np.flatnonzero(raw == 10)
        begin = np.r_[0, stop[:-1] + 1]
        sizes = stop - begin
        owner = np.cumsum(sizes == 0) // 2  # a line feed between words stands as two empty parts
        begin, owner = begin[sizes > 0], owner[sizes > 0]
        sizes = sizes[sizes > 0]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = np.zeros(len(sizes), np.int64)
        for width in np.unique(sizes):
            which = np.flatnonzero(sizes == width)
            step = max(1, 1_000_000 // int(width))
            for lo in range(0, len(which), step):
                some = which[lo : lo + step]
                part = raw[begin[some][:, None] + np.arange(width)]
                symbols = self.inner[part]
                symbols[:, -1] = self.final[part[:, -1]]
                symbols, size = self._merge(symbols)
                count[some] = size
                found.append((some, symbols, size))
        start = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.int32)
        for some, symbols, size in found:
            inside = np.arange(symbols.shape[1]) < size[:, None]
            ids[(start[some][:, None] + np.arange(symbols.shape[1]))[inside]] = symbols[inside]
        return ids, np.bincount(owner, count, text.count("\n") + 1).astype(np.int64)
