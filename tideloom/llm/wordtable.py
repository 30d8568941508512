"""Token ids of words, encoded once per distinct word and gathered by word hash.

All supported vocabularies split at ASCII white space before they merge, so a
text's ids are its words' ids in order. A Python worker keeps the words it has
seen in sorted arrays; the size is bounded and a full table starts anew.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from tideloom.llm.textarrays import Texts, ragged

#: Distinct words kept by a worker (about 30 bytes each).
MAX_WORDS = 2_000_000


#: Joins words; no word holds a line feed.
_LF = 10


def joined(texts: Texts, which: np.ndarray) -> str:
    """The words with these numbers, joined by line feeds."""
    size = texts.ends[which] - texts.starts[which] + 1
    at = ragged(texts.starts[which], size)
    out = np.append(texts.buf, np.uint8(_LF))[at]
    out[np.cumsum(size) - 1] = _LF
    return out[:-1].tobytes().decode("utf-8", "replace")


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum())), count


class _Json:
    """Plain words by batched merges, others by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from tideloom.llm.batchbpe import BatchedBPE

        self.tokenizer, self.batched = Tokenizer.from_file(path), BatchedBPE(path)

    def __call__(self, texts: Texts, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = self.batched.plain(texts.buf, texts.starts[which], texts.ends[which])
        count = np.zeros(len(which), np.int64)
        found = []
        if plain.any():
            ids, count[plain] = self.batched.encode(joined(texts, which[plain]))
            found.append((plain, ids))
        if not plain.all():
            words = joined(texts, which[~plain]).split("\n")
            ids, count[~plain] = _flat([self.tokenizer.encode(w, add_special_tokens=False).ids for w in words])
            found.append((~plain, ids))
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for chosen, ids in found:
            out[ragged(start[chosen], count[chosen])] = ids
        return out, count


class _Piece:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: Texts, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.model.encode(joined(texts, which).split("\n"), num_threads=1))


class _Ranks:
    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: Texts, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _flat([self.encoding.encode_ordinary(" " + w) for w in joined(texts, which).split("\n")])


class WordTable:
    """Maps word hashes to token ids. `encode` gives the ids of words met for the first time, flat, and how many each has."""

    def __init__(self, encode: Callable[[Texts, np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(1024, np.int32)
        self.used = 0

    def _add(self, keys: np.ndarray, texts: Texts, which: np.ndarray) -> None:
        if len(self.keys) + len(keys) > MAX_WORDS:
            self.clear()
        flat, count = self.encode(texts, which)
        total = len(flat)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, self.used), np.int32)])
        self.ids[self.used : self.used + total] = flat
        start = self.used + np.cumsum(count) - count
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.count = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.start, start), (self.count, count)))

    def lookup(self, texts: Texts, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(start in self.ids, count) of the ids of each word of `texts`; words: see distinct_words."""
        distinct, first, back = words
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            new = ~known if len(self.keys) + (~known).sum() <= MAX_WORDS else np.ones(len(known), bool)
            self._add(distinct[new], texts, first[new])
            at = np.searchsorted(self.keys, distinct)
        return self.start[at][back], self.count[at][back]


def distinct_words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, a word with each, number of each word's hash)."""
    return np.unique(hashes, return_index=True, return_inverse=True)


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """This worker's table for a vocabulary file."""
    if path not in _tables:
        kind = path.rpartition(".")[2]
        _tables[path] = WordTable({"json": _Json, "model": _Piece, "tiktoken": _Ranks}[kind](path))
    return _tables[path]
