"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is cut into units at which no piece can cross: blanks start a new unit, and
characters that no longer piece contains stand alone. Units of one length advance
together: hashes of all their substrings probe the sorted piece keys, and at every end
position vectorised maxima over the piece lengths store backpointers.

Models of kind unigram take the segmentation with the largest sum of scores. Models of
kind BPE have ranks for scores, and what their merges produce is not the largest sum: a
segmentation is theirs exactly if every two neighbouring pieces, put together and merged
again, come out as the same two. For them the maxima run over 0 and minus infinity, by
that test of the candidate and the piece before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tideloom.llm.common import small_batches, table, vocabulary
from tideloom.llm.textarrays import Texts, ragged, slices, span_hashes
from tideloom.llm.wordtable import WordTable, distinct_words

BLANK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.float64(-1e18)
#: Pairs of pieces whose fit a worker keeps, and cells of a batch.
MAX_PAIRS, CELLS = 1_000_000, 400_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message's fields: varints, byte strings and fixed-width bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
            yield key >> 3, value
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = varint(at)
            yield key >> 3, data[at : at + size]
            at += size


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row of code points, with a zero column first."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return out


class Units:
    """The units of a slice of texts as spans of one byte buffer, in which a space stands for the blank sign.

    ``signs`` tells which texts hold the blank sign itself, which does not come back.
    """

    def __init__(self, column: pa.Array, model: PieceModel):
        texts = Texts(column)
        buf, off = texts.buf, texts.off
        sign = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81))
        self.signs = np.bincount(np.searchsorted(off, sign, "right") - 1, minlength=texts.n)[: texts.n] > 0
        if len(sign):
            buf = buf.copy()
            buf[sign] = 32
            buf = np.delete(buf, np.concatenate([sign + 1, sign + 2]))
            off = off - 2 * np.searchsorted(sign, off)
        if model.prefix:
            full = np.diff(off) > 0
            buf = np.insert(buf, off[:-1][full], 32)
            off = off + np.append(0, np.cumsum(full))
        blank, lone = buf == 32, model.lone[buf]
        new = lone.copy()
        new[1:] |= lone[:-1] | (blank[1:] & ~blank[:-1])
        new[off[:-1][np.diff(off) > 0]] = True
        self.buf, self.off, self.starts = buf, off, np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], len(buf))[: len(self.starts)]
        self.first = np.searchsorted(self.starts, off)


class PieceModel:
    """A model file's pieces and their segmentation of texts."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            spec = list(_fields(file.read()))
        self.piece: list[str] = []
        score: list[float] = []
        kind: list[int] = []
        for value in (v for k, v in spec if k == 1):
            part = dict(_fields(value))
            self.piece.append(part.get(1, b"").decode())
            score.append(float(np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0]))
            kind.append(part.get(3, 1))
        trainer = dict(_fields(next((v for k, v in spec if k == 2), b"")))
        normal = dict(_fields(next((v for k, v in spec if k == 3), b"")))
        self.bpe = trainer.get(3, 1) == 2
        self.prefix = bool(normal.get(3, 1))
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("models that rewrite characters or drop white space are not supported")
        self.unknown = kind.index(2) if 2 in kind else 0
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.piece, kind)) if k == 6}
        self.raw = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(BLANK, " ").encode() for p, k in zip(self.piece, kind)]
        self.rank = {p: (-s, i) for i, (p, k, s) in enumerate(zip(self.piece, kind, score)) if k in (1, 4)}
        usable = [p for p in self.rank if not self.bpe or self.merge(p) == [self.rank[p][1]]]
        if any(BLANK in p.lstrip(BLANK) for p in usable):
            raise ValueError("a piece crosses a blank")
        self.longest = max(map(len, usable))
        keys = np.array([_hash(np.array([[*map(ord, p)]], np.uint64))[0, -1] ^ np.uint64(len(p)) for p in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([self.rank[p][1] for p in usable])[order]
        self.score = np.array(score)
        self.unknown_score = float(min((score[i] for _, i in self.rank.values()), default=0.0)) - 10.0
        alone = {c for p in usable if len(p) > 1 for c in p}
        self.lone = np.zeros(256, bool)
        self.lone[[i for i in range(32) if chr(i) not in alone]] = True
        self.fits: dict[int, bool] = {}
        size = np.array([len(r) for r in self.raw])
        self.flat, self.size, self.begin = np.frombuffer(b"".join(self.raw), np.uint8), size, np.cumsum(size) - size
        self.table = WordTable(self.learn)

    def merge(self, text: str) -> list[int]:
        """Merges of one short string: of all neighbours that form a piece the best-ranked first, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(self.rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            if not found:
                return [self.rank[p][1] if p in self.rank else -1 for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging both pieces' text gives the two pieces back; pieces beside no piece (-1) always fit."""
        key = (left << 32) | right
        distinct, back = np.unique(key, return_inverse=True)
        if len(self.fits) + len(distinct) > MAX_PAIRS:
            self.fits.clear()
        out = np.empty(len(distinct), bool)
        for i, pair in enumerate(distinct.tolist()):
            fit = self.fits.get(pair)
            if fit is None:
                a, b = pair >> 32, pair & 0xFFFFFFFF
                fit = self.fits[pair] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
            out[i] = fit
        return out[back]

    def _advance(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words of one length; -1 stands for a character without a piece."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).astype(np.uint64)
        prefix = _hash(codes)
        most = min(length, self.longest)
        piece = np.full((n, length + 1, most + 1), -1, np.int32)  # by end and length
        power = np.uint64(1)
        for size in range(1, most + 1):
            power = np.uint64(int(power) * int(_BASE) % 2**64)
            key = (prefix[:, size:] - prefix[:, :-size] * power) ^ np.uint64(size)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            piece[:, size:, size] = np.where(self.keys[at] == key, self.ids[at], -1)
        best = np.full((n, length + 1), _FAR)
        best[:, 0] = 0
        last = np.full((n, length + 1), -1)
        step = np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            sizes = np.arange(1, min(end, most) + 1)
            own = piece[:, end, sizes].astype(np.int64)
            before = best[:, end - sizes]
            if self.bpe:
                gain = np.where((own >= 0) & (before > _FAR), 0.0, _FAR)
                left = last[:, end - sizes]
                ask = (gain == 0) & (left >= 0)
                if ask.any():
                    gain[ask] = np.where(self._compatible(left[ask], own[ask]), 0.0, _FAR)
                total = gain
                total[:, 0] = np.where((own[:, 0] < 0) & (before[:, 0] > _FAR), 0.0, total[:, 0])
            else:
                total = before + np.where(own >= 0, self.score[np.maximum(own, 0)], _FAR)
                total[:, 0] = np.where(own[:, 0] < 0, before[:, 0] + self.unknown_score, total[:, 0])
            pick = total.argmax(1)
            row = np.arange(n)
            best[:, end], last[:, end], step[:, end] = total[row, pick], own[row, pick], pick + 1
        out: list[list[int]] = [[] for _ in words]
        at, row = np.full(n, length), np.arange(n)
        while len(row):
            for i, token in zip(row.tolist(), last[row, at].tolist()):
                out[i].append(token)
            at = at - step[row, at]
            row, at = row[at > 0], at[at > 0]
        return [tuple(reversed(ids)) for ids in out]

    def _bytes(self, word: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Puts byte pieces, or the unknown piece, for characters without one."""
        out, at = [], 0
        for token in ids:
            if token >= 0:
                out.append(token)
                at += len(self.piece[token])
            else:
                raw = word[at].encode("utf-8", "replace")
                out += [self.byte[b] for b in raw] if self.byte else [self.unknown]
                at += 1
        return tuple(out)

    def learn(self, units: Units, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each) of units met for the first time; those of one length advance together."""
        words = [units.buf[a:b].tobytes().decode().replace(" ", BLANK) for a, b in zip(units.starts[which].tolist(), units.ends[which].tolist())]
        by: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by.setdefault(len(word), []).append(i)
        found: list[tuple[int, ...]] = [()] * len(words)
        for length, places in by.items():
            step = max(1, CELLS // (length * min(length, self.longest)))
            for lo in range(0, len(places), step):
                some = places[lo : lo + step]
                for i, ids in zip(some, self._advance([words[i] for i in some])):
                    found[i] = ids if min(ids) >= 0 else self._bytes(words[i], ids)
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(count.sum())), count

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last end, whether each text's ids decode to it)."""
        units = Units(column, self)
        start, count = self.table.lookup(units, distinct_words(span_hashes(units.buf, units.starts, units.ends)))
        ids = self.table.ids[ragged(start, count)]
        bounds = np.append(0, np.cumsum(count))[units.first]
        size = self.size[ids]
        back = self.flat[ragged(self.begin[ids], size)]
        ends = np.append(0, np.cumsum(size))[bounds]
        same = ~units.signs & (np.diff(ends) == np.diff(units.off))
        if len(back) == len(units.buf):  # else some text differs in length, and texts are compared one by one
            wrong = np.append(0, np.cumsum(back != units.buf))
            same &= wrong[units.off[1:]] == wrong[units.off[:-1]]
        else:
            for i in np.flatnonzero(same).tolist():
                same[i] = np.array_equal(back[ends[i] : ends[i + 1]], units.buf[units.off[i] : units.off[i + 1]])
        return ids, bounds, same

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """This worker's model of a file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """Ids of every row's whole text, and whether decoding them gives the text back.

    docs: doc_id and text (others are ignored). Returns doc_id, n_tokens, n_byte_tokens,
    ids_crc32 (unsigned, little-endian unsigned 32-bit ids), round_trip and, with_ids, ids.
    Null and empty texts have no ids; texts with the blank sign U+2581 come back with
    spaces; repeated rows are encoded alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        is_byte = np.zeros(len(pieces.piece), bool)
        is_byte[list(pieces.byte.values())] = True
        for batch in batches:
            for part in slices(batch):
                ids, bounds, same = pieces.encode(part.column("text"))
                ids = ids.astype("<u4")
                places = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                bytes_before = np.append(0, np.cumsum(is_byte[ids]))
                columns = {
                    "doc_id": part.column("doc_id").cast(pa.int64()),
                    "n_tokens": pa.array(np.diff(bounds)),
                    "n_byte_tokens": pa.array(np.diff(bytes_before[bounds])),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in places], pa.int64()),
                    "round_trip": pa.array(same),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row's ids (null ids: null text; ids outside the vocabulary raise)."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op10_batched_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as a digest, decoded again."""
    return encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)
