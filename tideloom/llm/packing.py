"""Sum-of-squares online packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tideloom.llm.common import small_batches, table, vocabulary
from tideloom.llm.textarrays import Texts, ragged, slices
from tideloom.llm.wordtable import distinct_words, word_table

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A part of a document: doc_id, start, the ids, the document's number of ids.
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Packs a stream of id arrays into windows of `length` ids.

    ``level[h]`` counts the open windows that hold h ids. An item of size s goes to
    the level h (h + s <= length), or to a new window, for which the sum of the
    squared counts becomes smallest; full windows leave the array. Ties go to the
    fullest level. Items longer than a window first fill whole windows.
    """

    def __init__(self, length: int):
        self.length = length
        self.level = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def _choose(self, size: int) -> int:
        h = np.flatnonzero(self.level[1 : self.length - size + 1]) + 1
        best, cost = 0, 2 * int(self.level[size]) + 1
        if len(h):
            to = self.level[h + size]
            change = 1 - 2 * self.level[h] + np.where(h + size < self.length, 2 * to + 1, 0)
            i = len(h) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= cost:
                best = int(h[i])
        return best

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Places one document; yields the windows that became full."""
        total, at = len(ids), 0
        while total - at >= self.length:
            yield [(doc_id, at, ids[at : at + self.length], total)]
            at += self.length
        size = total - at
        if not size:
            return
        piece = (doc_id, at, ids[at:].copy(), total)
        h = self._choose(size)
        window: list[Piece] = []
        if h:
            window = self.open[h].pop()
            self.level[h] -= 1
        window.append(piece)
        if h + size == self.length:
            yield window
        else:
            self.level[h + size] += 1
            self.open.setdefault(h + size, []).append(window)

    def close(self) -> Iterator[list[Piece]]:
        """Ends the stream: cuts the emptiest open windows' pieces into the gaps of the fullest ones."""
        left = [w for h in sorted(self.open) for w in self.open[h]]
        fill = [sum(len(p[2]) for p in w) for w in left]
        lo, hi = 0, len(left) - 1
        while lo < hi:
            doc_id, start, ids, total = left[lo].pop()
            take = min(self.length - fill[hi], len(ids))
            if take < len(ids):
                left[lo].append((doc_id, start, ids[:-take], total))
            left[hi].append((doc_id, start + len(ids) - take, ids[len(ids) - take :], total))
            fill[lo] -= take
            fill[hi] += take
            if fill[hi] == self.length:
                yield left[hi]
                hi -= 1
            if not fill[lo]:
                lo += 1
        if lo == hi and fill[lo]:
            yield left[lo]
        self.open, self.level[:] = {}, 0


def document_ids(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with the end id) of every row, in order."""
    words = word_table(path)
    for batch in batches:
        for part in slices(batch):
            texts = Texts(part.column("text"))
            start, count = words.lookup(texts, distinct_words(texts.hashes()))
            flat = words.ids[ragged(start, count)]
            ends = np.r_[0, np.cumsum(count)][texts.first]
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                yield doc_id, np.append(flat[ends[i] : ends[i + 1]], np.int32(end_id))


def pack_sequences(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Packs every row's text into sequences of at most `length` ids.

    docs: columns doc_id and text (others are ignored). Returns a row per piece
    (SCHEMA, and ``ids`` unless with_ids is false): each id of a document, its end id
    included, lies in exactly one piece; offsets are gapless in a sequence. Each task
    packs its own rows with SumOfSquares and leaves at most one sequence that is not
    full, so padding is at most one window a task. Null and empty texts give the end
    id alone; repeated rows are packed again; an empty table gives no rows. Memory is
    that of the open windows.
    """
    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, done = SumOfSquares(length), 0
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        rows: list[tuple] = []

        def emit(window: list[Piece]) -> None:
            nonlocal done
            offset = 0
            for doc_id, start, ids, total in window:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((doc_id, start, len(ids), crc, total, base + done, offset, *([ids.tolist()] if with_ids else [])))
                offset += len(ids)
            done += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * (len(COLUMNS) + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[: len(COLUMNS)]]
            names = list(COLUMNS)
            if with_ids:
                arrays.append(pa.array(columns[-1], pa.list_(pa.int32())))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for doc_id, ids in document_ids(batches, tokenizer, end_id):
            for window in packer.add(doc_id, ids):
                emit(window)
            if len(rows) >= 5000:
                yield flush()
        for window in packer.close():
            emit(window)
        yield flush()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(pack, schema)


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 ids; one row per piece."""
    return pack_sequences(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)
