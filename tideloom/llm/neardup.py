"""Near-duplicate detection by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles. A sketch is made of the `ell` shingles
with the smallest hashes, each labelled with its occurrence number, kept in the order in
which they stand in the text: it agrees for two texts only if they share these shingles
in one order. Candidates share a sketch; a link is a pair whose aligned shingles, as a
share of all shingles of both, reach the threshold.

First the leader of each group of texts that share a sketch meets the others. Groups that
still span several classes are compared in cells of bounded size, in which only pairs of
different classes count: small groups as they are; texts of large ones are sketched anew
with more shingles a sketch, which parts texts that share no more than a passage, and meet
where that gives small groups. A cell gives links that join its classes, at most one a text,
and never lists its pairs.

Sketches find a link with a probability. What they leave is found for certain: in one order
of all labelled shingles, common ones last, two similar texts share one among the first
n - ceil(threshold * n) + 1 of each (its head). Heads that meet in several classes are
compared by length, place and the parities of their shingles, none of which rules out a
similar pair, and the pairs left are aligned. In a large group all meet first the text with
the least of its own before the common shingle, which joins copies of one original; of the
rest stays who may, by length and place, have a similar text in another class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm.common import discard, small_batches, stored, table
from tideloom.llm.components import components
from tideloom.llm.textarrays import Texts, mix, ragged, slices

WORDS_PER_SHINGLE, THRESHOLD, SKETCHES, ELL = 5, 0.8, 24, 3
#: Sketches, and shingles of each, of the texts of large groups.
FINE_SKETCHES, FINE_ELL = 40, 6
#: About as many texts, and shingles, make half a cell; a group of no more texts is small.
CELL_TEXTS, CELL_SHINGLES = 256, 400_000
#: One text in so many is read for common shingles, of which so many at most go last in the order of heads.
HOT_SHARE, HOT_MOST = 16, 1 << 16
#: Bytes of parities of a text, at most, and compared at once.
PARITY_BYTES, PARITY_STEP = 1 << 12, 1 << 24
#: Shingles that one step of the alignment holds.
ALIGN_CELLS = 1 << 20
_ODD, _MAX = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


def shingles(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle in order; a text with fewer than k words has one of all its words."""
    hashes = texts.hashes()
    at, full = texts.windows(hashes, k)
    short = np.flatnonzero((texts.counts > 0) & (texts.counts < k))
    rest = texts.counts[short].astype(np.uint64)
    for j in range(k - 1):
        some = texts.counts[short] > j
        rest[some] = mix(rest[some] * _ODD + hashes[texts.first[short[some]] + j])
    doc = np.concatenate([texts.doc[at], short])
    order = np.argsort(doc, kind="stable")
    return np.concatenate([full, rest])[order], doc[order]


def occurrences(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the same value stood in the same text before."""
    key = mix(value + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    at = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def labels_of(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shingles told apart by how often they stood in their text before."""
    return mix(value + occurrences(value, doc).astype(np.uint64) * _ODD)


def sketches(value: np.ndarray, doc: np.ndarray, n: int, count: int, ell: int) -> np.ndarray:
    """`count` order-preserving sketches of each of n texts; 0 where a text has no shingle."""
    out = np.zeros((n, count), np.uint64)
    if not len(value):
        return out
    label = labels_of(value, doc)
    size = np.bincount(doc, minlength=n)
    full = np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[full]
    seeds = np.random.Generator(np.random.PCG64(41 + ell)).integers(0, 2**63, (count, 2), dtype=np.uint64)
    for j in range(count):
        h = (label ^ seeds[j, 0]) * (seeds[j, 1] | np.uint64(1))
        h ^= h >> np.uint64(32)
        at = np.full((len(full), ell), len(value))
        for r in range(ell):
            low = np.minimum.reduceat(h, starts)
            hit = np.flatnonzero(h == np.repeat(low, size[full]))
            owner = np.searchsorted(starts, hit, "right") - 1
            some = low[owner] < _MAX
            at[owner[some], r] = hit[some]
            h[hit] = _MAX
        at.sort(1)
        total = np.full(len(full), np.uint64(j + 1))
        padded = np.r_[value, np.uint64(0)]
        for r in range(ell):
            total = mix(total * _ODD + padded[at[:, r]] + (at[:, r] == len(value)))
        out[full, j] = total
    return out


def aligned(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Most shingles that an alignment inside the band |i - j| <= band puts on equal ones, for each pair."""
    rows, width = max(map(len, a)), max(map(len, b))
    size = max(rows, width) + 2 * band + 1
    left = np.full((len(a), rows), 1, np.uint64)
    right = np.full((len(a), size + band), 2, np.uint64)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)] = x | np.uint64(3)  # never equal to the filling
        right[i, band : band + len(y)] = y | np.uint64(3)
    best = np.zeros((len(a), 2 * band + 2), np.int32)
    for i in range(rows):
        same = right[:, i : i + 2 * band + 1] == left[:, i, None]
        best[:, :-1] = np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + same), axis=1)
    return best[:, -2]


def aligned_enough(values: np.ndarray, starts: np.ndarray, n: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the aligned shingles of texts u[i] and v[i] reach the threshold.

    Text t has the shingles values[starts[t] : starts[t] + n[t]]. Similarity is aligned /
    (shingles of both - aligned). What both begin and end with is set aside; the band
    doubles until the threshold is reached or no wider alignment can reach it.
    """
    need = np.ceil(threshold / (1 + threshold) * (n[u] + n[v]) - 1e-9).astype(np.int64)
    limit = n[u] + n[v] - 2 * need  # shingles of both that may stay unaligned
    out = np.zeros(len(u), bool)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    done = np.zeros(len(u), np.int64)
    for i, (x, y) in enumerate(zip(u.tolist(), v.tolist())):
        a, b = values[starts[x] : starts[x] + n[x]], values[starts[y] : starts[y] + n[y]]
        m = min(len(a), len(b))
        other = a[:m] != b[:m]
        head = int(other.argmax()) if other.any() else m
        a, b, m = a[head:], b[head:], m - head
        other = a[len(a) - m :][::-1] != b[len(b) - m :][::-1]
        tail = int(other.argmax()) if other.any() else m
        left.append(a[: len(a) - tail])
        right.append(b[: len(b) - tail])
        done[i] = head + tail
    rows = np.array([len(a) for a in left], np.int64)
    columns = np.array([len(b) for b in right], np.int64)
    out = done >= need
    todo = np.flatnonzero(~out & (done + np.minimum(rows, columns) >= need) & (rows > 0) & (columns > 0))
    band = np.maximum(16, np.abs(rows - columns))
    while len(todo):
        todo = todo[np.lexsort((rows[todo], band[todo]))]
        lo = 0
        while lo < len(todo):
            size = np.maximum.accumulate(np.maximum(rows, columns)[todo[lo : lo + 64]] + 2 * band[todo[lo : lo + 64]])
            hi = lo + max(1, int(np.searchsorted(size * np.arange(1, len(size) + 1), ALIGN_CELLS, "right")))
            some = todo[lo:hi]
            got = aligned([left[i] for i in some], [right[i] for i in some], int(band[some].max()))
            out[some] = done[some] + got >= need[some]
            lo = hi
        todo = todo[~out[todo] & (band[todo] < limit[todo])]
        band[todo] = np.minimum(2 * band[todo], np.maximum(limit[todo], 16))
    return out


def enough_shared(shared: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether texts of a and b shingles that share so many, in any order, may reach the threshold."""
    return shared >= np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def similar(a: Texts, b: Texts, k: int, threshold: float) -> np.ndarray:
    """Whether the aligned shingles of text i of a and text i of b reach the threshold.

    Pairs whose common shingles cannot reach it in any order are out at once.
    """
    (va, da), (vb, db) = shingles(a, k), shingles(b, k)
    na, nb = np.bincount(da, minlength=a.n)[: a.n], np.bincount(db, minlength=b.n)[: b.n]
    keys = [mix(labels_of(v, d) + mix(d.astype(np.uint64))) for v, d in ((va, da), (vb, db))]
    _, common, _ = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    shared = np.bincount(da[common], minlength=a.n)[: a.n]
    out = np.zeros(a.n, bool)
    todo = np.flatnonzero(enough_shared(shared, na, nb, threshold) & (na > 0) & (nb > 0))
    n = np.concatenate([na, nb])
    out[todo] = aligned_enough(np.concatenate([va, vb]), np.cumsum(n) - n, n, todo, todo + a.n, threshold)
    return out


def _small_cells(label: np.ndarray, doc: np.ndarray, cell: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, shared) of the texts of one cell that share labels; no cell has more than `most` texts."""
    key = mix(label + mix(cell[doc].astype(np.uint64)))
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    codes = [np.zeros(0, np.int64)]
    for step in range(1, most):
        same = key[step:] == key[:-step]
        a, b = doc[step:][same], doc[:-step][same]
        codes.append(np.minimum(a, b) * len(cell) + np.maximum(a, b))
    code, shared = np.unique(np.concatenate(codes), return_counts=True)
    return code // len(cell), code % len(cell), shared


def _large_cell(label: np.ndarray, doc: np.ndarray, first: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one cell, by products of its table of texts and labels in blocks of labels."""
    _, column, times = np.unique(label, return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    some = several[column]
    row, column = doc[some] - first, number[column[some]]
    order = np.argsort(column)
    row, column = row[order], column[order]
    shared = np.zeros((texts, texts), np.float32)
    for lo in range(0, int(several.sum()), 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        held = np.zeros((texts, 4096), np.float32)
        held[row[a:b], column[a:b] - lo] = 1
        shared += held @ held.T
    u, v = np.nonzero(np.triu(shared, 1))
    return u + first, v + first, shared[u, v].astype(np.int64)


def cell_links(texts: Texts, cell: np.ndarray, half: np.ndarray, root: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): verified links between texts of one cell and different roots, as many as join what can be joined.

    cell, half, root: of each text; texts of a cell stand together. In cells with two
    halves only pairs across them count. Every pair whose shared shingles allow it is either
    verified or found to lie in one class already.
    """
    value, doc = shingles(texts, k)
    label = labels_of(value, doc)
    n = np.bincount(doc, minlength=texts.n)[: texts.n]
    starts = np.cumsum(n) - n
    size = np.bincount(cell)
    big = size > 12
    small = ~big[cell[doc]]
    found = [_small_cells(label[small], doc[small], cell, int(size[~big].max(initial=0)))]
    begin = np.cumsum(size) - size
    for c in np.flatnonzero(big).tolist():
        lo, hi = np.searchsorted(doc, (begin[c], begin[c] + size[c]))
        found.append(_large_cell(label[lo:hi], doc[lo:hi], int(begin[c]), int(size[c])))
    u, v, shared = (np.concatenate(x) for x in zip(*found))
    crossed = np.zeros(len(size), bool)
    crossed[cell[half > 0]] = True
    ok = enough_shared(shared, n[u], n[v], threshold) & (root[u] != root[v]) & (~crossed[cell[u]] | (half[u] != half[v]))
    u, v = u[ok], v[ok]
    _, place = np.unique(root, return_inverse=True)
    parent = np.arange(place.max(initial=0) + 1)
    joined_u, joined_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(u):
        a, b = parent[place[u]], parent[place[v]]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        # one pair of each class at a time
        if not len(u):
            break
        pick = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]]))
        good = pick[aligned_enough(value, starts, n, u[pick], v[pick], threshold)]
        links = []
        for i, x, y in zip(good.tolist(), a[good].tolist(), b[good].tolist()):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append(i)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        joined_u.append(u[links])
        joined_v.append(v[links])
        u, v = np.delete(u, pick), np.delete(v, pick)
    return np.concatenate(joined_u), np.concatenate(joined_v)


def _profiles(docs: DataFrame, k: int, count: int, ell: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                value, doc = shingles(texts, k)
                view, begin, end = texts.spaced(np.arange(len(texts.starts)))
                digest = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin, end))
                both = np.frombuffer(digest, np.int64).reshape(-1, 2)
                sketch = sketches(value, doc, texts.n, count, ell)
                flat = pa.array(sketch.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, texts.n * count + 1, count, dtype=np.int32)), flat)
                n = pa.array(np.bincount(doc, minlength=texts.n)[: texts.n].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), n, lists], ["doc_id", "t1", "t2", "n", "sketches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, t1 long, t2 long, n long, sketches array<long>")


def _fine(texts: DataFrame, k: int, count: int, ell: int) -> DataFrame:
    """(key, id, root, n) of the finer sketches of each text: id, root, n, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                all_texts = Texts(part.column("text"))
                sketch = sketches(*shingles(all_texts, k), all_texts.n, count, ell)
                key = mix(sketch + mix(np.arange(1, count + 1).astype(np.uint64))).reshape(-1).view(np.int64)
                rows = pa.array(np.repeat(np.arange(all_texts.n), count))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(part.column(c).take(rows) for c in ("id", "root", "n"))], ["key", "id", "root", "n"])

    return texts.select("id", "root", "n", "text").mapInArrow(run, "key long, id long, root long, n long")


def _open(rows: DataFrame) -> DataFrame:
    """key, size, shingles of the groups with several roots; of groups with the same texts one."""
    sums = rows.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64(F.lit(7), "id").bitwiseAND(0xFFFFFFFF)).alias("y"))
    return sums.filter("low < high").groupBy("size", "shingles", "x", "y").agg(F.min("key").alias("key")).select("key", "size", "shingles")


def _dealt(rows: DataFrame, parts: Column, *more: str, main: Column | None = None) -> DataFrame:
    """(key, a, b, half, id, root, more) of the members of each cell, groups being in so many parts.

    main: so many more parts for the rows whose column main holds; these meet no part of main ones.
    """
    own, last = F.pmod(F.xxhash64("id"), F.col("parts")), F.col("parts") - 1
    rows = rows.withColumn("parts", parts)
    if main is not None:
        rows = rows.withColumn("more", main)
        own = F.when(F.col("main"), F.col("parts") + F.pmod(F.xxhash64("id"), F.greatest("more", F.lit(1)))).otherwise(own)
        last = F.when(F.col("main"), last).otherwise(last + F.col("more"))
    # a group in several parts has a cell for every two of them and one for each alone
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("half"), "id", "root", *more)


def _cells(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(members) of each cell: id, root, half, text. rows: key, id, root, size, shingles."""
    parts = F.greatest(F.ceil(F.col("size") / CELL_TEXTS), F.ceil(F.col("shingles") / CELL_SHINGLES))
    dealt = _dealt(rows, parts)
    return dealt.join(texts.hint("merge"), "id").groupBy("key", "a", "b").agg(F.collect_list(F.struct("id", "root", "half", "text")).alias("members")).select("members")


def _linked(cells: DataFrame, k: int, threshold: float) -> DataFrame:
    """(u, v, ru, rv): links found in the cells, and the roots of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            flat = lists.flatten()
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            size = np.diff(bounds)
            cell = np.repeat(np.arange(len(size)), size)
            ids, roots, half = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "root", "half"))
            text = flat.field("text")
            length = np.append(0, np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            lo = 0
            while lo < len(size):  # whole cells of a few MB together
                hi = lo + 1
                while hi < len(size) and length[bounds[hi + 1]] - length[bounds[lo]] <= (1 << 21):
                    hi += 1
                some = slice(int(bounds[lo]), int(bounds[hi]))
                u, v = cell_links(Texts(text.slice(some.start, some.stop - some.start)), cell[some] - lo, half[some], roots[some], k, threshold)
                if len(u):
                    i, r = ids[some], roots[some]
                    yield pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in (("u", i[u]), ("v", i[v]), ("ru", r[u]), ("rv", r[v]))})
                lo = hi

    return cells.mapInArrow(run, "u long, v long, ru long, rv long")


def parities(label: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each text): the parity of each text's labels by their low bits, two bits a label or more.

    Bits that differ are never more than labels that only one of two texts has.
    """
    size = np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) // 4, 8, PARITY_BYTES)
    begin = np.cumsum(size) - size
    bit = (label & (8 * size[doc] - 1).astype(np.uint64)).astype(np.int64) + 8 * begin[doc]
    return np.packbits(np.bincount(bit, minlength=8 * int(size.sum())).astype(np.uint8) & 1, bitorder="little"), size


def parity_distance(data: np.ndarray, begin: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bits that differ in the parities data[begin : begin + size] of u[i] and v[i]; the longer are folded."""
    out = np.zeros(len(u), np.int64)
    shape = np.stack([size[u], size[v]])
    for a, b in np.unique(shape, axis=1).T.tolist():
        some = np.flatnonzero((shape[0] == a) & (shape[1] == b))
        step = max(1, PARITY_STEP // max(a, b))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            x, y = (np.lib.stride_tricks.sliding_window_view(data, w)[begin[t[part]]] for w, t in ((a, u), (b, v)))
            x, y = (np.bitwise_xor.reduce(z.reshape(len(part), -1, min(a, b)), axis=1) for z in (x, y))
            out[part] = np.bitwise_count((x ^ y).view(np.uint64)).sum(1)
    return out


def _common(docs: DataFrame, k: int) -> np.ndarray:
    """Labels that stand in several texts of a sample, the rarest first: a hint of what is common, on which no result depends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                label, times = np.unique(labels_of(*shingles(Texts(part.column("text")), k)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(label.view(np.int64)), pa.array(times)], ["label", "times"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SHARE)) == 0).select("text").mapInArrow(run, "label long, times long")
    top = some.groupBy("label").agg(F.sum("times").alias("times")).filter("times > 2").orderBy(F.desc("times"), "label").limit(HOT_MOST)
    return np.array([r["label"] for r in top.collect()][::-1], np.int64).view(np.uint64)


def heads(label: np.ndarray, doc: np.ndarray, n: np.ndarray, common: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(labels, labels of each text): those among which similar texts share one, in one order for all texts."""
    by = np.argsort(common)
    at = np.minimum(np.searchsorted(common, label, sorter=by), len(common) - 1)
    last = np.where(common[by[at]] == label, by[at] + 1, 0) if len(common) else np.zeros(len(label), np.int64)
    order = np.lexsort((label, last, doc))
    size = np.minimum(n, n - np.ceil(threshold * n - 1e-8).astype(np.int64) + 1)
    return label[order][ragged((np.cumsum(n) - n), size)], size


def _heads(docs: DataFrame, k: int, threshold: float, common: np.ndarray) -> DataFrame:
    """(id, n, parity, head) of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                value, doc = shingles(texts, k)
                label, n = labels_of(value, doc), np.bincount(doc, minlength=texts.n)[: texts.n]
                data, size = parities(label, doc, n)
                parity = pa.LargeBinaryArray.from_buffers(pa.large_binary(), texts.n, [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(data)])
                head, size = heads(label, doc, n, common, threshold)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(head.view(np.int64)))
                out = pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array(n.astype(np.int64)), parity.cast(pa.binary()), lists], ["id", "n", "parity", "head"])
                yield out.filter(pa.array(n > 0))

    return docs.select("id", "text").mapInArrow(run, "id long, n long, parity binary, head array<long>")


def head_pairs(cell: np.ndarray, half: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v) of one cell and different roots that may be similar, a few at a time; texts of a cell stand together.

    place: of the cell's label in the order of the text's labels. Where it is the first that
    two texts share, they share no more than follow it; some cell has the first.
    """
    crossed = np.zeros(int(cell.max(initial=-1)) + 1, bool)
    crossed[cell[half > 0]] = True
    for step in range(1, len(cell)):
        u = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(u):
            break
        u = u[(root[u] != root[u + step]) & (~crossed[cell[u]] | (half[u] != half[u + step]))]
        v = u + step
        ok = enough_shared(np.minimum(n[u] - place[u], n[v] - place[v]), n[u], n[v], threshold)
        yield u[ok], v[ok]


def _parity_allows(column: pa.Array, n: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the parities of texts u[i] and v[i] leave room for enough shared shingles."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return enough_shared((n[u] + n[v] - parity_distance(data, np.cumsum(size) - size, size, u, v)) // 2, n[u], n[v], threshold)


def _head_pairs(cells: DataFrame, threshold: float) -> DataFrame:
    """(u, v): ids of texts in one cell that may be similar, by their parities too where the cells have them."""
    parity = "parity" in cells.schema["members"].dataType.elementType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            flat = lists.flatten()
            cell = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            ids, root, half, n, place = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "root", "half", "n", "place"))
            found = [np.zeros((2, 0), np.int64)]
            for u, v in head_pairs(cell, half, root, n, place, threshold):
                if parity and len(u):
                    ok = _parity_allows(flat.field("parity"), n, u, v, threshold)
                    u, v = u[ok], v[ok]
                found.append(np.sort(np.stack([ids[u], ids[v]]), axis=0))
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

    return cells.mapInArrow(run, "u long, v long").distinct()


def _near_parity(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) that may be similar by their parities. texts: id, n, parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.arange(batch.num_rows)
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n", "m")])
            ok = _parity_allows(pa.chunked_array([batch.column("parity"), batch.column("other")]), n, m, m + len(m), threshold)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    left = pairs.join(texts.select(F.col("id").alias("u"), "n", "parity").hint("merge"), "u")
    both = left.join(texts.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("parity").alias("other")).hint("merge"), "v")
    return both.mapInArrow(run, "u long, v long")


def _verified(edges: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The edges (u, v) of which two texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = pa.array(similar(Texts(part.column("text")), Texts(part.column("other")), k, threshold))
                yield part.select(["u", "v"]).filter(keep)

    left = edges.join(texts.select(F.col("id").alias("u"), "text").hint("merge"), "u")
    both = left.join(texts.select(F.col("id").alias("v"), F.col("text").alias("other")).hint("merge"), "v")
    return both.select("u", "v", "text", "other").mapInArrow(run, "u long, v long")


def _joined(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the roots that the links (u, v) join. roots: id, root."""
    ends = links.join(roots.select(F.col("id").alias("u"), F.col("root").alias("ru")).hint("merge"), "u").join(roots.select(F.col("id").alias("v"), F.col("root").alias("rv")).hint("merge"), "v")
    return components(ends.select(F.col("ru").alias("u"), F.col("rv").alias("v")))


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the ends of the pairs (u, v), stored."""
    which = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    return stored(docs.join(which, "id", "left_semi").distinct())


def _led(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((key, leader, lead), (u, v)): the leader of each group and its root, and who may be similar to it.

    rows: key, id, root, n, place. The leader has the fewest labels before the group's own.
    """
    leaders = rows.groupBy("key").agg(F.min(F.struct("place", "n", "id", "root")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
    leaders = stored(leaders.filter("low < high").select("key", F.col("first.id").alias("leader"), F.col("first.root").alias("lead"), F.col("first.n").alias("m"), F.col("first.place").alias("at")))
    met = rows.join(leaders.hint("merge"), "key").filter("root <> lead").withColumn("reach", _reach(threshold))
    met = met.filter((F.col("m") <= F.col("reach")) & (F.col("n") <= _reach(threshold, "m", "at")))
    return leaders, met.select(F.least("id", "leader").alias("u"), F.greatest("id", "leader").alias("v")).distinct()


def _reach(threshold: float, n: str = "n", place: str = "place") -> Column:
    """Most shingles of a text that may be similar to one of n, if it shares none before the place."""
    return F.floor((F.col(n) - F.col(place)) * ((1 + threshold) / threshold) + 1e-6) - F.col(n)


def _apart(rows: DataFrame, leaders: DataFrame, threshold: float) -> DataFrame:
    """The rows that may be similar to one of another root, with `main` (of the leader's root), and how many are main and are not.

    Length and place of a row are held against the extremes of those it may be similar to:
    for main rows these are not main.
    """
    rows, before = rows.join(leaders.select("key", "lead").hint("merge"), "key").withColumn("main", F.col("root") == F.col("lead")).drop("lead").withColumn("reach", _reach(threshold)), []
    rest = F.when(~F.col("main"), F.lit(True))
    extremes = [F.min("n").alias("low"), F.max("reach").alias("top"), F.min(F.when(rest, F.col("n"))).alias("rest_low"), F.max(F.when(rest, F.col("reach"))).alias("rest_top")]
    counts = [F.count(F.when(F.col("main"), True)).alias("mains"), F.count(rest).alias("rests")]
    for _ in range(2):  # those that go may have been the extremes
        bounds = stored(rows.groupBy("key").agg(*extremes).filter("rest_low IS NOT NULL"))
        low, top = F.when(F.col("main"), F.col("rest_low")).otherwise(F.col("low")), F.when(F.col("main"), F.col("rest_top")).otherwise(F.col("top"))
        kept = stored(rows.join(bounds.hint("merge"), "key").filter((F.col("reach") >= low) & (F.col("n") <= top)).select("key", "id", "root", "n", "place", "main", "reach"))
        discard(bounds, *before)
        rows, before = kept, [kept]
    sizes = stored(rows.groupBy("key").agg(*counts).filter("rests > 0"))
    out = stored(rows.join(sizes.hint("merge"), "key"))
    discard(rows, sizes)
    return out


def _left_over(docs: DataFrame, roots: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((u, v), (u, v)): links found, and pairs that may be similar and have different roots; with the links no similar one is missing.

    docs: id, text; roots: id, root.
    """
    common = _common(docs.withColumnRenamed("id", "doc_id"), k)
    texts = stored(_heads(docs, k, threshold, common).join(roots.hint("merge"), "id"))
    shared = texts.select("root", F.explode("head").alias("key")).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    several = stored(shared.filter("low < high").select("key", "size"))
    hot = stored(several.filter(F.col("size") > CELL_TEXTS).select("key"))
    parities_of, members = texts.select("id", "n", "parity"), ["id", "root", "half", "n", "place"]

    def heads_of(some: DataFrame) -> DataFrame:
        return some.select("id", "root", "n", F.posexplode("head").alias("place", "key"))

    # all of a large group meet its leader
    rows = stored(heads_of(texts).join(hot, "key"))
    leaders, met = _led(rows, threshold)
    links = met = stored(met)
    used, rooted = [texts, several, hot], texts
    if not met.isEmpty():
        near = stored(_near_parity(met, parities_of, threshold))
        own = _texts_of(docs, near)
        links = stored(_verified(near, own, k, threshold).distinct())
        tops = stored(_joined(links, roots))
        top = tops.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge")
        rooted = texts.select("id", "root", "n", "head").join(top, "root", "left").withColumn("root", F.coalesce("top", "root"))
        again = stored(rows.join(top, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"))
        leaders_again = stored(leaders.join(top.withColumnRenamed("root", "lead"), "lead", "left").select("key", F.coalesce("top", "lead").alias("lead")))
        discard(rows, leaders, met, near, own)
        rows, leaders = again, leaders_again
        used.append(tops)
    # pairs of small groups are listed and then compared by parities; cells of large ones hold the parities and list what these leave
    few = heads_of(rooted).join(several.filter(F.col("size") <= CELL_TEXTS).select("key").hint("merge"), "key")
    small = _dealt(few, F.lit(1).cast("long"), "n", "place").groupBy("key", "a", "b").agg(F.collect_list(F.struct(*members)).alias("members"))
    listed = stored(_head_pairs(small.select("members"), threshold))
    pairs = _near_parity(listed, parities_of, threshold)
    if not leaders.isEmpty():
        apart = _apart(rows, leaders, threshold)
        dealt = _dealt(apart, F.ceil(F.col("rests") / CELL_TEXTS), "n", "place", main=F.ceil(F.col("mains") / CELL_TEXTS))
        large = dealt.join(texts.select("id", "parity").hint("merge"), "id").groupBy("key", "a", "b").agg(F.collect_list(F.struct(*members, "parity")).alias("members"))
        pairs = pairs.unionByName(_head_pairs(large.select("members"), threshold))
        used.append(apart)
    pairs = stored(pairs.distinct())
    discard(*used, rows, leaders, listed)
    return links, pairs


def near_duplicates(docs: DataFrame, k: int = WORDS_PER_SHINGLE, threshold: float = THRESHOLD, count: int = SKETCHES, ell: int = ELL) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class) and n_links.

    docs: doc_id and text (others are ignored). Texts with the same words are one class from
    the start and are compared once; texts that carry one doc_id are one class too. In each
    group of texts that share a sketch the leader is compared with all others. Groups that
    then span several classes are compared in cells (see the module): every pair of
    different classes in a cell is ruled out by its shared shingles, aligned, or found
    joined by others. Pairs of different classes that no sketch brought together are then
    found by their heads, so classes are those of all pairs that reach the threshold. Work
    is linear in a group but for texts of a head's group of more than CELL_TEXTS that are in
    another class than its leader and that length and place do not rule out: these meet each
    other, and the like of the leader's class, in cells. n_links counts the links that
    were verified at the row's class of equal texts; a class has enough links to connect
    it, not all. Null texts count as empty; all texts without words form one class; rows
    without doc_id get a null class; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    profiles = stored(_profiles(docs, k, count, ell))
    known = profiles.filter("doc_id IS NOT NULL")
    rows_in = profiles.count()  # bounds the small tables below; a text with its sketches counts as `count` narrow rows
    classes = stored(known.groupBy("t1", "t2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketches").alias("sketches")), rows_in * count // 4)
    rows = classes.filter("n > 0").select("id", "n", F.posexplode("sketches")).select(F.xxhash64("pos", "col").alias("key"), "id", "n")
    # what is joined by a key that may be hot is stored, so that both sides have their own shuffle and Spark can split the key
    led = stored(rows.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last").select("key", "leader"), rows_in * count)
    grouped = stored(rows.join(led.hint("merge"), "key"), rows_in * count)
    own = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").join(grouped.select("id").distinct().hint("merge"), "id", "left_semi")
    texts = stored(own.distinct(), rows_in * count)
    pairs = grouped.filter("id <> leader").select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct()
    links = stored(_verified(pairs, texts, k, threshold).distinct(), rows_in * count)
    # texts of one doc_id
    several = known.groupBy("doc_id").agg(F.min("t1").alias("low"), F.max("t1").alias("high")).filter("low < high").select("doc_id")
    named = known.join(several.hint("merge"), "doc_id", "left_semi").join(classes.select("t1", "t2", "id").hint("merge"), ["t1", "t2"])
    first = stored(components(links.unionByName(named.select(F.col("doc_id").alias("u"), F.col("id").alias("v"))), rows_in * count), rows_in)
    tagged = stored(grouped.select("key", "id", "n").join(first.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root")), rows_in * count)
    discard(led, grouped)
    open_groups = stored(_open(tagged), rows_in * count)
    small = open_groups.filter(F.col("size") <= CELL_TEXTS)
    large = tagged.join(open_groups.filter(F.col("size") > CELL_TEXTS).select("key").hint("merge"), "key", "left_semi").groupBy("id").agg(F.min("root").alias("root"), F.max("n").alias("n"))
    fine = stored(_fine(large.join(texts.hint("merge"), "id"), k, FINE_SKETCHES, FINE_ELL))
    fine_groups = stored(_open(fine).filter(F.col("size") <= CELL_TEXTS), rows_in * count)  # larger ones wait for the heads
    columns = ["key", "id", "root", "size", "shingles"]
    cells = tagged.join(small.hint("merge"), "key").select(columns).unionByName(fine.join(fine_groups.hint("merge"), "key").select(columns))
    more = stored(_linked(_cells(cells, texts), k, threshold))
    discard(texts, tagged, open_groups, fine, fine_groups)
    second = components(more.select(F.col("ru").alias("u"), F.col("rv").alias("v")), rows_in)
    joined = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("top"))
    alone = second.join(first.select("node").hint("merge"), "node", "left_anti").select("node", F.col("root").alias("top"))
    roots = joined.unionByName(alone).withColumnRenamed("node", "id")
    tops = stored(classes.filter("n > 0").select("id").distinct().join(roots.hint("merge"), "id", "left").select("id", F.coalesce("top", "id").alias("root")), rows_in)
    # what sketches left
    rest = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    led, pairs = _left_over(rest, tops, k, threshold)
    texts = _texts_of(rest, pairs)
    last = stored(led.unionByName(_verified(pairs, texts, k, threshold)).distinct())
    third = _joined(last, tops)
    discard(pairs, texts, led)
    roots = tops.join(third.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge"), "root", "left").select("id", F.coalesce("top", "root").alias("top"))
    ends = links.unionByName(more.select("u", "v").distinct()).unionByName(last)
    touched = ends.select(F.col("u").alias("id")).unionByName(ends.select(F.col("v").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    named = classes.select("t1", "t2", "id").join(roots.hint("merge"), "id", "left").join(touched.hint("merge"), "id", "left")
    named = stored(named.select("t1", "t2", F.coalesce("top", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), rows_in)
    discard(classes, links, more, first, tops, last)
    with_id = known.select("doc_id", "t1", "t2").join(named.hint("merge"), ["t1", "t2"]).select("doc_id", "class_id", "n_links")
    without = profiles.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_id.unionByName(without)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
