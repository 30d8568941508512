"""Substring deduplication with a log-structured fingerprint index.

A window is ``width`` consecutive words of one text. Of the ``gram``-word hashes in a
window the smallest is its fingerprint, so equal windows have equal fingerprints and
neighbouring windows mostly share theirs: an index holds about one entry for every
twenty words instead of one a word, and still misses no repeated window.

The index is a log of immutable runs, each a table bucketed and sorted by fingerprint.
A new batch of documents becomes a run of its own, which is merge-joined with the older
runs bucket by bucket, without a shuffle. Only windows whose fingerprint the join finds
in two documents are verified: both documents' texts are read again from the document
store and their whole windows compared through two 64-bit hashes of all their words, which
share neither the word hash of the fingerprints nor each other's. Runs are compacted into one when there are ``fanout`` of them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm.common import discard, remove, shared_dir, small_batches, stored, table
from tideloom.llm.textarrays import Texts, mix, slices, window_hashes

WIDTH, GRAM = 50, 12
#: Seeds of the fingerprint, and of the word and window hashes of the two verifying keys.
_SEEDS = (0, 0x51ED270B, 0xC2B2AE3D)


def fingerprints(texts: Texts, hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of every window."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = window_hashes(hashes, gram, _SEEDS[0])
    span, have = width - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    inside = np.flatnonzero(texts.doc[: n - width + 1] == texts.doc[width - 1 :])
    return inside, low[inside]


def window_keys(texts: Texts, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Two independent hashes of the windows that start at these words, each from word hashes of its own."""
    return [window_hashes(texts.hashes(seed), width, seed)[at] if len(at) else np.zeros(0, np.uint64) for seed in _SEEDS[1:]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _postings(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(fp, row_id, owner) for the distinct fingerprints of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                at, fp = fingerprints(texts, texts.hashes(), width, gram)
                doc = texts.doc[at]
                new = np.ones(len(at), bool)  # runs of windows with one fingerprint
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
                doc, fp = doc[new], fp[new]
                _, first = np.unique(mix(fp + mix(doc.astype(np.uint64))), return_index=True)
                first.sort()
                rows = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays([_signed(fp[first]), part.column("row_id").take(rows), part.column("owner").take(rows)], ["fp", "row_id", "owner"])

    return docs.select("row_id", "owner", "text").mapInArrow(run, "fp long, row_id long, owner long")


def _windows(anchored: DataFrame, width: int, gram: int) -> DataFrame:
    """(w1, w2, row_id, owner, at) of the windows whose fingerprint is among the row's `fps`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                hashes = texts.hashes()
                at, fp = fingerprints(texts, hashes, width, gram)
                fps = part.column("fps")
                wanted = fps.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(texts.n), np.diff(fps.offsets.to_numpy()))
                keys = np.sort(mix(wanted + mix(owner.astype(np.uint64))))
                own = mix(fp + mix(texts.doc[at].astype(np.uint64)))
                found = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                at = at[keys[found] == own] if len(keys) else at[:0]
                w1, w2 = window_keys(texts, at, width)
                rows = pa.array(texts.doc[at])
                place = pa.array((at - texts.first[texts.doc[at]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), part.column("row_id").take(rows), part.column("owner").take(rows), place], ["w1", "w2", "row_id", "owner", "at"])

    return anchored.select("row_id", "owner", "text", "fps").mapInArrow(run, "w1 long, w2 long, row_id long, owner long, at int")


class FingerprintLog:
    """Index of fingerprints as sorted immutable runs, with the documents they came from.

    ``add`` takes a batch whose doc_ids are all larger than those before and returns the
    windows of it that start in a document with a smaller doc_id.
    """

    def __init__(self, spark: SparkSession, buckets: int, width: int = WIDTH, gram: int = GRAM, fanout: int = 2):
        if not 0 < gram <= width:
            raise ValueError("gram must lie between 1 and width")
        self.spark, self.buckets, self.width, self.gram, self.fanout = spark, buckets, width, gram, fanout
        self.runs: list[DataFrame] = []
        self.postings: list[DataFrame] = []
        self.documents: list[DataFrame] = []

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """df as a table in `buckets` files, each sorted by the key."""
        name, path = f"run_{uuid.uuid4().hex}", shared_dir(self.spark)
        rows = df.repartition(self.buckets, key)
        rows.write.bucketBy(self.buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
        out = self.spark.table(name)
        out._run = name, path
        return out

    def drop(self, runs: list[DataFrame]) -> None:
        """Deletes runs that nothing reads any more."""
        for run in runs:
            name, path = run._run
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def compact(self) -> None:
        """Merges all runs into one."""
        both = self.runs[0]
        for run in self.runs[1:]:
            both = both.unionByName(run)
        old, self.runs = self.runs, [self.bucketed(both.groupBy("fp").agg(F.min("low").alias("low"), F.max("high").alias("high")), "fp")]
        self.drop(old)

    def close(self) -> None:
        """Deletes runs and postings; the log takes no further batch."""
        self.drop(self.runs)
        discard(*self.postings)
        self.runs, self.postings = [], []

    def add(self, docs: DataFrame) -> DataFrame:
        """docs: row_id, owner, text, bucketed by row_id. Returns (row_id, at) of repeated windows, stored."""
        postings = stored(_postings(docs, self.width, self.gram))
        run = self.bucketed(postings.groupBy("fp").agg(F.min("owner").alias("low"), F.max("owner").alias("high")), "fp")
        shared = run.filter("low < high").select("fp")
        for old in self.runs:
            shared = shared.unionByName(run.join(old.hint("merge"), "fp", "left_semi").select("fp"))
        shared = stored(shared.distinct())
        self.postings.append(postings)
        self.documents.append(docs)
        hits = []
        for old_postings, old_docs in zip(self.postings, self.documents):
            anchors = old_postings.join(shared.hint("shuffle_hash"), "fp", "left_semi").groupBy("row_id").agg(F.collect_list("fp").alias("fps"))
            hits.append(_windows(old_docs.join(anchors.hint("merge"), "row_id"), self.width, self.gram))
        windows = hits[0]
        for more in hits[1:]:
            windows = windows.unionByName(more)
        windows = stored(windows)
        # stored, so that both sides of the join have their own shuffle and a hot window can be split
        first = stored(windows.groupBy("w1", "w2").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low < high"))
        # older rows cannot be repeats of newer ones; their own repeats were found with their batch
        least = docs.agg(F.min("owner")).first()[0]
        mine = windows if len(hits) == 1 or least is None else windows.filter(F.col("owner") >= least)
        found = stored(mine.join(first.drop("high").hint("merge"), ["w1", "w2"]).filter("low < owner").select("row_id", "at"))
        discard(shared, windows, first)
        self.runs.append(run)
        if len(self.runs) >= self.fanout:
            self.compact()
        return found


def _kept(part: pa.RecordBatch, width: int, with_text: bool) -> dict[str, pa.Array]:
    """Word counts, digest and text of what is left of each row after its `ats` windows, or those of a copy, are removed."""
    texts = Texts(part.column("text"))
    ats = part.column("ats")
    size = np.diff(ats.offsets.to_numpy())
    doc = np.repeat(np.arange(texts.n), size)
    at = ats.flatten().to_numpy(zero_copy_only=False) + texts.first[doc]
    step = np.zeros(len(texts.starts) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    gone = np.cumsum(step)[:-1] > 0
    whole = part.column("copy").to_numpy(zero_copy_only=False) & (texts.counts >= width)
    gone |= whole[texts.doc]
    left = np.flatnonzero(~gone)
    view, begin, end = texts.spaced(left)
    sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(begin, end)]
    out = {"n_words": pa.array(texts.counts.astype(np.int64)), "n_removed": pa.array(texts.per_text(texts.doc[gone]).astype(np.int64)), "kept_sha256": pa.array(sha, pa.string())}
    if with_text:  # a removed word goes with the white space behind it
        cut = np.zeros(len(texts.buf) + 1, np.int64)
        which = np.flatnonzero(gone)
        stop = np.minimum(np.r_[texts.starts[1:], len(texts.buf)][which], texts.off[texts.doc[which] + 1])
        np.add.at(cut, texts.starts[which], 1)
        np.add.at(cut, stop, -1)
        keep = np.cumsum(cut)[:-1] == 0
        at = np.r_[0, np.cumsum(keep)][texts.off]
        raw = texts.buf[keep].tobytes()
        new = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())
        import pyarrow.compute as pc

        out["kept_text"] = pc.if_else(pc.is_valid(part.column("text")), new, pa.scalar(None, pa.string()))
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 2, with_text: bool = True) -> DataFrame:
    """Removes every word covered by a window that also starts in a document with a smaller doc_id.

    docs: doc_id and text (others are ignored). The rows enter the index in `batches` batches
    of rising doc_id; the result does not depend on their number. Windows are judged on the
    input texts. Returns doc_id, n_words, n_removed, kept_sha256 (words left, joined by one
    space) and, with_text, kept_text. Rows without a doc_id are never cut and cut no others;
    rows with equal doc_id do not cut each other; null and empty texts have no words; an
    empty table gives no rows.
    """
    out = _cut(docs, [], width, gram, batches, with_text)
    return out.select(F.col("owner").alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


def cut_documents(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """The rows and columns of docs with the text that remove_repeats leaves, and n_chars, if there is one, its length."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = _cut(docs, rest, width, gram, batches, True)
    new = {"doc_id": F.col("owner"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(new.get(c, F.col(f"other.`{c}`")).alias(c) for c in docs.columns))


def _cut(docs: DataFrame, rest: list[str], width: int, gram: int, batches: int, with_text: bool) -> DataFrame:
    """owner, other (a struct of the columns `rest`), n_words, n_removed, kept_sha256 and, with_text, kept_text of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log = FingerprintLog(spark, buckets, width, gram)
    # the document store: rows numbered, bucketed by number, other columns in a struct so that no name clashes
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").alias("owner"), "text", F.struct(*rest, F.lit(0).alias("_")).alias("other"))
    store = log.bucketed(numbered, "row_id")
    # whole copies of a text with a smaller doc_id are repeats throughout, and repeat nothing that it does not
    sums = stored(store.filter("owner IS NOT NULL").select("row_id", "owner", F.sha2("text", 256).alias("sum")))
    first = stored(sums.groupBy("sum").agg(F.min("owner").alias("first"), F.max("owner").alias("last")).filter("first < last").drop("last"))
    copies = stored(sums.join(first.hint("merge"), "sum").filter("first < owner").select("row_id", F.lit(True).alias("copy")))
    discard(sums, first)
    ids = store.filter("owner IS NOT NULL").join(copies.hint("merge"), "row_id", "left_anti")
    cuts = ids.approxQuantile("owner", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    found: DataFrame | None = None
    for low, high in zip(bounds[:-1], bounds[1:]):
        batch = ids
        if low is not None:
            batch = batch.filter(F.col("owner") > low)
        if high is not None:
            batch = batch.filter(F.col("owner") <= high)
        new = log.add(batch)
        found = new if found is None else found.unionByName(new)
    log.close()
    ats = found.groupBy("row_id").agg(F.collect_list("at").alias("ats"))
    joined = store.join(ats.hint("merge"), "row_id", "left").join(copies.hint("merge"), "row_id", "left").select("owner", "text", "other", F.coalesce("ats", F.array().cast("array<int>")).alias("ats"), F.coalesce("copy", F.lit(False)).alias("copy"))
    schema = "owner long, other " + joined.schema["other"].dataType.simpleString() + ", n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict({"owner": part.column("owner"), "other": part.column("other"), **_kept(part, width, with_text)})

    return joined.mapInArrow(cut, schema)


def op5_fingerprint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words left after repeated 50-word windows are removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
