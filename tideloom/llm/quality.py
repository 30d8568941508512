"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm.common import small_batches, table
from tideloom.llm.textarrays import Texts, mix, ragged, slices, span_hashes
from tideloom.llm.wordtable import distinct_words

#: Most labelled rows a fit reads: those with the smallest hashes of doc_id.
MAX_TRAINING_ROWS = 5000
#: Buckets of words, of word shapes, and of how a word repeats what stands before it.
WORDS, SHAPES, REPEATS = 1 << 14, 1 << 10, 4
TERMS = WORDS + SHAPES + REPEATS
DIM, NONZERO, WINDOW = 64, 6, 2
#: Terms that travel in one row while their context sums are added up.
BLOCK = 128
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

# classes of bytes for shapes: letters by case, digits, other bytes of multi-byte characters; signs stand for themselves
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[0x80:] = 1
_UPPER_AFTER_C3 = np.zeros(256, bool)
_UPPER_AFTER_C3[0x80:0x9F] = True


def _shapes(texts: Texts, which: np.ndarray) -> np.ndarray:
    """Hash of the sequence of byte classes of each of these words, runs of one class counted once."""
    size = texts.ends[which] - texts.starts[which]
    raw = texts.buf[ragged(texts.starts[which], size)]
    start = np.cumsum(size) - size
    kind = _CLASS[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    upper = after[_UPPER_AFTER_C3[raw[after]]]
    kind[upper] = kind[upper - 1] = 2
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[start] = True
    place = np.append(0, np.cumsum(change))
    return span_hashes(kind[change], place[start], place[start + size])


@dataclass
class Terms:
    """Terms of the words of some texts: each distinct word's bucket and shape, each word's number among them and repetition."""

    bucket: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    repeat: np.ndarray
    counts: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def terms(texts: Texts) -> Terms:
    """Terms of each word. Repetition: 1 after the same word, 2 inside three words that the text holds again, 3 both."""
    hashes = texts.hashes()
    distinct, first, word = distinct_words(hashes)
    repeat = np.zeros(len(hashes), np.int64)
    repeat[1:][(hashes[1:] == hashes[:-1]) & (texts.doc[1:] == texts.doc[:-1])] = 1
    starts, window = texts.windows(hashes, 3)
    key = mix(window + mix(texts.doc[starts].astype(np.uint64)))
    ranked = np.sort(key)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(again):
        twice = starts[again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key]
        for k in range(3):
            repeat[twice + k] |= 2
    return Terms((distinct % np.uint64(WORDS)).astype(np.int64), (_shapes(texts, first) % np.uint64(SHAPES)).astype(np.int64), word, repeat, texts.counts)


def index_vectors() -> np.ndarray:
    """The fixed sparse random index vector of each term, of whole numbers."""
    rng = np.random.Generator(np.random.PCG64(977))
    out = np.zeros((TERMS, DIM), np.int64)
    rows = np.repeat(np.arange(TERMS), NONZERO)
    np.add.at(out, (rows, rng.integers(0, DIM, len(rows))), rng.choice(np.array([-1, 1]), len(rows)))
    return out


def add_contexts(total: np.ndarray, some: Terms, index: np.ndarray) -> None:
    """Adds, for each term, the index vectors of all terms of the words at most WINDOW away from its words.

    total: terms by DIM, index: DIM by terms. Whole numbers, so that the sums do not depend on the order of rows or tasks.
    """
    if not len(some.word):
        return
    # kinds of words (distinct word and repetition), after the last of which comes a gap; gaps keep texts apart
    both, kind = np.unique(some.word * REPEATS + some.repeat, return_inverse=True)
    bucket, shape, repeat = some.bucket[both // REPEATS], some.shape[both // REPEATS], both % REPEATS
    line = np.full(len(kind) + WINDOW * (len(some.counts) + 1), len(both))
    line[np.arange(len(kind)) + WINDOW * (some.doc + 1)] = kind
    inner = line[WINDOW:-WINDOW]
    own = np.zeros(len(both) + 1, np.float32)
    for d in range(DIM):
        own[:-1] = index[d][bucket] + index[d][WORDS + shape] + index[d][WORDS + SHAPES + repeat]
        each = own[line]
        near = np.zeros(len(inner), np.float32)
        for k in (*range(WINDOW), *range(WINDOW + 1, 2 * WINDOW + 1)):
            near += each[k : k + len(inner)]
        sums = np.bincount(inner, near, minlength=len(both) + 1)[:-1]
        for first, value, size in ((0, bucket, WORDS), (WORDS, shape, SHAPES), (WORDS + SHAPES, repeat, REPEATS)):
            total[first : first + size, d] += np.bincount(value, sums, minlength=size).astype(np.int64)


def term_vectors(total: np.ndarray) -> np.ndarray:
    """Each term's own index vector and its summed contexts, both at length one, together at length one."""
    size = np.linalg.norm(total, axis=1, keepdims=True)
    both = index_vectors() / NONZERO**0.5 + np.divide(total, size, out=np.zeros(total.shape), where=size > 0)
    return (both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)).astype(np.float16)


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """The term vectors, from the contexts of all words of all documents.

    A task sums its documents' contexts in a matrix of fixed size and sends it in blocks of
    terms; the blocks are added up where they were dealt to, one sum a block in memory.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, index = np.zeros((TERMS, DIM), np.int64), np.ascontiguousarray(index_vectors().T)
        for batch in batches:
            for part in slices(batch):
                add_contexts(total, terms(Texts(part.column("text"))), index)
        for block, at in enumerate(range(0, TERMS, BLOCK)):
            if total[at : at + BLOCK].any():
                yield _block(block, total[at : at + BLOCK])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(zlib.decompress(raw), np.int64).reshape(-1, DIM)
                sums[block] = sums[block] + part if block in sums else part
        for block, part in sums.items():
            yield _block(block, part)

    rows = docs.select("text").mapInArrow(gather, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary")
    total = np.zeros((TERMS, DIM), np.int64)
    for block, raw in rows.collect():  # one row a block of terms
        total[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(zlib.decompress(raw), np.int64).reshape(-1, DIM)
    return term_vectors(total)


def _block(block: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())})


def pooled(some: Terms, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text's words, shapes and repetitions, side by side; zero for texts without words."""
    n = len(some.counts)
    out = np.zeros((n, 3 * DIM))
    full = np.flatnonzero(some.counts)
    if not len(full):
        return out
    first, doc = (np.cumsum(some.counts) - some.counts)[full], some.doc
    columns = np.ascontiguousarray(vectors[:WORDS].T.astype(np.float64))
    word = some.bucket[some.word]
    for d in range(DIM):
        out[full, d] = np.add.reduceat(columns[d][word], first)
    for k, (value, size, at) in enumerate(((some.shape[some.word], SHAPES, WORDS), (some.repeat, REPEATS, WORDS + SHAPES)), 1):
        shares = np.bincount(doc * size + value, minlength=n * size).reshape(n, size)
        out[:, k * DIM : (k + 1) * DIM] = shares @ vectors[at : at + size].astype(np.float64)
    out[full] /= some.counts[full, None]
    return out


@dataclass
class Network:
    """tanh hidden layer and one logit, divided by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the log loss; the temperature minimises the log loss on a fifth of the rows kept apart."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x, y = x.astype(np.float64), y.astype(np.float64)
    rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    net = Network(x.mean(0) if len(y) else np.zeros(3 * DIM), np.maximum(x.std(0), 1e-3) if len(y) else np.ones(3 * DIM), rng.normal(0, (3 * DIM) ** -0.5, (3 * DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return net
    order = rng.permutation(len(y))
    apart, rest = order[: len(y) // 5], order[len(y) // 5 :]
    net.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    z = (x - net.centre) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(rest)
        for lo in range(0, len(rest), BATCH):
            some = rest[lo : lo + BATCH]
            hidden = np.tanh(z[some] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -40, 40))) - y[some]) / len(some)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            slopes = [z[some].T @ back + DECAY * params[0], back.sum(0), hidden.T @ error + DECAY * params[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(apart):
        logit, grid = net.logits(x[apart]), np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        loss = [np.logaddexp(0, np.where(y[apart] > 0, -logit, logit) / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id: str = "doc_id"):
    """True for rows that no fit may read: crc32(doc_id as text) modulo 4 is 2 (false for null)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, Network]:
    """(term vectors, network): vectors from all documents, the network from at most `rows` labelled rows that are not held out.

    The rows with the smallest hashes of doc_id are taken, so the sample does not depend
    on order or partitions. One task reads this bounded sample and returns the network.
    Without rows of both labels the score is the label's rate.
    """
    spark = docs.sparkSession
    chosen = labels.filter(F.col("quality").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # of rows with one doc_id the smallest text counts
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_quality").alias("_quality"))
    vectors = corpus_vectors(docs)
    sent = spark.sparkContext.broadcast(vectors)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, truth = [np.zeros((0, 3 * DIM))], [np.zeros(0)]
        for batch in batches:
            for part in slices(batch):
                x.append(pooled(terms(Texts(part.column("text"))), sent.value))
                truth.append(part.column("_quality").to_numpy())
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train(np.concatenate(x), np.concatenate(truth)))], pa.binary())})

    model = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "model binary").collect()
    return vectors, pickle.loads(model[0][0]) if model else train(np.zeros((0, 3 * DIM)), np.zeros(0))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Scores every row's whole text; the score is a calibrated probability of label 1.

    docs: doc_id and text; labels: doc_id and quality (0 or 1; other values and nulls are
    ignored, repeated rows count once with the smaller label). Only texts enter a score.
    Null and empty texts have the score of a text without words; repeated rows are scored
    alike; an empty table gives no rows. The model has a fixed size and is broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, rows))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _scored(batches, model.value):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "held_out": part.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(judge, SCHEMA)


def _scored(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, Network]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    vectors, net = model
    for batch in batches:
        for part in slices(batch):
            yield part, net.score(pooled(terms(Texts(part.column("text"))), vectors))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; see score_quality."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _scored(batches, model.value):
            yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op8_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
