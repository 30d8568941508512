"""Tokeniser-fertility quality rules."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tideloom.llm.common import small_batches, table, vocabulary
from tideloom.llm.textarrays import Texts, mix, ragged, slices, span_hashes
from tideloom.llm.wordtable import distinct_words, word_table

#: Scripts by the UTF-8 lead bytes of their letters.
SCRIPT_LEADS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCE, 0xCF],
    "cyrillic": [*range(0xD0, 0xD4)],
    "hebrew": [0xD6, 0xD7],
    "arabic": [*range(0xD8, 0xDC)],
    "indic": [0xE0],
    "kana": [0xE3],
    "han": [*range(0xE4, 0xEA)],
    "hangul": [*range(0xEA, 0xEE)],
}
SCRIPTS = [*SCRIPT_LEADS, "other"]

#: metric -> (least, most); a text outside any band of its language, else of its script, is rejected.
Bands = Mapping[str, Mapping[str, tuple[float, float]]]
#: Characters per token of the piece and of the byte vocabulary, share of byte-fallback
#: tokens, and evenness: token entropy relative to the most that as many tokens can have,
#: averaged over windows of at most EVENNESS_WINDOW tokens that cover the whole text.
DEFAULT_BANDS: Bands = {
    "en": {"piece_chars": (1.8, 6.0), "byte_chars": (1.85, 6.5), "byte_share": (0.0, 0.05), "evenness": (0.45, 1.0)},
    "de": {"piece_chars": (1.8, 6.0), "byte_chars": (1.7, 6.5), "byte_share": (0.0, 0.05), "evenness": (0.45, 1.0)},
    "fr": {"piece_chars": (1.6, 6.0), "byte_chars": (1.55, 6.5), "byte_share": (0.0, 0.05), "evenness": (0.45, 1.0)},
    "es": {"piece_chars": (1.65, 6.0), "byte_chars": (1.55, 6.5), "byte_share": (0.0, 0.05), "evenness": (0.45, 1.0)},
    "latin": {"piece_chars": (1.5, 6.5), "byte_chars": (1.3, 7.0), "byte_share": (0.0, 0.1), "evenness": (0.4, 1.0)},
    "greek": {"piece_chars": (0.8, 4.0), "byte_chars": (0.4, 4.0), "byte_share": (0.0, 0.3), "evenness": (0.35, 1.0)},
    "cyrillic": {"piece_chars": (1.2, 5.0), "byte_chars": (0.5, 5.0), "byte_share": (0.0, 0.2), "evenness": (0.4, 1.0)},
    "hebrew": {"piece_chars": (0.8, 4.0), "byte_chars": (0.4, 4.0), "byte_share": (0.0, 0.3), "evenness": (0.35, 1.0)},
    "arabic": {"piece_chars": (0.8, 4.0), "byte_chars": (0.4, 4.0), "byte_share": (0.0, 0.4), "evenness": (0.35, 1.0)},
    "indic": {"piece_chars": (0.3, 3.0), "byte_chars": (0.2, 3.0), "byte_share": (0.0, 0.9), "evenness": (0.25, 1.0)},
    "kana": {"piece_chars": (0.5, 3.0), "byte_chars": (0.3, 3.0), "byte_share": (0.0, 0.6), "evenness": (0.35, 1.0)},
    "han": {"piece_chars": (0.3, 3.0), "byte_chars": (0.2, 3.0), "byte_share": (0.0, 0.9), "evenness": (0.35, 1.0)},
    "hangul": {"piece_chars": (0.3, 3.0), "byte_chars": (0.2, 3.0), "byte_share": (0.0, 0.9), "evenness": (0.35, 1.0)},
    "other": {"piece_chars": (0.2, 8.0), "byte_chars": (0.2, 8.0), "byte_share": (0.0, 0.95), "evenness": (0.2, 1.0)},
}
METRICS = ("piece_chars", "byte_chars", "byte_share", "evenness")
#: Prose's entropy levels off while log2 of the tokens keeps growing, so over a whole text evenness would fall with length alone.
EVENNESS_WINDOW = 1024

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
    " script string, piece_chars double, byte_chars double, byte_share double, token_entropy double, evenness double, failed_bands array<string>"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCRIPT = np.full(256, -1)
for _i, _leads in enumerate(SCRIPT_LEADS.values()):
    _SCRIPT[_leads] = _i


def _group_counts(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each (doc, value), its rows, group of each row)."""
    key = mix(value.astype(np.uint64) + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[start], np.diff(np.r_[start, len(key)]), group


def base_counts(texts: Texts, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the base rules for each text."""
    out = {"n_words": texts.counts, "word_chars": texts.per_text(texts.doc, texts.chars()).astype(np.int64)}
    sums = np.r_[0, np.cumsum(_SYMBOL[texts.buf])]
    out["n_symbols"] = sums[texts.off[1:]] - sums[texts.off[:-1]]
    # lines: from a text's start or the byte after \n up to the next \n or the text's end
    feeds = np.flatnonzero(texts.buf == 10)
    begin = np.union1d(texts.off[:-1], feeds + 1)
    begin = begin[begin < len(texts.buf)]
    end = np.minimum(np.r_[begin[1:], len(texts.buf)], len(texts.buf))
    has_feed = np.zeros(len(texts.buf) + 1, bool)
    has_feed[feeds] = True
    end = end - (has_feed[end - 1] & (end > begin)) if len(end) else end
    words = np.searchsorted(texts.starts, end) - np.searchsorted(texts.starts, begin)
    begin, end = begin[words > 0], end[words > 0]
    line_doc = np.searchsorted(texts.off, begin, "right") - 1
    first, _, _ = _group_counts(line_doc, span_hashes(texts.buf, begin, end))
    out["n_dup_lines"] = texts.per_text(line_doc) - texts.per_text(line_doc[first])
    # words inside a three-word window that the text has twice or more
    at, window = texts.windows(hashes, 3)
    _, size, group = _group_counts(texts.doc[at], window)
    repeated = at[size[group] > 1] if len(at) else at
    covered = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        covered[repeated + k] = True
    out["n_repeat_words"] = texts.per_text(texts.doc[covered[: len(hashes)]])
    return out


def _entropies(group: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Entropy in bits of the values of each group; size: its rows."""
    first, count, _ = _group_counts(group, value)
    owner = group[first]
    p = count / np.maximum(size[owner], 1)
    return np.bincount(owner, -p * np.log2(p), minlength=len(size))


def _evenness(doc: np.ndarray, ids: np.ndarray, n: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    """Evenness of each text; longer ones than a window are cut into equal windows. 1 for one token, NaN for none."""
    out = np.where(n > 0, entropy / np.log2(np.maximum(n, 2)), np.nan)
    out[n == 1] = 1.0
    many = np.where(n > EVENNESS_WINDOW, -(-n // EVENNESS_WINDOW), 0)
    if not many.any():
        return out
    at = np.flatnonzero(many[doc])
    own = doc[at]
    start = np.cumsum(n) - n
    window = (np.cumsum(many) - many)[own] + (at - start[own]) * many[own] // n[own]
    size = np.bincount(window, minlength=many.sum())
    even = _entropies(window, ids[at], size) / np.log2(size)
    total = np.bincount(np.repeat(np.arange(len(n)), many), even, minlength=len(n))
    return np.where(many > 0, total / np.maximum(many, 1), out)


def token_metrics(texts: Texts, hashes: np.ndarray, piece_path: str, byte_path: str) -> dict[str, np.ndarray]:
    """Fertility of each text under both vocabularies; every word is encoded on its own. NaN for texts without words."""
    pieces, ranks = word_table(piece_path), word_table(byte_path)
    chars = texts.per_text(texts.doc, texts.chars())
    words = distinct_words(hashes)
    start, count = pieces.lookup(texts, words)
    ids = pieces.ids[ragged(start, count)]
    doc = np.repeat(texts.doc, count)
    n = texts.per_text(doc)
    fallback = texts.per_text(doc[(ids >= 3) & (ids < 259)])  # the 256 byte pieces follow the three control pieces
    entropy = _entropies(doc, ids, n)
    _, byte_count = ranks.lookup(texts, words)
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "piece_chars": chars / n,
            "byte_chars": chars / texts.per_text(texts.doc, byte_count),
            "byte_share": fallback / n,
            "token_entropy": np.where(n > 0, entropy, np.nan),
            "evenness": _evenness(doc, ids, n, entropy),
        }


def scripts(texts: Texts) -> np.ndarray:
    """Index in SCRIPTS of the script with most letters (the earlier one on ties; `other` without letters)."""
    kind = _SCRIPT[texts.buf]
    letter = np.flatnonzero(kind >= 0)
    doc = np.searchsorted(texts.off, letter, "right") - 1
    table = np.bincount(doc * len(SCRIPT_LEADS) + kind[letter], minlength=texts.n * len(SCRIPT_LEADS)).reshape(texts.n, -1)
    return np.where(table.max(1, initial=0) > 0, table.argmax(1), len(SCRIPTS) - 1)


def _verdicts(part: pa.RecordBatch, piece_model: str, byte_ranks: str, known: Bands) -> dict[str, pa.Array]:
    """The columns of SCHEMA for some rows."""
    texts = Texts(part.column("text"))
    hashes = texts.hashes()
    base, tokens = base_counts(texts, hashes), token_metrics(texts, hashes, piece_model, byte_ranks)
    failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
    script = np.array(SCRIPTS, object)[scripts(texts)]
    langs = part.column("lang").to_pylist() if "lang" in part.schema.names else [None] * texts.n
    which = [lang if lang in known else s if s in known else "other" for lang, s in zip(langs, script)]
    out_of = {}
    for m in METRICS:
        low, high = (np.array([known.get(w, {}).get(m, (-np.inf, np.inf))[k] for w in which], float) for k in (0, 1))
        out_of[m] = (tokens[m] < low) | (tokens[m] > high)
    reasons = [[m for m in METRICS if out_of[m][i]] for i in range(texts.n)]
    kept = ~failed & np.array([not r for r in reasons], bool)
    columns = {"doc_id": part.column("doc_id").cast(pa.int64())} | {k: pa.array(v.astype(np.int64)) for k, v in base.items()}
    columns |= {"base_failed": pa.array(failed), "kept": pa.array(kept), "script": pa.array(script.tolist(), pa.string())}
    columns |= {k: pa.array(v, pa.float64(), mask=np.isnan(v)) for k, v in tokens.items()}
    return columns | {"failed_bands": pa.array(reasons, pa.list_(pa.string()))}


def fertility_rules(docs: DataFrame, piece_model: str, byte_ranks: str, bands: Bands = DEFAULT_BANDS) -> DataFrame:
    """Judges every row's whole text by base rules and by tokeniser-fertility bands.

    docs: doc_id, text and, if present, lang (others are ignored). base_failed holds for
    under 50 words or more than half of the words in repeated three-word windows. A text
    that passes is kept if each of its metrics lies inside the band of its language, or of
    its main script where the language has none. Null and empty texts have zero counts,
    null metrics and fail; repeated rows are judged alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    known = {k: dict(b) for k, b in bands.items()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(_verdicts(part, piece_model, byte_ranks, known))

    return docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else [])).mapInArrow(judge, SCHEMA)


def filter_fertility(docs: DataFrame, piece_model: str, byte_ranks: str, bands: Bands = DEFAULT_BANDS) -> DataFrame:
    """The rows of docs, all columns, that fertility_rules keeps."""
    small_batches(docs.sparkSession)
    known = {k: dict(b) for k, b in bands.items()}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(_verdicts(part, piece_model, byte_ranks, known)["kept"])

    return docs.mapInArrow(keep, docs.schema)


def op1_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility and verdict of every document."""
    return fertility_rules(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"))
