"""Operators on texts against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideloom.llm.common import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words string, kept string, shard string, owner string, score string"


def make(spark, rows):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "x", "y", None, "z", "w") for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice("the of and it was an rain stone river hill green cloud bird quiet old light".split()) + rng.choice(["", "", "s", "ing", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared, line = prose(rng, 70), prose(rng, 12)
    out = [(i, prose(rng, rng.randint(5, 300))) for i in range(40)]
    out += [(100 + i, prose(rng, 30) + "\n" + shared + "\t" + prose(rng, 20)) for i in range(6)]
    out += [(200 + i, out[3][1]) for i in range(3)] + [(3, out[3][1])]
    words = out[5][1].split(" ") if len(out[5][1]) > 800 else prose(rng, 200).split(" ")
    out += [(300, " ".join(words))]
    for i in range(5):
        w = list(words)
        w[20 * i + 7] = "changed"
        out.append((301 + i, " ".join(w)))
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one two three"), (405, "\n".join([line] * 8)), (406, prose(rng, 9000)), (None, prose(rng, 60)), (407, "ünï cødé — “quotes” 日本語 😀 Ωμέγα " * 15), (408, "A&B <x> #1 $2 |t| 100%")]
    return out


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_fertility(spark, rows):
    from tideloom.llm.fertility import SCRIPTS, fertility_rules

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    run = lambda df: fertility_rules(df, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"))
    out = collect(run(make(spark, rows)))
    assert len(out) == len(rows)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in out:
        t = texts[r["doc_id"]][0]
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), dup, len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
        ids = [x for v in w for x in model.encode(v)]
        if w:
            n = collections.Counter(ids)
            entropy = -sum(v / len(ids) * np.log2(v / len(ids)) for v in n.values())
            assert np.isclose(r["piece_chars"], sum(map(len, w)) / len(ids)) and np.isclose(r["token_entropy"], entropy)
            assert np.isclose(r["byte_share"], sum(3 <= x < 259 for x in ids) / len(ids))
        else:
            assert r["piece_chars"] is None and not r["kept"]
        assert r["script"] in SCRIPTS
    assert run(make(spark, rows).limit(0)).count() == 0


def test_evenness_is_free_of_length(spark):
    from tideloom.llm.fertility import EVENNESS_WINDOW, fertility_rules

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = random.Random(8)
    stem = [a + b for a in "rain stone river hill green cloud bird quiet old light house water field winter".split() for b in ("", "s", "ing", ",", ".", "ly", "er", " the", " of")]
    text = lambda n: " ".join(" ".join(rng.choices(stem, k=n)).split()[:n])
    made = [(n, text(n)) for n in (300, 2000, 20_000, 200_000)] + [(7, "rain hill " * 40_000)]
    out = {r.doc_id: r for r in fertility_rules(make(spark, made), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken")).collect()}
    for i, t in made:
        ids = [x for w in WORD.findall(t) for x in model.encode(w)]
        k = -(-len(ids) // EVENNESS_WINDOW)
        parts = [np.array(ids)[np.arange(len(ids)) * k // len(ids) == w] for w in range(k)]
        shares = [np.unique(p, return_counts=True)[1] / len(p) for p in parts]
        assert np.isclose(out[i].evenness, np.mean([-(s * np.log2(s)).sum() / np.log2(len(p)) for s, p in zip(shares, parts)]))
    for n in (20_000, 200_000):
        assert out[n].evenness >= 0.45 and "evenness" not in out[n].failed_bands
        assert abs(out[n].evenness - out[2000].evenness) < 0.02
    assert "evenness" in out[7].failed_bands  # monotony is still found


def test_long_clean_texts_are_kept(spark):
    """Documents of the tables strung together, those that the rules keep, stay kept at any length."""
    from tideloom.llm.fertility import fertility_rules

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en'").select("doc_id", "text", "lang")
    run = lambda df: fertility_rules(df, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"))
    clean = run(docs).filter("kept AND n_repeat_words < 0.05 * n_words AND n_symbols < 0.05 * n_words").select("doc_id").distinct()
    words = " ".join(r.text for r in docs.join(clean, "doc_id").dropDuplicates(["text"]).orderBy("doc_id").select("text").collect()).split()
    assert len(words) >= 200_000
    rows = [(n, " ".join(words[:n]), "en") for n in (20_000, 200_000)]
    out = {r.doc_id: r for r in run(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {n: r.failed_bands for n, r in out.items()} == {20_000: [], 200_000: []}
    assert all(r.kept for r in out.values()), [(r.n_words, r.n_repeat_words) for r in out.values()]


def brute_classes(rows, threshold=0.8):
    first, sets, root = {}, {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        root.setdefault(i, i)
        w = tuple(WORD.findall(t or ""))
        if w in first:
            join(first[w], i)
            continue
        first[w] = i
        sets[i] = collections.Counter(w[k : k + 5] for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = sum((sets[a] & sets[b]).values())
                if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= threshold:
                    join(a, b)
    return {i: find(i) for i in root}


def test_near_duplicates(spark, rows):
    from tideloom.llm.neardup import near_duplicates

    out = collect(near_duplicates(make(spark, rows)))
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None} == brute_classes(rows)
    assert [r["class_id"] for r in out if r["doc_id"] is None] == [None]
    assert near_duplicates(make(spark, rows).limit(0)).count() == 0


def test_near_duplicates_later_rounds(spark):
    """Many texts around one original, each like it or only half like it, and chains."""
    from tideloom.llm.neardup import near_duplicates

    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 5, 8])):
            w[k] = f"x{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(w)))
    out = {r["doc_id"]: r["class_id"] for r in collect(near_duplicates(make(spark, texts)))}
    assert out == brute_classes(texts)


def test_order_matters():
    from tideloom.llm.neardup import similar
    from tideloom.llm.textarrays import Texts

    a = [f"a{i}" for i in range(60)]
    blocks = [a[i : i + 10] for i in range(0, 60, 10)]
    shuffled = [w for b in reversed(blocks) for w in b]
    t = lambda *x: Texts(pa.array([" ".join(v) for v in x]))
    assert similar(t(a, a, a[:59]), t(a, shuffled, a), 5, 0.8).tolist() == [True, False, True]


def test_alignment_is_longest_common_subsequence():
    from tideloom.llm.neardup import aligned

    rng = random.Random(1)
    a = [[rng.randint(0, 9) * 16 for _ in range(rng.randint(1, 40))] for _ in range(20)]
    b = [[x for x in v if rng.random() < 0.8] + [rng.randint(0, 9) * 16 for _ in range(3)] for v in a]
    for x, y in zip(a, b):
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if u == v else max(table[i, j + 1], table[i + 1, j])
        assert aligned([np.array(x, np.uint64)], [np.array(y, np.uint64)], 60)[0] == table[-1, -1]


def brute_repeats(rows, width=50):
    first, kept = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept.append((i, len(w), len(gone), hashlib.sha256(" ".join(v for k, v in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(map(repr, kept))


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats(spark, rows, batches):
    from tideloom.llm.repeats import remove_repeats

    out = collect(remove_repeats(make(spark, rows), batches=batches, with_text=batches == 3))
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in out) == brute_repeats(rows)
    if batches == 3:
        for r in out:
            left = " ".join(WORD.findall(r["kept_text"] or ""))
            assert hashlib.sha256(left.encode()).hexdigest() == r["kept_sha256"]
        assert remove_repeats(make(spark, rows).limit(0)).count() == 0


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    from tideloom.llm.packing import pack_sequences

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = collect(pack_sequences(make(spark, rows), path, length=128))
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    spans = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] > 0
        spans[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, pieces in spans.items():
        whole = {k for k in want if k[0] == doc}
        if len(whole) == 1 and want[next(iter(whole))] == 1:
            ids = [x for _, part, _ in sorted(pieces) for x in part]
            assert (doc, tuple(ids)) in want and all(n == len(ids) for _, _, n in pieces)
    fills = []
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills) <= 128 and sum(f < 128 for f in fills) <= make(spark, rows).rdd.getNumPartitions()
    assert sum(fills) == sum(len(k[1]) * n for k, n in want.items())
    assert pack_sequences(make(spark, rows).limit(0), path).count() == 0


def test_sum_of_squares_choice():
    from tideloom.llm.packing import SumOfSquares

    rng, packer = random.Random(4), SumOfSquares(20)
    level = [0] * 21
    for i in range(300):
        size = rng.randint(1, 19)
        options = {0: 2 * level[size] + 1}
        for h in range(1, 21 - size):
            if level[h]:
                new = list(level)
                new[h] -= 1
                if h + size < 20:
                    new[h + size] += 1
                options[h] = sum(x * x for x in new) - sum(x * x for x in level)
        h = packer._choose(size)
        assert options[h] == min(options.values())
        list(packer.add(i, np.arange(size, dtype=np.int32)))
        level = packer.level.tolist()


def test_sharding(spark, rows):
    from tideloom.llm.sharding import differencing, shard_by_bytes

    out = collect(shard_by_bytes(make(spark, rows), 4))
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in out) == sorted(repr((i, size(t), zlib.crc32((t or "").encode()))) for i, t in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    home = collections.defaultdict(set)
    for r in out:
        home[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(v) == 1 for v in home.values())
    assert shard_by_bytes(make(spark, rows).limit(0)).count() == 0
    sizes = [8, 7, 6, 5, 4]
    parts = collections.Counter()
    for s, p in zip(sizes, differencing([[s] for s in sizes], 2)):
        parts[p[0]] += s
    assert sorted(parts.values()) == [14, 16]  # the known outcome of differencing on these numbers


def test_classifier(spark):
    from tideloom.llm.quality import fit, score_quality

    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        t = prose(rng, rng.randint(20, 80))
        docs.append((i, t if good else t.upper().replace(" ", "!! ")))
        labels.append((i, int(good)))
    docs += [(900, None), (901, ""), (None, "x y")]
    table = make(spark, docs)
    marks = spark.createDataFrame([*labels, (900, None), (None, 1), (5, labels[5][1])], "doc_id long, quality int")
    out = collect(score_quality(table, marks))
    assert len(out) == len(docs)
    truth = dict(labels)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert len(held) > 50 and np.mean([r["predicted"] == truth.get(r["doc_id"], r["predicted"]) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(fit(table, marks)[0], fit(table, flipped)[0])  # held-out labels are never read
    assert score_quality(table.limit(0), marks.limit(0)).count() == 0


def test_licenses(spark, rows):
    from tideloom.llm.licenses import BASE, scan_licenses, signature_rules

    lines = [(500, "Licensed under CC BY-NC 4.0, cc_by. All   Rights\nReserved"), (501, "Licensed under the GNU Lesser General Public License v2.1 or later"), (502, "SPDX-License-Identifier: Apache-2.0"), (503, "éCC BY cc-byte"), (504, "under the MIT License; under the MIT License")]
    out = {r["doc_id"]: r for r in collect(scan_licenses(make(spark, rows + lines)))}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows + lines:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for phrase, label in BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "lgpl-2.1" in out[501]["labels"] and "lgpl-3.0" not in out[501]["labels"]
    assert out[502]["labels"] == "apache-2.0" and out[502]["score"] == 1
    assert "cc-by-nc" in out[500]["labels"] and out[503]["n_base"] == 0
    assert len(signature_rules()) > 200
    assert scan_licenses(make(spark, rows).limit(0)).count() == 0


def test_short_license_names(spark):
    from tideloom.llm.licenses import scan_licenses

    forms = {
        "licensed under the GPLv3": "gpl-3.0", "GPLv3 license": "gpl-3.0", "Licensed under LGPLv2.1": "lgpl-2.1", "licensed under the AGPLv3": "agpl-3.0",
        "licensed under the GPLv2": "gpl-2.0", "licensed under the GPL v3": "gpl-3.0", "licensed under GPL-3.0": "gpl-3.0", "licensed under LGPLv3": "lgpl-3.0",
    }
    out = {r["doc_id"]: str(r) for r in collect(scan_licenses(make(spark, list(enumerate(forms)))).drop("text"))}
    for i, (form, label) in enumerate(forms.items()):
        assert f"'{label}'" in out[i], (form, out[i])


def test_license_suppression(spark):
    """Overlaps against a plain reading of the rule: a match inside another of no lower priority goes."""
    from tideloom.llm.licenses import scan_licenses, signature_rules

    text = "licensed under the apache license, version 2.0 and the new bsd license; copyright 2020 x, all rights reserved"
    spans = [(m.start(), m.end(), r.priority, k, r.label) for k, r in enumerate(signature_rules()) if r.keyword in text and r.also in text for m in re.finditer(r.pattern, text)]
    beats = lambda b, a: b[0] <= a[0] and a[1] <= b[1] and ((b[2] > a[2] or (b[2] == a[2] and b[3] < a[3])) if b[:2] == a[:2] else b[2] >= a[2])
    left = sorted((a[4], a[0], a[1] - a[0]) for a in spans if not any(beats(b, a) for b in spans))
    got = collect(scan_licenses(make(spark, [(1, text)])))[0]["detections"]
    assert sorted((d["label"], d["start"], d["length"]) for d in got) == left


def test_pieces(spark, rows):
    import sentencepiece

    from tideloom.llm.pieces import decode_pieces, encode_pieces

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    more = rows + [(600, "  lead and   trail  "), (601, "a\tb\r\nc\x00d"), (602, "<s></s><0x41>"), (603, "x" * 700)]
    out = encode_pieces(make(spark, more), path)
    ids = collections.defaultdict(list)
    for r in collect(out):
        ids[r["doc_id"]].append(r["ids"])
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
    for i, t in more:
        assert library.encode(t or "") in ids[i]
    back = {r["doc_id"]: r["text"] for r in collect(decode_pieces(out, path))}
    assert all(back[i] == (t or "") for i, t in more)
    assert encode_pieces(make(spark, rows).limit(0), path).count() == 0


def test_unigram_viterbi():
    """Models of kind unigram: the largest sum of scores, against all segmentations."""
    from itertools import product

    from tideloom.llm.pieces import PieceModel

    model = PieceModel(vocabulary("piece_bpe_32k.model"))
    model.bpe = False
    for word in ("▁there", "▁abc", "ingly"):
        best = -np.inf
        for cuts in product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for k, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(word[at:k])
                    at = k
            if all(p in model.rank for p in parts):
                best = max(best, sum(model.score[model.rank[p][1]] for p in parts))
        assert np.isclose(sum(model.score[i] for i in model._advance([word])[0]), best)
