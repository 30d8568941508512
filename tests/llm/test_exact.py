"""Results against DuckDB's SQL, the libraries and plain Python on awkward input."""

import collections
import glob
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from test_texts import brute_classes, collect, make, prose
from tideloom.llm.common import vocabulary
from tideloom.llm.entry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    rel = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    assert ours == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())


def parity(n, flip):
    """The parity sequence of two letters: sums of powers of one base cancel over it and its complement."""
    return [("ba" if flip else "ab")[bin(i).count("1") % 2] for i in range(n)]


def test_structured_texts_do_not_collide():
    from tideloom.llm.neardup import shingles, similar
    from tideloom.llm.repeats import window_keys
    from tideloom.llm.textarrays import Texts, span_hashes, window_hashes

    one, two = "".join(parity(1024, False)), "".join(parity(1024, True))
    texts = Texts(pa.array([f"{one} {two} {one}", f"{one[:200]} {two[:200]}"]))
    for seed in (0, 5):
        h = texts.hashes(seed)
        assert h[0] == h[2] != h[1] and h[3] != h[4]
    rows = Texts(pa.array([" ".join(parity(4096, False)), " ".join(parity(4096, True))]))
    h = rows.hashes()
    wide = window_hashes(h, 1024)
    assert wide[0] != wide[4096] and wide[0] == window_hashes(h[:1024], 1024)[0]
    at = np.array([0, 4096])
    assert all(len(set(keys.tolist())) == 2 for keys in window_keys(rows, at, 1024))
    assert not similar(Texts(pa.array([one])), Texts(pa.array([two])), 5, 0.8)[0]
    value, _ = shingles(rows, 5)
    words = [(*parity(4096, f)[i : i + 5],) for f in (False, True) for i in range(4092)]
    assert len(set(value.tolist())) == len(set(words))
    raw = np.frombuffer(b"a\0a\0\0bcdefghij" * 3, np.uint8)
    spans = [(i, j) for i in range(len(raw)) for j in range(i + 1, len(raw) + 1)]
    hashes = span_hashes(raw, *np.array(spans).T)
    seen = collections.defaultdict(set)
    for (i, j), value in zip(spans, hashes.tolist()):
        seen[value].add(raw[i:j].tobytes())
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len({raw[i:j].tobytes() for i, j in spans})


def test_structured_words_are_encoded_as_the_library_does(spark):
    from tokenizers import Tokenizer

    from tideloom.llm.packing import pack_sequences
    from tideloom.llm.quality import terms
    from tideloom.llm.textarrays import Texts

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["".join(parity(1024, f)) for f in (False, True)]
    out = {r["doc_id"]: r["ids"] for r in collect(pack_sequences(make(spark, list(enumerate(texts))).coalesce(1), path, length=1 << 14))}
    assert out == {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    both = terms(Texts(pa.array([" ".join(texts)])))
    assert len(both.bucket) == 2 and len(set(both.word.tolist())) == 2


def test_near_duplicates_of_ids_with_several_texts(spark):
    from tideloom.llm.neardup import near_duplicates

    rng = random.Random(3)
    a, b, c = (prose(rng, 80) for _ in range(3))
    near = lambda t: t + " end"
    rows = [(5, a), (5, b), (9, near(b)), (9, near(b)), (2, near(a)), (7, c), (8, c), (8, prose(rng, 60)), (11, None), (12, ""), (None, a)]
    out = collections.defaultdict(set)
    links = collections.defaultdict(set)
    for r in collect(near_duplicates(make(spark, rows))):
        out[r["doc_id"]].add(r["class_id"])
        links[r["doc_id"]].add(r["n_links"] > 0)
    assert dict(out) == {5: {2}, 9: {2}, 2: {2}, 7: {7}, 8: {7}, 11: {11}, 12: {11}, None: {None}}
    assert True in links[9] and True in links[2] and links[7] == {False}


def test_near_duplicates_of_long_texts(spark):
    """Texts of more shingles than any sketch or cell holds, at and just under the threshold."""
    from tideloom.llm.neardup import near_duplicates

    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]

    def changed(share):
        w = list(base)
        for k in range(0, int(3000 * share)):
            w[k * 7 % 3000] = f"x{rng.randint(0, 10**6)}"
        return " ".join(w)

    rows = [(i, changed(s)) for i, s in enumerate([0, 0.01, 0.02, 0.022, 0.0245, 0.03, 0.05, 0.2])]
    rows += [(20 + i, " ".join(base[: 2000 + 300 * i])) for i in range(4)]
    assert {r["doc_id"]: r["class_id"] for r in collect(near_duplicates(make(spark, rows)))} == brute_classes(rows)


def test_near_duplicates_that_sketches_miss(spark):
    """A hub of four shingles whose links lie in a group of over 256 texts; texts of which no sketch agrees."""
    from tideloom.llm.neardup import CELL_TEXTS, FINE_ELL, near_duplicates

    hub, size = "a b c d e f g h", 1000
    assert size > CELL_TEXTS and len(hub.split()) - 4 < FINE_ELL
    rows = [(i, f"{hub} x{i}") for i in range(size)] + [(size, hub)]
    assert {r["class_id"] for r in collect(near_duplicates(make(spark, rows)))} == {0}
    rng = random.Random(6)
    rows = []
    for n in (8, 9, 12, 20, 60, 150, 400):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1 + n // 12])] = [f"x{rng.randint(0, 10**6)}"] * rng.choice([0, 1])
            rows.append((len(rows), " ".join(w)))
    for args in ({"count": 1, "ell": 40}, {"count": 1, "ell": 40, "threshold": 0.6}):
        out = {r["doc_id"]: r["class_id"] for r in collect(near_duplicates(make(spark, rows), **args))}
        assert out == brute_classes(rows, args.get("threshold", 0.8))


def test_cells_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Four times the copies of one original, like it or a little less than enough, make about four times the members of cells."""
    from tideloom.llm import neardup

    made, dealt = [], neardup._dealt

    def counted(*args, **more):
        made[-1] += (out := dealt(*args, **more)).count()
        return out

    monkeypatch.setattr(neardup, "_dealt", counted)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    for size in (400, 1600):
        made.append(0)
        rows, edits = [(0, " ".join(base))], [0]
        for i in range(1, size):
            w = list(base)
            edits.append(rng.randint(1, 5))
            for at in rng.sample(range(7, 143, 8), edits[-1]):  # each takes five of the 146 shingles
                w[at] = f"x{rng.randint(0, 10**9)}"
            rows.append((i, " ".join(w)))
        expected = {i: 0 if e <= 3 else i for i, e in enumerate(edits)}
        assert {r["doc_id"]: r["class_id"] for r in collect(neardup.near_duplicates(make(spark, rows)))} == expected
    assert made[1] < 6 * made[0], made


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_heads_and_parities_rule_out_no_similar_pair(threshold):
    from tideloom.llm.neardup import heads, labels_of, parities, parity_distance, shingles
    from tideloom.llm.textarrays import Texts

    rng = random.Random(7)
    texts = []
    for n in (1, 5, 9, 30, 90, 400):
        base = [f"w{rng.randint(0, n)}" for _ in range(n)]
        for _ in range(12):
            w = list(base)
            for k in rng.sample(range(n), min(n, rng.choice([0, 1, 2, n // 10]))):
                w[k] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(w[: n - rng.randint(0, n // 8)]))
    value, doc = shingles(Texts(pa.array(texts)), 5)
    label, n = labels_of(value, doc), np.bincount(doc)
    data, size = parities(label, doc, n)
    common, times = np.unique(label, return_counts=True)
    head, most = heads(label, doc, n, common[times > 4], threshold)
    head, sets = np.split(head, np.cumsum(most)[:-1]), np.split(label, np.cumsum(n)[:-1])
    u, v = np.triu_indices(len(texts), 1)
    far = parity_distance(data, np.cumsum(size) - size, size, u, v)
    some = 0
    for a, b, d in zip(u.tolist(), v.tolist(), far.tolist()):
        both, either = len(np.intersect1d(sets[a], sets[b])), len(np.union1d(sets[a], sets[b]))
        assert d <= either - both
        if both >= threshold * either:
            some += 1
            assert len(np.intersect1d(head[a], head[b]))
    assert some > 20


def test_cells_join_what_pairs_join():
    """Links within cells, small and large and of two halves, connect the same texts as all pairs do."""
    from tideloom.llm.neardup import cell_links, similar
    from tideloom.llm.textarrays import Texts

    rng = random.Random(4)
    texts, cell, half = [], [], []
    for c, size in enumerate([2, 5, 12, 30, 60]):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        for i in range(size):
            w = list(base)
            for k in rng.sample(range(60), rng.choice([0, 1, 2, 3, 12])):
                w[k] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
            cell.append(c)
            half.append(i % 2 if c in (2, 4) else 0)
    root = np.arange(len(texts))
    u, v = cell_links(Texts(pa.array(texts)), np.array(cell), np.array(half), root, 5, 0.8)

    def classes(pairs):
        up = list(range(len(texts)))
        find = lambda x: x if up[x] == x else find(up[x])
        for x, y in pairs:
            up[max(find(x), find(y))] = min(find(x), find(y))
        return [find(x) for x in range(len(texts))]

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if cell[i] == cell[j] and (cell[i] not in (2, 4) or half[i] != half[j])]
    ok = similar(Texts(pa.array([texts[i] for i, _ in pairs])), Texts(pa.array([texts[j] for _, j in pairs])), 5, 0.8)
    assert classes(zip(u.tolist(), v.tolist())) == classes([p for p, good in zip(pairs, ok) if good])
    assert len(u) < len(texts)
    assert len(cell_links(Texts(pa.array(texts)), np.array(cell), np.array(half), np.zeros(len(texts)), 5, 0.8)[0]) == 0


def test_shards_are_near_equal(spark):
    from tideloom.llm.sharding import shard_by_bytes

    rng = random.Random(6)
    rows = [(i % 400 if i % 3 else None, "x" * int(rng.paretovariate(1.2) * 20) + str(i % 350)) for i in range(900)] + [(1000, "y" * 3000)]
    out = collect(shard_by_bytes(make(spark, rows), 4, run_size=50))
    total, groups = collections.Counter(), collections.Counter()
    for r in out:
        total[r["shard"]] += r["size"]
        groups[r["text_crc32"], r["size"]] += r["size"]
    assert len(out) == len(rows) and max(total.values()) - min(total.values()) <= max(groups.values())
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_classifier_against_plain_python(spark):
    """Scores from the fitted weights, word by word; the temperature is the best of its grid on the rows kept apart."""
    import re

    from tideloom.llm import quality as q
    from tideloom.llm.textarrays import Texts

    rng = random.Random(12)
    docs = [(i, prose(rng, rng.randint(5, 60)) if i % 2 else (prose(rng, 8) + " ") * 6) for i in range(120)] + [(500, ""), (501, None), (502, "a a a a"), (503, "Éa éA x1! x1!")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    table = make(spark, docs)
    vectors, net = q.fit(table, marks)
    weights = vectors.astype(np.float64)
    for r in collect(q.score_quality(table, marks)):
        text = dict(docs)[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        x = np.zeros(3 * q.DIM)
        triples = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        for k, w in enumerate(words):
            alone = q.terms(Texts(pa.array([w])))
            again = 2 * any(triples[tuple(words[j : j + 3])] > 1 for j in range(max(0, k - 2), min(k, len(words) - 3) + 1)) + (k > 0 and words[k - 1] == w)
            for part, row in enumerate((alone.bucket[0], q.WORDS + alone.shape[0], q.WORDS + q.SHAPES + again)):
                x[part * q.DIM : (part + 1) * q.DIM] += weights[row] / len(words)
        hidden = [np.tanh(sum((x[a] - net.centre[a]) / net.scale[a] * net.w1[a, b] for a in range(len(x))) + net.b1[b]) for b in range(q.HIDDEN)]
        want = 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature))
        assert np.isclose(r["score"], want, atol=1e-6)
    flipped = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    again = q.fit(table, flipped)
    assert np.array_equal(vectors, again[0]) and np.array_equal(net.w1, again[1].w1)  # held-out labels are never read
    x, y = np.random.default_rng(1).standard_normal((300, 3 * q.DIM)), np.r_[np.ones(150), np.zeros(150)]
    net = q.train(x, y)
    apart = np.random.Generator(np.random.PCG64(5))
    apart.normal(0, 1, (3 * q.DIM, q.HIDDEN))
    rows = apart.permutation(300)[:60]
    loss = lambda t: np.logaddexp(0, np.where(y[rows] > 0, -1, 1) * net.logits(x[rows]) / t).mean()
    assert loss(net.temperature) <= min(map(loss, np.exp(np.linspace(np.log(0.25), np.log(8), 81)))) + 1e-12


def test_context_sums():
    from tideloom.llm import quality as q
    from tideloom.llm.textarrays import Texts

    some = q.terms(Texts(pa.array(["a b b c A1 x! a b b", None, "", "zz", "q r"])))
    index = q.index_vectors()
    total, want = np.zeros((q.TERMS, q.DIM), np.int64), np.zeros((q.TERMS, q.DIM), np.int64)
    q.add_contexts(total, some, np.ascontiguousarray(index.T))
    rows = [(some.bucket[w], q.WORDS + some.shape[w], q.WORDS + q.SHAPES + r) for w, r in zip(some.word, some.repeat)]
    for i in range(len(rows)):
        for j in range(max(0, i - q.WINDOW), min(len(rows), i + q.WINDOW + 1)):
            if i != j and some.doc[i] == some.doc[j]:
                for x in rows[i]:
                    want[x] += index[list(rows[j])].sum(0)
    assert np.array_equal(total, want)


def test_urls_against_plain_python(spark):
    """Random links and redirects: verdicts by union-find over the same nodes."""
    from tideloom.llm.urls import judge_urls

    rng = random.Random(7)
    hosts = ["a.example.net", "b.example.com", "c.example.org", "example.net", "shop.io", "news.io"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'x'])}/{i}" for i in range(60)]
    pages = [(i, u, f'<link rel="canonical" href="{rng.choice(urls)}">' if rng.random() < 0.5 else None) for i, u in enumerate(urls)] + [(99, None, None), (3, urls[3], "")]
    moves = [(rng.choice(urls), rng.choice(urls)) for _ in range(12)] + [(None, urls[0]), (urls[1], None)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in [(u, h.split('"')[3]) for _, u, h in pages if h] + [m for m in moves if None not in m]:
        up[find(a)] = find(b)

    def own(url):
        host, _, path = (url or "").partition("://")[2].partition("/")
        for r_host, r_path, verdict in (("example.net", "en/", "allow"), ("example.com", "de/", "block"), ("org", "fr/", "allow"), ("net", "", "block")):
            if url and (host == r_host or host.endswith("." + r_host)) and path.startswith(r_path):
                return verdict
        return None

    known = collections.defaultdict(set)
    for u in urls:
        known[find(u)].add(own(u))
    want = sorted((i, own(u) or ("allow" if not u or "allow" in known[find(u)] else "block" if "block" in known[find(u)] else "allow")) for i, u, _ in pages)
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = judge_urls(table, redirects=spark.createDataFrame(moves, "from_url string, to_url string"))
    assert sorted((r.page_id, r.verdict) for r in got.collect()) == want


def test_neighbours_recall_on_the_embeddings(spark):
    """At least 0.9 of the ten nearest on a whole table, with several shards and repeated vec_ids."""
    from tideloom.llm.neighbours import nearest

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    out = collections.defaultdict(list)
    for r in nearest(rows, rows.filter("vec_id % 100 = 0"), 10).collect():
        out[r.query_id].append(r.vec_id)
    ids, x = zip(*[(r.vec_id, r.embedding) for r in rows.collect()])
    ids, x = np.array(ids), np.array(x, float)
    hit = [len(set(found) & set(ids[[j for j in np.lexsort((ids, ((x - x[ids == q][0]) ** 2).sum(1))) if ids[j] != q][:10]].tolist())) for q, found in out.items()]
    assert len(out) == (ids % 100 == 0).sum() and np.mean(hit) / 10 >= 0.9
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.2]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 9)) for r in nearest(twice, twice.filter("vec_id = 0"), 10).orderBy("rank").collect()]
    assert got == [(1, 0.1), (2, round(2**0.5, 9))]


def test_pipeline_stages_on_awkward_documents(spark, sf):
    """Null and empty texts, repeated ids, columns with the names of results, an empty table: each stage does what its operator says."""
    import corpus_pipeline

    from tideloom.llm.common import table
    from tideloom.llm.fertility import fertility_rules
    from tideloom.llm.quality import score_quality
    from tideloom.llm.repeats import remove_repeats

    rng = random.Random(2)
    base = prose(rng, 120)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(60, 200))) for i in range(12)] + [(20, base), (21, base), (21, base + " more"), (22, None), (23, ""), (None, base), (24, prose(rng, 30) + " " + shared), (25, shared + " " + prose(rng, 70))]
    docs = make(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    bag = lambda df: collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    labels = table(spark, sf, "labels")
    score = {r["doc_id"]: r["predicted"] for r in collect(score_quality(docs, labels)) if r["doc_id"] != 21}
    kept = bag(stages["quality classifier"](spark, docs, sf))
    assert {i for i, _ in kept if i != 21} == {i for i, p in score.items() if p} and not set(kept) - set(bag(docs))
    rules = {r["doc_id"]: r["kept"] for r in collect(fertility_rules(docs, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken")))}
    assert {i for i, _ in bag(stages["quality rules"](spark, docs, sf))} == {i for i, k in rules.items() if k}
    classes = brute_classes(rows)
    assert bag(stages["near dedup"](spark, docs, sf)) == collections.Counter((i, t) for i, t in rows if i is None or classes[i] == i)
    cut = {(r["doc_id"], r["kept_text"]) for r in collect(remove_repeats(docs))}
    out = stages["substring dedup"](spark, docs, sf)
    assert set(bag(out)) == cut and out.columns == docs.columns
    packed = collect(stages["packing"](spark, docs, sf))
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_fertility_bands_judge(spark):
    """Each band rejects what it is for, and prose of each language passes; bands of the script stand in where the language has none."""
    import base64

    from tideloom.llm.fertility import fertility_rules

    rng = random.Random(3)
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(120))
    signs = " ".join("".join(chr(rng.randint(0x10400, 0x1044F)) for _ in range(6)) for _ in range(120))
    greek = " ".join(rng.choice("η θάλασσα και ο ουρανός είναι πάντα γαλάζιος στα νησιά μας το καλοκαίρι όταν φυσά άνεμος πέτρα σπίτι δρόμος βουνό".split()) + rng.choice(["", "", "ς", "ν"]) for _ in range(90))
    rows = [(1, prose(rng, 120), "en"), (2, noise, "en"), (3, noise, None), (4, signs, "de"), (5, "rain " * 200, "en"), (6, greek, "el"), (7, noise, "xx"), (8, prose(rng, 49), "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in fertility_rules(table, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken")).collect()}
    assert {i for i, r in out.items() if r.kept} == {1, 6}
    assert all("piece_chars" in out[i].failed_bands for i in (2, 3, 7)) and "byte_share" in out[4].failed_bands and "evenness" in out[5].failed_bands
    assert out[8].base_failed and not out[8].failed_bands and out[6].script == "greek"
    wide = {"latin": {}, "other": {}, "greek": {"piece_chars": (5.0, 6.0)}}
    out = {r.doc_id: r.failed_bands for r in fertility_rules(table, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"), wide).collect()}
    assert out == {i: ["piece_chars"] if i == 6 else [] for i in out}
