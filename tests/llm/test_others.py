"""Neighbours, URLs, components and the pipeline on small fixtures."""

import random

import numpy as np

from tideloom.llm.components import components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3), (7, None), (1000, 1001)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, score string, rank string")


def test_neighbours(spark):
    from tideloom.llm.neighbours import nearest

    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 12)).astype(np.float32))]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [rows[9]]
    rows += [(2000, None), (2100, [0.0] * 12), (2200, [float("nan")] * 12), (2300, [1.0, None] * 6), (2400, []), (None, rows[1][1]), (2500, [float("inf")] * 12)]
    table = vectors(spark, rows)
    out = {}
    for r in nearest(table, table.filter("vec_id % 100 = 0"), 10).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(v, float) for i, v in rows if i is not None and i < 2000}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    hit = total = 0
    assert set(out) == {i for i in good if i % 100 == 0}
    for q, found in out.items():
        d = np.sqrt(((x - good[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(np.isclose(s, np.sqrt(((good[v] - good[q]) ** 2).sum()), rtol=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(ids[best]))
        total += 10
    assert hit / total >= 0.9
    few = vectors(spark, rows[:4])
    assert nearest(few, few.filter("vec_id = 0"), 10).count() == 3
    assert nearest(few.limit(0), few.limit(0), 10).count() == 0


def test_urls(spark):
    from tideloom.llm.urls import judge_urls

    rows = [
        (1, "http://a.example.com/x", '<link href="https://spam.net/x?a=1&amp;b=2#q" rel="canonical">'),
        (2, "http://b.example.org/y", "<META http-equiv=refresh content='0; url=/fr/z'>"),
        (3, "https://b.example.org/fr/z/#f", None),
        (4, None, None), (5, "nourl", ""), (6, "http://spam.net", ""), (6, "http://spam.net", ""),
        (7, "http://b.example.org/y?utm_source=k", ""),
        (8, "HTTP://X.Example.NET/en/1", "<link rel='canonical' href='http://c.example.com/q'>"),
        (9, "http://c.example.com/q", '<link rel="canonical" href="//bad.net/p">'),
        (10, "http://d.example.com/de/1", ""), (11, "http://notnet/", ""), (12, "http://EXAMPLE.NET/fr/", ""),
    ]
    pages = spark.createDataFrame([(i, u, h, "r") for i, u, h in rows], "page_id long, url string, html string, rule string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages).collect()}
    assert judge_urls(pages).count() == len(rows)
    assert out[1] == ("a.example.com", "/x", None, "block")  # its canonical page is blocked
    assert out[2] == ("b.example.org", "/y", None, "allow") and out[3][2:] == ("org/fr/", "allow") and out[7][3] == "allow"
    assert out[4] == ("", "", None, "allow") == out[5]
    assert out[6] == ("spam.net", "", None, "allow")  # no path, so the rule does not fit
    assert out[8] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert out[9][2:] == (None, "allow")  # one alias is allowed, another blocked: the allowance wins
    assert out[10][2:] == ("example.com/de/", "block") and out[11][2] is None and out[12][2:] == ("net/", "block")
    assert judge_urls(pages.limit(0)).count() == 0
    moved = spark.createDataFrame([("http://a.example.com/x", "http://ok.example.org/fr/1")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, redirects=moved).collect()}[1] == "allow"


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from tideloom.llm.common import stored

        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stored(stage(spark, kept, sf))
        assert kept.columns == columns
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= before
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
