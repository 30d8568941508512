"""Generators, lifecycle and metadata operators."""

import numpy as np
import pytest

from tideloom.generators import kit, registry, tables
from tideloom.operators import corpus
from tideloom.plans import lifecycle


def test_quotas():
    known = registry.load()
    from tideloom.generators.flows import BLOCKED

    assert len(known) + len(BLOCKED) == 176
    assert sum(g.quota["full"] for g in known.values()) == 1000 - 148
    assert sum(g.quota["stationary1000"] for g in known.values()) == 1000 - 171


def test_registered_corpus_is_whole(spark, sf):
    from tideloom.plans.catalogue import QUERIES

    made = QUERIES["generated_corpus"](spark, sf).collect()
    slots = [(g.cls, g.key, i) for g in registry.load().values() for i in range(g.quota["full"])]
    assert sorted(r.id for r in made) == sorted(f"TL_{c}_{k}_{i:03d}" for c, k, i in slots)
    assert all(r.error is None for r in made)
    chosen = tables.selection(spark, "full").filter("family = 'ou' AND index IN (0, 7)")
    assert {r.id: r.sha256 for r in tables.generate(chosen, 1000).select("id", "sha256").collect()}.items() <= {r.id: r.sha256 for r in made}.items()


@pytest.mark.parametrize("cls", list(registry.CLASSES))
def test_every_generator_runs(cls):
    for name, g in registry.load().items():
        if g.cls == cls:
            made = registry.generate(name, 1, 240)
            assert made["x"].shape == (240,) and np.isfinite(made["x"]).all() and made["x"].std() > 0


def test_names_decide(spark):
    chosen = tables.selection(spark, "full", ["B", "E", "J"], ["ar2", "garch", "renewal"])
    one = {r.id: r.sha256 for r in tables.generate(chosen, 150).select("id", "sha256").collect()}
    two = {r.id: r.sha256 for r in tables.generate(chosen.coalesce(1), 150).select("id", "sha256").collect()}
    assert one == two and len(one) == 34 and None not in one.values()


def test_strata_use_every_stratum_once():
    drawn = sorted(kit.Strata("X.y", i, 12).draw("p", 0, 12) for i in range(12))
    assert [int(d) for d in drawn] == list(range(12))


def test_vectors_are_kept():
    assert registry.generate("K.pinup", 3, 200)["vectors"]["tvp"].shape == (200,)


def test_registration_checks():
    with pytest.raises(ValueError):
        registry.register("Z", "x", 1, 1)(lambda *a: None)
    with pytest.raises(ValueError):
        registry.register("A", "x", 1, 1, colour="yes")(lambda *a: None)
    with pytest.raises(KeyError):
        registry.register("A", "gaussian", 1, 1)(lambda *a: None)


def test_lifecycle(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    first = lifecycle.build(spark, a, classes=["B", "M"], families=["ar1", "clipped"], length=120)
    assert first.count() == 14
    assert lifecycle.verify(spark, a, 0.3, length=120).count() == 0
    flags = spark.createDataFrame([("TL_B_ar1_001", "retry"), ("TL_B_ar1_002", "drop")], "id string, action string")
    second = lifecycle.build(spark, b, classes=["B", "M"], families=["ar1", "clipped"], length=120, refresh=a, flags=flags)
    old, new = ({r.id: r.sha256 for r in d.select("id", "sha256").collect()} for d in (first, second))
    assert set(old) - set(new) == {"TL_B_ar1_002"}
    assert [k for k in new if new[k] != old[k]] == ["TL_B_ar1_001"]
    assert lifecycle.subset(spark, a, c, {"cls": ["B"]}).count() == 10
    lifecycle.export_csv(first, str(tmp_path / "csv"))


def test_subset(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y")], "id string, k int, s string")
    both = {r.id for r in corpus.subset(df, {"k": ["1"], "s": ["x"]}).collect()}
    assert both == {r.id for r in corpus.subset(df, {"k": ["1"]}).intersect(corpus.subset(df, {"s": ["x"]})).collect()} == {"a"}
    with pytest.raises(KeyError):
        corpus.subset(df, {"nothing": ["1"]})


def test_array_files(spark, tmp_path):
    from tideloom.sources import files

    np.savez(tmp_path / "s.npz", X=np.arange(6.0).reshape(2, 3), ids=np.array(["a", "b"]))
    back = files.read_npz(spark, str(tmp_path))
    assert {r.id: r.x for r in back.collect()} == {"a": [0, 1, 2], "b": [3, 4, 5]}
    assert sum(1 for r in files.npz_bytes(back).collect() if r.content) >= 1


def test_stream(spark, sf, tmp_path):
    from tideloom.streaming.monitor import windowed_stats

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = windowed_stats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("monitor").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    table = windowed_stats(spark.read.parquet(str(tmp_path / "in")))
    assert spark.table("monitor").count() == table.count()


def test_audit_length_finds_slow_series(spark):
    slow = np.sin(2 * np.pi * np.arange(1000) / 1000)
    rows = [("slow", t, float(v)) for t, v in enumerate(slow)] + [("flat", t, 1.0) for t in range(1000)] + [("fast", t, float(t * 7919 % 1000)) for t in range(1000)]
    series = spark.createDataFrame(rows, "id string, t long, v double")
    meta = spark.createDataFrame([(i, i) for i in ("slow", "flat", "fast")], "id string, family string")
    out = {r.family: r for r in corpus.audit_length(series, meta).collect()}
    z = slow - slow.mean()
    tau = next(k for k in range(1, 500) if z[:-k] @ z[k:] / (z @ z) < np.exp(-1))
    assert tau > 50 and out["slow"].tau_max == tau and out["slow"].spans_min == 1000 / tau < 20
    assert out["flat"].tau_max == np.inf and out["flat"].spans_min == 0
    assert out["fast"].spans_min > 20


def test_screen_has_all_issues(spark):
    rng = np.random.default_rng(2)
    t = np.arange(1000)
    noise = rng.standard_normal(1000)
    jump = 0.05 * noise
    jump[500] += 40
    x = {
        "noise": noise, "sine": np.sin(2 * np.pi * t / 20), "slow": np.sin(2 * np.pi * t / 50) + 0.5 * noise, "repeats": np.sin(2 * np.pi * t / 25) + 0.8 * np.sin(2 * np.pi * t / 12.5) + 0.01 * noise,
        "jump": jump, "hundred": np.floor(100 * rng.random(1000)), "events": np.where(np.isin(t % 100, [50]), 30.0, 0.0) + 0.1 * rng.random(1000), "head": np.where(t < 30, 0.0, noise), "same": noise + 0.001 * rng.standard_normal(1000),
    }
    series = spark.createDataFrame([(i, int(k), float(v)) for i, s in x.items() for k, v in enumerate(s)], "id string, t long, v double")
    flag = lambda c: "yes" if c else "no"
    meta = spark.createDataFrame([(i, "A", "one" if i in ("noise", "same", "sine", "jump") else i, flag(i == "events"), "no", flag(i == "jump")) for i in x], "id string, cls string, family string, event_like string, bursty string, continuous_time string")
    f = {"noise": [0.0, 0.0], "same": [0.001, 0.0], "sine": [1.0, 1.0], "jump": [2.0, -1.0]}
    profiles = spark.createDataFrame([(i, f.get(i, [3.0, 3.0])) for i in x], "id string, f array<double>")
    out = {r.id: {k for k, v in r.asDict().items() if v is True} for r in corpus.screen(series, meta, profiles).collect()}
    assert out["noise"] == {"duplicate"} == out["same"]
    assert out["sine"] >= {"periodic", "sinusoid"} and "sinusoid" not in out["repeats"] and "periodic" in out["repeats"]
    assert "slow" in out["slow"] and "jumps" in out["jump"] and "onset" in out["head"]
    assert "levels" in out["hundred"] and "few_events" in out["events"]
    assert all("duplicate" not in v for k, v in out.items() if k not in ("noise", "same"))
    one = corpus.screen(series, meta, levels=50, few_events=5).filter("id IN ('hundred', 'events', 'noise')").collect()
    assert not any(r.duplicate or (r.id == "hundred" and r.levels) or r.few_events for r in one)


def test_screen_full_query(spark, sf):
    from tideloom.plans.catalogue import QUERIES

    full, short = QUERIES["screen_full"](spark, sf), QUERIES["screen"](spark, sf)
    assert len(full.columns) == 2 + 12 + 1 and full.count() == short.count()
    worse = full.alias("f").join(short.alias("s"), "id").filter("f.n_issues < s.n_issues").count()
    assert worse == 0
    assert QUERIES["screen_full_summary"](spark, sf).agg({"series": "sum"}).collect()[0][0] == short.count()


def test_profile_gate_and_reversibility():
    from tideloom.generators.reversible import time_reversible

    tags = registry.DEFAULTS | {"deterministic": "yes"}
    rng = np.random.default_rng(1)
    flat, walk = rng.standard_normal(1000), np.cumsum(rng.standard_normal(1000))
    grown = flat * np.repeat([1, 1, 1, 1, 2.2], 200)
    assert registry.profile_gate(flat, tags, "B") is None
    assert registry.profile_gate(walk, tags, "B") == "mean drifts" and registry.profile_gate(walk, tags | {"stationary": "no"}, "B") is None
    assert registry.profile_gate(grown, tags, "B") is None and registry.profile_gate(grown, tags, "G") == "variance drifts"
    assert registry.profile_gate(grown, tags | {"bursty": "yes"}, "G") is None
    assert registry.profile_gate(flat.round(), tags, "B") == registry.profile_gate(flat, tags | {"discrete_valued": "yes"}, "B") == "not real-valued"
    assert registry.profile_gate(flat, tags | {"periodic": "yes"}, "F") == "periodic orbit"
    assert [time_reversible(n, {"time_reversible": "own"}, p) for n, p in (("I.double-well", {}), ("E.garch", {}), ("N.rr-af", {}), ("L.mixture", {"kind": 3}), ("L.mixture", {"kind": 0}), ("H.harmonic", {"kind": "square"}), ("A.gaussian", {}), ("M.downsampled", {"base": "E.garch/3"}))] == ["yes", "no", "na", "yes", "no", "own", "own", "no"]
    assert registry.generate("C.shot-noise", 0, 400, "stationary1000")["tags"]["time_reversible"] == "no"


def test_profiles_differ_where_they_should():
    full, settled = (registry.generate("A.student-t", 0, 300, p)["numerics"]["tail_index"] for p in registry.PROFILES)
    assert full < 2 < settled
    for name, index in (("F.circle-map", 0), ("J.hawkes", 3), ("M.nonlinear-readout", 3), ("J.renewal", 0)):
        assert registry.generate(name, index, 1000, "stationary1000")["tags"]["discrete_valued"] == "no"
    assert registry.generate("M.nonlinear-readout", 3, 1000)["tags"]["discrete_valued"] == "yes"
    assert registry.generate("N.barnes-sunspot", 0, 500)["params"].get("x") is None


def test_build_of_the_stationary_profile(spark, tmp_path):
    made = lifecycle.build(spark, str(tmp_path / "s"), profile="stationary1000", classes=["F", "J"], families=["circle-map", "cox-smoothed"])
    rows = made.select("id", "keywords", "error").collect()
    assert len(rows) == 15 and all(r.error is None for r in rows)
    assert all(r.keywords.startswith(f"class-{r.id.split('_')[1]},{r.id.split('_')[2]},abstract") for r in rows)


def test_export_of_everything(spark, tmp_path):
    from tideloom.sources import files

    made = tables.generate(tables.selection(spark, "1000x1000", ["A"], ["gaussian", "uniform"]), 150, "1000x1000")
    lifecycle.export_all(made, str(tmp_path / "out"))
    back = {r.id: r.x for r in files.read_npz(spark, str(tmp_path / "out/npz")).collect()}
    assert back == {r.id: r.x for r in made.collect()} and len(back) == 7
    assert spark.read.option("header", True).csv(str(tmp_path / "out/metadata")).count() == 7
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards/a.yaml").write_text("lorenz:\n  title: Lorenz\n  p: [1, 2]\nrossler:\n")
    assert {r["key"]: r["fields"] for r in files.read_cards(spark, str(tmp_path / "cards")).collect()} == {"lorenz": {"title": "Lorenz", "p": "[1, 2]"}, "rossler": {}}
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert files.append_json(one, str(tmp_path / "log")).count() == 2
    assert sorted(tuple(r) for r in files.append_json(spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int"), str(tmp_path / "log")).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(KeyError):
        tables.selection(spark, "none")


def _brute(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def test_duplicate_pairs_by_tiles(spark, monkeypatch):
    """Groups of several tiles, of many copies, of two vectors; no row a pair is joined."""
    from tideloom.operators import similarity

    monkeypatch.setattr(similarity, "GROUP_TILE", 50, raising=False)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((170, 6)), np.repeat(rng.standard_normal((1, 6)), 60, 0), rng.standard_normal((60, 6)), rng.standard_normal((2, 6))])
    x[3], x[230:250] = x[90] + 1e-3, x[0]
    grp = np.repeat([1, 2, 3, 4], [170, 60, 60, 2])
    features = spark.createDataFrame([(i, int(g), f) for i, (g, f) in enumerate(zip(grp, x.tolist()))] + [(900, None, x[0].tolist())], "id long, grp long, f array<double>")
    for share in (0.15, 0.85):
        out = similarity.duplicate_pairs(features, share)
        assert "(a#" not in out._jdf.queryExecution().optimizedPlan().toString()  # no join compares ids
        ours = {(r.a, r.b): r.d for r in out.collect()}
        every = np.vstack([x, x[:1]])
        q = np.quantile(every, [0.25, 0.5, 0.75], axis=0)
        z = np.clip((x - q[1]) / (q[2] - q[0]), -10, 10)
        want = {}
        for g in (1, 2, 3):
            at = np.flatnonzero(grp == g)
            d = _brute(z[at])
            u, v = np.triu_indices(len(at), 1)
            want |= {(at[a], at[b]): d[a, b] for a, b in zip(u, v) if d[a, b] < share * np.median(d[u, v])}
        assert ours.keys() == want.keys() and all(abs(ours[k] - want[k]) < 1e-9 for k in want)


def test_nearest_by_tiles(spark, monkeypatch):
    """Several tiles on both sides; many copies of a vector, ties to the smaller id, a large offset, a vector without values, no group."""
    from tideloom.operators import similarity

    monkeypatch.setattr(similarity, "TILE", 70, raising=False)
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (300, 5)).astype(float) + 1e5
    x[100:180] = x[100]
    x[7] = np.nan
    x[8] *= 1e6
    grp = [None if i == 20 else int(g) for i, g in enumerate(rng.integers(0, 4, 300))]
    features = spark.createDataFrame([(i, g, f) for i, (g, f) in enumerate(zip(grp, x.tolist()))], "id long, grp long, f array<double>")
    d = _brute(x)
    for k, other in ((3, False), (16, True)):
        out = similarity.nearest(features, features, k, other)
        ours = {(r.id, r.rank): (r.other, r.d) for r in out.collect()}
        want = {}
        for i in range(300):
            near = [(e, j) for j, e in enumerate(d[i]) if j != i and np.isfinite(e) and not (other and (None in (grp[i], grp[j]) or grp[i] == grp[j]))]
            want |= {(i, rank): (j, e) for rank, (e, j) in enumerate(sorted(near)[:k], 1)}
        assert ours.keys() == want.keys() and all(ours[p][0] == want[p][0] and abs(ours[p][1] - want[p][1]) < 1e-6 * max(1, want[p][1]) for p in want)
        assert "row_number" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["screen_full_summary", "screen_full"])
def test_screen_makes_no_row_a_pair(spark, sf, name):
    import re

    from tideloom.plans.catalogue import QUERIES

    assert not re.search(r"\(a#\d+L? < b#", QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("name", ["lookalikes16", "median_nn", "knn8", "coverage_gaps"])
def test_neighbours_rank_no_rows(spark, sf, name):
    from tideloom.plans.catalogue import QUERIES

    assert "row_number" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()  # ranked in numpy
