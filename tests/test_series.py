"""Edge series and numpy references for the operators on series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideloom.operators import series as S


def long(spark, **series):
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, t long, v double")


def got(df):
    return {r[0]: r for r in df.collect()}


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(3)
    return {"noise": rng.standard_normal(103), "wave": np.sin(2 * np.pi * np.arange(96) / 12), "flat": np.full(50, 2.0), "steps": np.repeat([0.0, 1, 0, 1], 15)}


def test_window_stationarity(spark, some):
    out = got(S.window_stationarity(long(spark, **some)))
    for k, x in some.items():
        w = x[: len(x) // 5 * 5].reshape(5, -1)
        s = x.std() or 1.0
        want = (w.mean(1).std() / s, w.std(1).std() / s, w.std(1).max() ** 2 / max(w.std(1).min() ** 2, 1e-12))
        assert np.allclose([out[k].sm, out[k].ss, out[k].vr], want, rtol=1e-9, atol=1e-9)


def test_ratios_do_not_depend_on_scale(spark, some):
    a = got(S.window_stationarity(long(spark, **some)))
    b = got(S.window_stationarity(long(spark, **{k: 3 * x + 7 for k, x in some.items()})))
    for k in ("noise", "wave"):
        assert np.allclose([a[k].sm, a[k].ss, a[k].vr], [b[k].sm, b[k].ss, b[k].vr], rtol=1e-6)


def test_spectrum(spark, some):
    out = got(S.dominant_period(long(spark, **some)))
    assert out["wave"].period == 12
    total = {r["id"]: r["p"] for r in S.dft(long(spark, **some)).groupBy("id").agg(F.sum(F.when(F.col("k") * 2 == F.col("n"), F.col("power") / 2).otherwise(F.col("power"))).alias("p")).collect()}
    for k in ("noise", "wave"):  # Parseval
        x = some[k]
        assert np.isclose(2 * total[k] / len(x), ((x - x.mean()) ** 2).sum())


def test_validity(spark):
    series = long(spark, constant=[1] * 20, bad=[1, float("nan"), 2], big=[1, 2e12, 3], nine=[*range(9), 0], ten=range(10), one=[5, 5], two=[5, 6])
    meta = spark.createDataFrame([(k, "yes" if k in ("one", "two") else "no") for k in ("constant", "bad", "big", "nine", "ten", "one", "two")], "id string, discrete string")
    reasons = {r.id: r.reason for r in S.validity_gate(series, meta).collect()}
    assert reasons == {"constant": "constant", "bad": "non-finite", "big": "overflow", "nine": "few values", "ten": None, "one": "constant", "two": None}


def test_acf_and_time(spark, some):
    out = {(r.id, r.k): r.r for r in S.acf(long(spark, **some), 5).collect()}
    x = some["noise"] - some["noise"].mean()
    assert np.isclose(out["noise", 3], (x[:-3] @ x[3:]) / (x @ x))
    assert out["flat", 1] == 0
    assert got(S.acf_time(long(spark, **some)))["flat"].tau == 40


def test_reversal_negates(spark, some):
    a = {(r.id, r.lag): r.trev for r in S.reversibility(long(spark, noise=some["noise"]), [1]).collect()}
    b = {(r.id, r.lag): r.trev for r in S.reversibility(long(spark, noise=some["noise"][::-1]), [1]).collect()}
    assert np.isclose(a["noise", 1], -b["noise", 1])


def test_fills(spark):
    series = long(spark, a=[1, 2, 9, 9, 5, 9])
    missing = F.col("v") == 9
    assert [r.v for r in S.zoh_fill(series, missing).orderBy("t").collect()] == [1, 2, 2, 2, 5, 5]
    assert [r.v for r in S.linear_fill(series, missing).orderBy("t").collect()] == [1, 2, 3, 4, 5, 5]


def test_ties_share_a_rank(spark):
    series, target = long(spark, a=[1, 1, 2, 3]), long(spark, t=[10, 20, 30, 40])
    assert [r.v for r in S.rank_remap(series, target).orderBy("t").collect()] == [15, 15, 30, 40]


def test_burstiness_needs_three_gaps(spark):
    events = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("b", 0.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "id string, at double")
    out = got(S.burstiness(events))
    assert out["a"].b is None and out["b"].b == -1


def test_longest_flat(spark):
    assert got(S.longest_flat(long(spark, a=[0, 1, 1, 1, 2, 2, 5]), 1e-6))["a"].run == 2


def test_every_event_is_counted(spark, sf):
    from tideloom.plans.catalogue import QUERIES

    binned = QUERIES["bin_events_all"](spark, sf)
    counts = {r.user_id: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect()}
    assert {r.id: r.n for r in binned.groupBy("id").agg(F.sum("n").alias("n")).collect()} == counts
    assert {r["count"] for r in binned.groupBy("id").count().collect()} == {30}
    late = S.bin_events(spark.createDataFrame([(1, 0.5), (2, 99.5), (2, 30.0)], "id long, at double"), 10.0)
    assert sorted((r.id, r.bin) for r in late.filter("n = 1").collect()) == [(1, 0), (2, 3), (2, 9)] and late.count() == 20
    assert QUERIES["kernel_rate_all"](spark, sf).filter("bin = 29 AND rate > 0").count() > 0


#: Their squared distances have ties at the quantile, equal but for the last bit.
TIED = [
    [161.48, 25.31, 23.86, 18.87, 1.29, 32.2, 1.57, 5.27, 6.81, 4.05, 59.02, 162.9, 29.91, 93.5, 19.13, 1.16, 263.81, 3.38, 62.55, 60.2, 22.0, 107.37, 36.8, 17.43, 115.47, 53.67, 6.97, 1.9, 13.13, 9.93, 86.27, 49.27, 45.93, 2.9, 5.77, 5.95, 30.39, 7.48, 150.18, 108.16, 36.6, 27.83, 33.66, 2.41, 61.11, 170.94, 28.91, 8.52, 44.0, 50.58, 16.47, 46.51, 6.1, 30.78, 88.81, 6.19, 76.4, 83.13, 94.14],
    [96.11, 1.55, 56.8, 29.82, 67.81, 2.76, 14.34, 19.49, 14.58, 2.77, 38.79, 13.66, 17.96, 118.48, 23.43, 37.1, 59.21, 149.71, 99.08, 43.4, 86.93, 18.67, 13.66, 34.45, 9.99, 71.83, 20.12, 33.21, 5.82, 7.75, 129.59, 143.97, 81.59, 1.79, 49.4, 81.78, 86.75, 5.69, 49.0, 47.72, 1.39, 31.44, 28.14, 37.89, 31.83, 24.11, 20.39, 21.55, 34.32, 64.45, 0.66, 63.73, 101.34, 1.83, 8.0, 55.44, 37.58, 65.4, 37.2, 188.87, 38.47, 81.34, 30.66, 57.39, 19.59],
]


def test_recurrence_ties_as_in_sql(spark):
    import duckdb

    from tideloom.plans.catalogue import ORACLE_SQL

    events = [(i, t, v) for i, x in enumerate(TIED) for t, v in enumerate(x)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS user_id, t AS ts, t AS event_id, v AS value FROM (VALUES " + ", ".join(f"({i}, {t}, {v}::DOUBLE)" for i, t, v in events) + ") AS e(i, t, v)")
    series = spark.createDataFrame(events, "id int, t long, v double")
    assert {tuple(r) for r in S.recurrence_blocks(series, 8).collect()} == set(con.execute(ORACLE_SQL["recurrence_blocks"]).fetchall())
    ours = {r.id: (round(r.eps, 6), round(r.rate, 6)) for r in S.recurrence(series).collect()}
    assert ours == {r[0]: r[1:] for r in con.execute(ORACLE_SQL["recurrence_rate"]).fetchall()}
