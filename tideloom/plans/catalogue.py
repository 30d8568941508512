"""Registered queries of the engine and the same results in DuckDB's SQL.

Doubles are rounded to six places on both sides, finer than any tie of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions import columns as C
from tideloom.operators import corpus, similarity
from tideloom.operators import series as S
from tideloom.sources.bridge import features, read, series_day, series_meta, series_user

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


SER = "s AS (SELECT user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value AS v FROM events)"
DAY = "d0 AS (SELECT l_returnflag AS id, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY day) - 1 AS BIGINT) AS t, v FROM d0)"
META = """meta AS (SELECT DISTINCT user_id AS id, ['F','G','H','L','A','B','C','D'][CAST(user_id % 8 + 1 AS INT)] AS cls, 'fam' || CAST(user_id % 20 AS VARCHAR) AS family,
 CASE WHEN user_id % 5 = 0 THEN 'yes' ELSE 'no' END AS event_like, CASE WHEN user_id % 7 = 0 THEN 'yes' ELSE 'no' END AS bursty,
 CASE user_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'partly' ELSE 'no' END AS deterministic, CASE WHEN user_id % 11 = 0 THEN 'yes' ELSE 'no' END AS discrete,
 CASE WHEN user_id % 4 = 0 THEN 'yes' ELSE 'no' END AS periodic FROM events)"""


def _windows(w: int, name: str = "ws") -> str:
    return f"""{name}0 AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, stddev_pop(v) OVER (PARTITION BY id) AS sd FROM s),
 {name}1 AS (SELECT id, n, sd, floor(t / floor(n / {w}.0)) AS w, avg(v) AS m, stddev_pop(v) AS s FROM {name}0 WHERE floor(t / floor(n / {w}.0)) < {w} GROUP BY ALL),
 {name} AS (SELECT id, n, stddev_pop(m) / (CASE WHEN sd = 0 THEN 1 ELSE sd END) AS sm, stddev_pop(s) / (CASE WHEN sd = 0 THEN 1 ELSE sd END) AS ss, max(s) * max(s) / greatest(min(s) * min(s), 1e-12) AS vr FROM {name}1 GROUP BY id, n, sd)"""


ACF = "c AS (SELECT id, t, v - avg(v) OVER (PARTITION BY id) AS z FROM s), c0 AS (SELECT id, sum(z * z) AS c0 FROM c GROUP BY id), ac AS (SELECT a.id, b.t - a.t AS k, sum(a.z * b.z) AS c FROM c a JOIN c b ON a.id = b.id AND b.t > a.t AND b.t - a.t <= {k} GROUP BY 1, 2), acf AS (SELECT id, k, CASE WHEN c0 > 0 THEN c / c0 ELSE 0 END AS r FROM ac JOIN c0 USING (id))"
TAU = ACF.format(k=39) + ", tau AS (SELECT x.id, CAST(CASE WHEN x.lo = x.hi THEN 40 ELSE coalesce(y.k, 40) END AS BIGINT) AS tau FROM (SELECT id, min(v) AS lo, max(v) AS hi FROM s GROUP BY id) x LEFT JOIN (SELECT id, min(k) AS k FROM acf WHERE r < exp(-1) GROUP BY id) y USING (id))"
DFT = f"""c AS (SELECT id, t, v - avg(v) OVER (PARTITION BY id) AS z, count(*) OVER (PARTITION BY id) AS n FROM s), w AS (SELECT id, n, t, z, unnest(range(1, CAST(floor(n / 2) AS BIGINT) + 1)) AS k FROM c WHERE n >= 2),
 p AS (SELECT id, n, k, pow(sum(z * cos({2 * math.pi!r} * k * t / n)), 2) + pow(sum(z * sin({2 * math.pi!r} * k * t / n)), 2) AS power FROM w GROUP BY ALL)"""


def _excursions(c: float, name: str = "ex") -> str:
    return f"""{name}a AS (SELECT id, quantile_cont(v, 0.5) AS med, stddev_pop(v) AS sd FROM s GROUP BY id), {name}b AS (SELECT s.id, t, abs(v - med) AS d, sd FROM s JOIN {name}a USING (id)),
 {name}c AS (SELECT id, quantile_cont(d, 0.5) AS mad FROM {name}b GROUP BY id), {name}d AS (SELECT id, t, d, CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END AS sc FROM {name}b JOIN {name}c USING (id)),
 {name}e AS (SELECT id, t, d / sc AS deviation, d > {c} * sc AS far FROM {name}d), {name}f AS (SELECT id, far AND NOT lag(far) OVER (PARTITION BY id ORDER BY t) AS rise FROM {name}e),
 {name} AS (SELECT id, CAST(sum(CASE WHEN rise THEN 1 ELSE 0 END) AS BIGINT) AS n_events FROM {name}f GROUP BY id)"""


def _flat(tol: str) -> str:
    return f"""f0 AS (SELECT id, t, abs(v - lag(v) OVER (PARTITION BY id ORDER BY t)) < {tol} * (CASE WHEN stddev_pop(v) OVER (PARTITION BY id) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY id) END) AS flat FROM s),
 f1 AS (SELECT id, coalesce(flat, false) AS flat, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY t) AS g FROM f0), f2 AS (SELECT id, g, sum(CASE WHEN flat THEN 1 ELSE 0 END) AS run FROM f1 GROUP BY 1, 2), fl AS (SELECT id, CAST(max(run) AS BIGINT) AS run FROM f2 GROUP BY id)"""


# ---- gates ------------------------------------------------------------------------------------------------


@query("window_stationarity", f"WITH {SER}, {_windows(5)} SELECT id, n, {r('sm', 'sm')}, {r('ss', 'ss')}, {r('vr', 'vr')} FROM ws")
def _(spark, d):
    return S.window_stationarity(series_user(spark, d))


@query("stationarity_gate", f"""WITH {SER}, {META}, {_windows(5)} SELECT id, CASE WHEN sm > 0.5 THEN 'mean' WHEN event_like <> 'yes' AND bursty <> 'yes' AND (ss > tight_s OR vr > tight_v) THEN 'variance' ELSE 'ok' END AS verdict
 FROM (SELECT *, CASE WHEN cls IN ('F','G','H','L') AND deterministic IN ('yes','partly') THEN 0.3 ELSE 0.5 END AS tight_s, CASE WHEN cls IN ('F','G','H','L') AND deterministic IN ('yes','partly') THEN 6.0 ELSE 20.0 END AS tight_v FROM ws JOIN meta USING (id))""")
def _(spark, d):
    return S.stationarity_gate(series_user(spark, d), series_meta(spark, d))


@query("validity_gate", f"""WITH {SER}, {META} SELECT id, k AS n_distinct, CASE WHEN bad THEN 'non-finite' WHEN top > 1e12 THEN 'overflow' WHEN lo = hi THEN 'constant' WHEN discrete <> 'yes' AND k < 10 THEN 'few values' WHEN discrete = 'yes' AND k < 2 THEN 'single-valued' END AS reason
 FROM (SELECT id, bool_or(v IS NULL OR isnan(v) OR isinf(v)) AS bad, max(abs(v)) AS top, min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS k FROM s GROUP BY id) JOIN meta USING (id)""")
def _(spark, d):
    return S.validity_gate(series_user(spark, d), series_meta(spark, d))


@query("real_valued_gate", f"WITH {SER}, {META} SELECT id, CASE WHEN discrete = 'yes' THEN 'discrete' WHEN k < 60 THEN 'few values' WHEN cls IN ('F','G') AND periodic = 'yes' THEN 'periodic' END AS reason FROM (SELECT id, count(DISTINCT v) AS k FROM s GROUP BY id) JOIN meta USING (id)")
def _(spark, d):
    return S.real_valued_gate(series_user(spark, d), series_meta(spark, d), 60)


@query("gate_composition", f"""WITH {SER}, {META}, {_windows(5)} SELECT id, coalesce(CASE WHEN discrete = 'yes' THEN 'discrete' WHEN k < 60 THEN 'few values' WHEN cls IN ('F','G') AND periodic = 'yes' THEN 'periodic' END, CASE WHEN sm > 0.5 THEN 'mean' END, 'ok') AS verdict
 FROM (SELECT id, count(DISTINCT v) AS k FROM s GROUP BY id) JOIN meta USING (id) JOIN ws USING (id)""")
def _(spark, d):
    series, meta = series_user(spark, d), series_meta(spark, d)
    both = S.real_valued_gate(series, meta, 60).join(S.window_stationarity(series), "id")
    return both.select("id", F.coalesce("reason", F.when(F.col("sm") > 0.5, "mean"), F.lit("ok")).alias("verdict"))


# ---- correlation and spectra ------------------------------------------------------------------------------


@query("acf_lags", f"WITH {SER}, {ACF.format(k=8)} SELECT id, k, {r('r', 'r')} FROM acf")
def _(spark, d):
    return S.acf(series_user(spark, d), 8)


@query("acf_time", f"WITH {SER}, {TAU} SELECT id, tau FROM tau")
def _(spark, d):
    return S.acf_time(series_user(spark, d))


@query("dominant_period", f"WITH {SER}, {DFT}, q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(power, 6) DESC, k) AS o FROM p) SELECT id, k, {r('n / k', 'period')} FROM q WHERE o = 1")
def _(spark, d):
    return S.dominant_period(series_user(spark, d))


@query("spectral_peak", f"""WITH {SER}, {DFT}, q AS (SELECT id, k, power, sum(power) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, sum(power) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY round(power, 6) DESC, k) AS o FROM p)
 SELECT id, {r('near / total', 'share')}, near / total > 0.25 AS peaked FROM q WHERE o = 1""")
def _(spark, d):
    return S.spectral_peak(series_user(spark, d))


_NORM = sum((0.5 - 0.5 * math.cos(2 * math.pi * i / 255)) ** 2 for i in range(256))


@query("welch_psd", f"""WITH {DAY}, c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s), g AS (SELECT id, t, v, n, unnest([CAST(floor(t / 128) AS BIGINT), CAST(floor(t / 128) AS BIGINT) - 1]) AS s FROM c),
 h AS (SELECT id, s, t - s * 128 AS j, (v - avg(v) OVER (PARTITION BY id, s)) * (0.5 - 0.5 * cos({2 * math.pi!r} * (t - s * 128) / 255)) AS z FROM g WHERE s >= 0 AND s * 128 + 256 <= n),
 w AS (SELECT id, s, j, z, unnest(range(1, 129)) AS k FROM h), p AS (SELECT id, s, k, (pow(sum(z * cos({2 * math.pi!r} * k * j / 256)), 2) + pow(sum(z * sin({2 * math.pi!r} * k * j / 256)), 2)) / {_NORM!r} AS psd FROM w GROUP BY ALL)
 SELECT id, k, round(avg(psd) / 1e9, 6) + 0.0 AS psd_g, count(*) AS segments FROM p GROUP BY id, k""")
def _(spark, d):
    return S.welch(series_day(spark, d)).select("id", "k", (F.col("psd") / 1e9).alias("psd_g"), "segments")


# ---- point transforms -------------------------------------------------------------------------------------

Z = "z AS (SELECT id, t, v, (v - avg(v) OVER (PARTITION BY id)) / (CASE WHEN stddev_pop(v) OVER (PARTITION BY id) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY id) END) AS z FROM s)"


@query("zscore", f"WITH {SER}, {Z} SELECT id, t, {r('z', 'z')} FROM z")
def _(spark, d):
    return S.zscore(series_user(spark, d))


@query("clip", f"WITH {SER}, m AS (SELECT *, avg(v) OVER (PARTITION BY id) AS m, stddev_pop(v) OVER (PARTITION BY id) AS sd FROM s) SELECT id, t, {r('least(greatest(v, m - 1.1 * sd), m + 1.1 * sd)', 'v')} FROM m")
def _(spark, d):
    return S.clip(series_user(spark, d), 1.1)


@query("quantise", f"WITH {SER}, q AS (SELECT id, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM s GROUP BY id) SELECT s.id, t, CAST(len(list_filter(cuts, lambda c: c < v)) AS BIGINT) AS level FROM s JOIN q USING (id)")
def _(spark, d):
    return S.quantise(series_user(spark, d), 5)


@query("minmax_u8", f"WITH {SER}, m AS (SELECT *, min(v) OVER (PARTITION BY id) AS lo, max(v) OVER (PARTITION BY id) AS hi FROM s) SELECT id, t, CAST(CASE WHEN hi > lo THEN floor(255 * (v - lo) / (hi - lo) + 0.5) ELSE 0 END AS BIGINT) AS u8 FROM m")
def _(spark, d):
    return S.minmax_u8(series_user(spark, d))


@query("integrate", f"WITH {SER}, c AS (SELECT id, t, v - avg(v) OVER (PARTITION BY id) AS z FROM s) SELECT id, t, {r('sum(z) OVER (PARTITION BY id ORDER BY t) / pi()', 'v')} FROM c")
def _(spark, d):
    return S.integrate(series_user(spark, d)).withColumn("v", F.col("v") / math.pi)


@query("moving_average", f"WITH {SER} SELECT id, t, {r('avg(v) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)', 'v')} FROM s")
def _(spark, d):
    return S.moving_average(series_user(spark, d), 3)


@query("downsample", f"WITH {SER} SELECT id, CAST(t // 3 AS BIGINT) AS t, {r('v', 'v')} FROM s WHERE t % 3 = 0")
def _(spark, d):
    return S.downsample(series_user(spark, d), 3)


@query("nonlinear_readout", f"WITH {SER}, {Z} SELECT id, t, {r('z * z', 'square')}, {r('abs(z)', 'size')}, {r('exp(z / 2)', 'exp_half')}, {r('z * z * z', 'cube')}, {r('z * lag(z) OVER (PARTITION BY id ORDER BY t)', 'lagged')} FROM z")
def _(spark, d):
    return S.readout(series_user(spark, d))


@query("outlier_flag", f"WITH {SER}, {_excursions(2.0)} SELECT id, t, {r('deviation', 'deviation')}, far FROM exe")
def _(spark, d):
    return S.outliers(series_user(spark, d), 2.0)


@query("excursions", f"WITH {SER}, {_excursions(2.0)} SELECT id, n_events FROM ex")
def _(spark, d):
    return S.excursions(series_user(spark, d), 2.0)


@query("crossings", f"WITH {SER}, g AS (SELECT id, t, sign(v - avg(v) OVER (PARTITION BY id)) AS s FROM s), h AS (SELECT id, CASE WHEN s <> lag(s) OVER (PARTITION BY id ORDER BY t) THEN 1 ELSE 0 END AS c FROM g) SELECT id, CAST(sum(c) AS BIGINT) AS n_crossings FROM h GROUP BY id")
def _(spark, d):
    return S.crossings(series_user(spark, d))


@query("longest_flat_run", f"WITH {SER}, {_flat('0.3')} SELECT id, run FROM fl")
def _(spark, d):
    return S.longest_flat(series_user(spark, d), 0.3)


def _lag(k: int) -> str:
    return f"coalesce(lag(v, {k}) OVER (PARTITION BY id ORDER BY t), 0)"


@query("ma_filter", f"WITH {SER} SELECT id, t, {r(f'v + 0.5 * {_lag(1)} - 0.3 * {_lag(2)}', 'v')} FROM s")
def _(spark, d):
    return S.ma_filter(series_user(spark, d), [0.5, -0.3])


@query("lag_products", f"WITH {SER}, l AS (SELECT id, t, v, {_lag(1)} AS a, {_lag(2)} AS b FROM s) SELECT id, t, {r('v + 0.01 * a * b', 'bilinear')}, {r('v + 0.5 * a + 0.25 * b + 0.01 * a * a - 0.01 * a * b', 'volterra')} FROM l")
def _(spark, d):
    return S.lag_products(series_user(spark, d), 0.01)


@query("phase_portrait", f"WITH {SER}, l AS (SELECT id, t, v AS x, lead(v, 2) OVER (PARTITION BY id ORDER BY t) AS y FROM s) SELECT id, t, {r('x', 'x')}, {r('y', 'y')} FROM l WHERE y IS NOT NULL")
def _(spark, d):
    return S.phase_portrait(series_user(spark, d), 2)


@query("rank_remap", f"""WITH {SER}, q AS (SELECT id, t, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN (rank() OVER (PARTITION BY id ORDER BY v) + (count(*) OVER (PARTITION BY id, v) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY id) - 1) ELSE 0 END AS q FROM s),
 g AS (SELECT list(s_acctbal ORDER BY s_acctbal) AS goal FROM supplier), a AS (SELECT id, t, q * (len(goal) - 1) AS pos, goal FROM q, g)
 SELECT id, t, {r('1 / pi() * (goal[CAST(floor(pos) AS BIGINT) + 1] + (pos - floor(pos)) * (goal[least(CAST(floor(pos) AS BIGINT) + 2, len(goal))] - goal[CAST(floor(pos) AS BIGINT) + 1]))', 'v')} FROM a""")
def _(spark, d):
    return S.rank_remap(series_user(spark, d), read(spark, d, "supplier").select(F.col("s_acctbal").alias("v"))).withColumn("v", F.col("v") / math.pi)


GAP = "(t * 7 + id) % 5 < 2"


@query("zoh_fill", f"""WITH {SER} SELECT id, t, {r(f"coalesce(last_value(CASE WHEN NOT ({GAP}) THEN v END IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(CASE WHEN NOT ({GAP}) THEN v END IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", 'v')} FROM s""")
def _(spark, d):
    return S.zoh_fill(series_user(spark, d), F.expr(GAP))


@query("linear_fill", f"""WITH {SER}, m AS (SELECT id, t, CASE WHEN NOT ({GAP}) THEN v END AS w, CASE WHEN NOT ({GAP}) THEN t END AS wt FROM s),
 l AS (SELECT id, t, last_value(w IGNORE NULLS) OVER b AS pv, last_value(wt IGNORE NULLS) OVER b AS pt, first_value(w IGNORE NULLS) OVER a AS nv, first_value(wt IGNORE NULLS) OVER a AS nt FROM m WINDOW b AS (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT id, t, {r('CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL OR nt = pt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END', 'v')} FROM l""")
def _(spark, d):
    return S.linear_fill(series_user(spark, d), F.expr(GAP))


# ---- folds ------------------------------------------------------------------------------------------------

ARR = "x AS (SELECT id, list(v ORDER BY t) AS x FROM s GROUP BY id)"


@query("ar1_filter", f"WITH {SER}, {ARR} SELECT id, {r('list_reduce(list_prepend(0.0, x), lambda a, e: a * 0.7 + e)', 'last')} FROM x")
def _(spark, d):
    return S.to_arrays(series_user(spark, d)).select("id", C.ar1_last(F.col("x"), 0.7).alias("last"))


@query("ar2_filter_path", f"""WITH RECURSIVE {SER}, p AS (SELECT id, t, v AS y, 0.0::DOUBLE AS y1 FROM s WHERE t = 0 UNION ALL SELECT s.id, s.t, s.v + {1 / 3!r} * p.y - {1 / 7!r} * p.y1, p.y FROM p JOIN s ON s.id = p.id AND s.t = p.t + 1) SELECT id, t, {r('y', 'v')} FROM p""")
def _(spark, d):
    return S.to_long(S.to_arrays(series_user(spark, d)).select("id", C.ar_fold(F.col("x"), [1 / 3, -1 / 7]).alias("x")))


@query("garch_fold", f"WITH {SER}, {ARR} SELECT id, {r('list_reduce(list_prepend(100.0, x), lambda h, e: 5.0 + 0.1 * e * e + 0.8 * h)', 'h')} FROM x")
def _(spark, d):
    return S.to_arrays(series_user(spark, d)).select("id", C.garch_last(F.col("x"), 5.0, 0.1, 0.8, 100.0).alias("h"))


@query("logistic_orbit", f"""WITH RECURSIVE o AS (SELECT s_suppkey AS id, 0 AS k, (s_suppkey % 97 + 1) / 101.3::DOUBLE AS x FROM supplier UNION ALL SELECT id, k + 1, 3.7 * x * (1 - x) FROM o WHERE k < 20) SELECT id, {r('max(x) FILTER (k = 20)', 'last')}, {r('avg(ln(abs(3.7 * (1 - 2 * x))))', 'lyapunov')} FROM o GROUP BY id""")
def _(spark, d):
    orbit = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), C.logistic_orbit((F.col("s_suppkey") % 97 + 1) / 101.3, 3.7, 20).alias("x"))
    rate = F.aggregate("x", F.lit(0.0), lambda a, x: a + F.log(F.abs(3.7 * (1 - 2 * x)))) / F.size("x")
    return orbit.select("id", F.element_at("x", -1).alias("last"), rate.alias("lyapunov"))


# ---- events -----------------------------------------------------------------------------------------------

EV = "e AS (SELECT user_id AS id, epoch(ts) / 3600.0 AS tm FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("at"))


GAPS = "g AS (SELECT id, tm, CAST(row_number() OVER (PARTITION BY id ORDER BY tm) - 1 AS BIGINT) AS t, tm - lag(tm) OVER (PARTITION BY id ORDER BY tm) AS gap FROM e)"


@query("inter_event_times", f"WITH {EV}, {GAPS} SELECT id, t, round(gap, 4) + 0.0 AS gap FROM g WHERE gap IS NOT NULL")
def _(spark, d):
    return S.inter_event(_events(spark, d)).withColumn("gap", F.round("gap", 4))


@query("burstiness", f"WITH {EV}, {GAPS} SELECT id, {r('CASE WHEN count(gap) >= 3 AND avg(gap) + stddev_pop(gap) > 0 THEN (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) END', 'b')} FROM g WHERE gap IS NOT NULL GROUP BY id")
def _(spark, d):
    return S.burstiness(_events(spark, d))


BINS = "f AS (SELECT id, tm - min(tm) OVER () AS tm FROM e), b AS (SELECT id, CAST(floor(tm / 24) AS BIGINT) AS bin, count(*) AS n FROM f WHERE tm < 480 GROUP BY 1, 2), gr AS (SELECT id, unnest(range(0, 20)) AS bin FROM (SELECT DISTINCT id FROM e)), bn AS (SELECT gr.id, gr.bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM gr LEFT JOIN b ON b.id = gr.id AND b.bin = gr.bin)"


def _binned(spark: SparkSession, d: str, bins: int | None = 20) -> DataFrame:
    events = _events(spark, d)
    start = events.agg(F.min("at").alias("start"))
    return S.bin_events(events.join(F.broadcast(start), how="cross").select("id", (F.col("at") - F.col("start")).alias("at")), 24.0, bins)


@query("bin_events", f"WITH {EV}, {BINS} SELECT id, bin, n FROM bn")
def _(spark, d):
    return _binned(spark, d)


_W = {k: math.exp(-0.5 * (k / 1.5) ** 2) for k in range(-3, 4)}


@query("kernel_rate", f"WITH {EV}, {BINS} SELECT id, bin, " + r(" + ".join(f"{w / sum(_W.values())!r}::DOUBLE * coalesce({'lead' if k >= 0 else 'lag'}(n, {abs(k)}) OVER (PARTITION BY id ORDER BY bin), 0)" for k, w in _W.items()), "rate") + " FROM bn")
def _(spark, d):
    return S.kernel_rate(_binned(spark, d), 1.5, 3)


BINS_ALL = "f AS (SELECT id, CAST(floor((tm - min(tm) OVER ()) / 24) AS BIGINT) AS bin FROM e), b AS (SELECT id, bin, count(*) AS n FROM f GROUP BY 1, 2), gr AS (SELECT id, unnest(range(0, top + 1)) AS bin FROM (SELECT DISTINCT id FROM e), (SELECT max(bin) AS top FROM f)), bn AS (SELECT gr.id, gr.bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM gr LEFT JOIN b ON b.id = gr.id AND b.bin = gr.bin)"


@query("bin_events_all", f"WITH {EV}, {BINS_ALL} SELECT id, bin, n FROM bn")
def _(spark, d):
    """The events of all days; bin_events has the first 20."""
    return _binned(spark, d, None)


@query("kernel_rate_all", f"WITH {EV}, {BINS_ALL} SELECT id, bin, " + r(" + ".join(f"{w / sum(_W.values())!r}::DOUBLE * coalesce({'lead' if k >= 0 else 'lag'}(n, {abs(k)}) OVER (PARTITION BY id ORDER BY bin), 0)" for k, w in _W.items()), "rate") + " FROM bn")
def _(spark, d):
    return S.kernel_rate(_binned(spark, d, None), 1.5, 3)


# ---- distributions ----------------------------------------------------------------------------------------


@query("ks_uniform", f"WITH {SER}, k AS (SELECT id, (v - min(v) OVER (PARTITION BY id)) / (max(v) OVER (PARTITION BY id) - min(v) OVER (PARTITION BY id)) AS p, row_number() OVER (PARTITION BY id ORDER BY v, t) AS i, count(*) OVER (PARTITION BY id) AS n FROM s) SELECT id, {r('max(greatest(i / n - p, p - (i - 1) / n))', 'd')} FROM k GROUP BY id")
def _(spark, d):
    return S.ks_uniform(series_user(spark, d))


@query("ks_two_sample", f"""WITH {SER}, h AS (SELECT id, v, t < floor(count(*) OVER (PARTITION BY id) / 2) AS one FROM s), k AS (SELECT id, abs(sum(one::INT) OVER (PARTITION BY id ORDER BY v) / sum(one::INT) OVER (PARTITION BY id) - sum((NOT one)::INT) OVER (PARTITION BY id ORDER BY v) / sum((NOT one)::INT) OVER (PARTITION BY id)) AS d FROM h) SELECT id, {r('max(d)', 'd')} FROM k GROUP BY id""")
def _(spark, d):
    return S.ks_halves(series_user(spark, d))


@query("reversibility", f"""WITH {SER}, u AS (SELECT id, t, (row_number() OVER (PARTITION BY id ORDER BY v, t) - 0.5) / count(*) OVER (PARTITION BY id) - 0.5 AS u FROM s), x AS (SELECT id, t, u * sqrt(12) AS x, (u * u - avg(u * u) OVER (PARTITION BY id)) / (stddev_pop(u * u) OVER (PARTITION BY id) + 1e-300) AS y FROM u),
 p AS (SELECT a.id, b.t - a.t AS lag, a.x AS x, b.x AS z, b.x - a.x AS dx, b.y - a.y AS dy FROM x a JOIN x b ON a.id = b.id AND b.t - a.t IN (1, 2, 4))
 SELECT id, lag, {r('avg(dx * dx * dx) / (pow(avg(dx * dx), 1.5) + 1e-300)', 'trev')}, {r('avg(dy * dy * dy) / (pow(avg(dy * dy), 1.5) + 1e-300)', 'trev2')}, {r('avg(x * x * z - x * z * z)', 'bic')} FROM p GROUP BY id, lag""")
def _(spark, d):
    return S.reversibility(series_user(spark, d), [1, 2, 4])


@query("recurrence_rate", f"""WITH {SER}, {Z}, e AS (SELECT id, t, z AS a, lead(z) OVER w AS b, lead(z, 2) OVER w AS c FROM z WINDOW w AS (PARTITION BY id ORDER BY t)), p AS (SELECT x.id, pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) AS d FROM e x JOIN e y ON x.id = y.id AND y.t > x.t WHERE x.c IS NOT NULL AND y.c IS NOT NULL),
 q AS (SELECT id, quantile_cont(d, 0.1) AS eps FROM p GROUP BY id) SELECT p.id, {r('eps', 'eps')}, {r('avg(CASE WHEN d <= eps THEN 1.0 ELSE 0.0 END)', 'rate')} FROM p JOIN q USING (id) GROUP BY p.id, eps""")
def _(spark, d):
    return S.recurrence(series_user(spark, d))


# ---- audits -----------------------------------------------------------------------------------------------


@query("audit_stationarity", f"WITH {SER}, {META}, {_windows(5)} SELECT family, count(*) AS series, {r('max(sm)', 'max_sm')}, {r('max(ss)', 'max_ss')}, CAST(sum(CASE WHEN sm > 0.5 OR ss > 0.35 OR vr > 10 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM ws JOIN meta USING (id) GROUP BY family")
def _(spark, d):
    return corpus.audit_stationarity(series_user(spark, d), series_meta(spark, d))


@query("audit_quantiles", f"WITH {SER}, {_windows(5)}, l AS (UNPIVOT (SELECT sm, ss, vr FROM ws) ON sm, ss, vr INTO NAME statistic VALUE v) SELECT statistic, q::DOUBLE AS q, {r('CASE q WHEN 0.5 THEN quantile_cont(v, 0.5) WHEN 0.9 THEN quantile_cont(v, 0.9) WHEN 0.95 THEN quantile_cont(v, 0.95) ELSE quantile_cont(v, 0.99) END', 'value')} FROM l, (VALUES (0.5), (0.9), (0.95), (0.99)) AS w(q) GROUP BY statistic, q")
def _(spark, d):
    return corpus.audit_quantiles(series_user(spark, d))


@query("audit_length", f"""WITH {SER}, {META}, {TAU}, {_excursions(4.0)}, k AS (SELECT id, count(*) AS n, count(DISTINCT v) AS k FROM s GROUP BY id)
 SELECT family, count(*) AS series, {r('quantile_cont(tau::DOUBLE, 0.5)', 'tau_med')}, max(tau) AS tau_max, {r('min(n / tau)', 'spans_min')}, min(n_events) AS events_min, min(k) AS distinct_min FROM k JOIN tau USING (id) JOIN ex USING (id) JOIN meta USING (id) GROUP BY family""")
def _(spark, d):
    return corpus.audit_length_browser(series_user(spark, d), series_meta(spark, d))


TAU_500 = ACF.format(k=499) + ", tau AS (SELECT x.id, CASE WHEN x.lo = x.hi THEN 'infinity'::DOUBLE ELSE coalesce(y.k, 500)::DOUBLE END AS tau FROM (SELECT id, min(v) AS lo, max(v) AS hi FROM s GROUP BY id) x LEFT JOIN (SELECT id, min(k) AS k FROM acf WHERE r < exp(-1) GROUP BY id) y USING (id))"


@query("acf_time_500", f"WITH {SER}, {ACF.format(k=499)} SELECT x.id, CAST(CASE WHEN x.lo = x.hi THEN 500 ELSE coalesce(y.k, 500) END AS BIGINT) AS tau FROM (SELECT id, min(v) AS lo, max(v) AS hi FROM s GROUP BY id) x LEFT JOIN (SELECT id, min(k) AS k FROM acf WHERE r < exp(-1) GROUP BY id) y USING (id)")
def _(spark, d):
    return S.acf_time(series_user(spark, d), 500)


@query("audit_length_500", f"""WITH {SER}, {META}, {TAU_500}, {_excursions(4.0)}, k AS (SELECT id, count(*) AS n, count(DISTINCT v) AS k FROM s GROUP BY id)
 SELECT family, count(*) AS series, {r('quantile_cont(tau, 0.5)', 'tau_med')}, {r('max(tau)', 'tau_max')}, {r('min(n / tau)', 'spans_min')}, min(n_events) AS events_min, min(k) AS distinct_min FROM k JOIN tau USING (id) JOIN ex USING (id) JOIN meta USING (id) GROUP BY family""")
def _(spark, d):
    """The audit with the audit's 500 lags; audit_length has the browser's 40."""
    return corpus.audit_length(series_user(spark, d), series_meta(spark, d))


SCREEN = f"""{SER}, {META}, {_windows(10)}, {TAU}, {_flat('1e-6')}, {_excursions(3.0)}, nn AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s), pp AS (SELECT *, CASE WHEN t < floor(n / 20) THEN 'head' WHEN t >= n - floor(n / 20) THEN 'tail' ELSE 'mid' END AS part FROM nn),
 en AS (SELECT id, max(n) AS n, max(v) AS hi, min(v) AS lo, quantile_cont(v, 0.01) AS q1, quantile_cont(v, 0.99) AS q9, count(DISTINCT v) AS k, avg(v) FILTER (part = 'head') AS hm, stddev_pop(v) FILTER (part = 'head') AS hs, avg(v) FILTER (part = 'mid') AS mm, stddev_pop(v) FILTER (part = 'mid') AS ms0, avg(v) FILTER (part = 'tail') AS tm, stddev_pop(v) FILTER (part = 'tail') AS tsd FROM pp GROUP BY id),
 co AS (SELECT id, max(c) AS common FROM (SELECT id, v, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY id),
 al AS (SELECT *, CASE WHEN ms0 = 0 THEN 1 ELSE ms0 END AS md FROM en JOIN (SELECT id, sm, ss, vr FROM ws) USING (id) JOIN tau USING (id) JOIN fl USING (id) JOIN ex USING (id) JOIN co USING (id) JOIN meta USING (id)),
 sc AS (SELECT id, family, tau > 6 AS slow, NOT (event_like = 'yes' OR bursty = 'yes') AND (sm > 0.35 OR ss > 0.35 OR vr > 8) AS drift, coalesce(abs(hm - mm) > md OR NOT (hs / md > 0.3 AND hs / md < 3), false) AS onset, coalesce(abs(tm - mm) > md OR NOT (tsd / md > 0.3 AND tsd / md < 3), false) AS ending,
 run > 30 AND common / n <= 0.2 AS flat, (hi - lo) / greatest(q9 - q1, 1e-12) > 3 AS spiky, k < 40 OR common / n > 0.4 AS levels, event_like = 'yes' AND n_events < 2 AS few_events FROM al),
 scr AS (SELECT *, CAST(slow::INT + drift::INT + onset::INT + ending::INT + flat::INT + spiky::INT + levels::INT + few_events::INT AS BIGINT) AS n_issues FROM sc)"""


@query("screen", f"WITH {SCREEN} SELECT * FROM scr")
def _(spark, d):
    return corpus.screen_short(series_user(spark, d), series_meta(spark, d))


@query("screen_summary", f"WITH {SCREEN} SELECT family, count(*) AS series, CAST(sum((n_issues > 0)::INT) AS BIGINT) AS flagged, CAST(sum(n_issues) AS BIGINT) AS issues FROM scr GROUP BY family")
def _(spark, d):
    return corpus.screen_summary(corpus.screen_short(series_user(spark, d), series_meta(spark, d)))


def _screen_full(spark: SparkSession, d: str) -> DataFrame:
    """All twelve issues; the embeddings stand for the series' profiles."""
    meta = series_meta(spark, d).withColumn("continuous_time", F.when(F.pmod("id", F.lit(6)) == 0, "yes").otherwise("no"))
    return corpus.screen(series_user(spark, d), meta, features(spark, d))


@query("screen_full", None)
def _(spark, d):
    return _screen_full(spark, d)


@query("screen_full_summary", None)
def _(spark, d):
    return corpus.screen_summary(_screen_full(spark, d))


# ---- metadata ---------------------------------------------------------------------------------------------


@query("subset_where", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE CAST(o_orderpriority AS VARCHAR) IN ('1-URGENT', '2-HIGH') AND CAST(o_orderstatus AS VARCHAR) IN ('F', 'O')")
def _(spark, d):
    return corpus.subset(read(spark, d, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["F", "O"]}).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("chip_filter", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' AND contains(lower(p_name || ' ' || p_type), 'part')")
def _(spark, d):
    return corpus.chip_filter(read(spark, d, "part"), {"p_brand": "Brand#1"}, F.concat_ws(" ", "p_name", "p_type"), "PART").select("p_partkey")


@query("chip_counts", f"WITH {META}, c AS (SELECT unnest(['event_like:' || event_like, 'bursty:' || bursty, 'deterministic:' || deterministic, 'discrete:' || discrete, 'periodic:' || periodic]) AS chip FROM meta) SELECT chip, count(*) AS n FROM c WHERE split_part(chip, ':', 2) NOT IN ('no', 'na', 'none') GROUP BY chip HAVING count(*) < (SELECT count(*) FROM meta)")
def _(spark, d):
    return corpus.chip_counts(series_meta(spark, d), ["event_like", "bursty", "deterministic", "discrete", "periodic"])


ENTRIES = "e AS (SELECT 'Class' AS kind, r_name AS label, r_name AS text FROM region UNION SELECT 'Process', n_name, n_name || ' ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'Series', p_type, p_type || ' ' || p_brand FROM part)"


@query("ranked_search", f"WITH {ENTRIES} SELECT label, kind, CAST((CASE WHEN starts_with(lower(label), 'a') THEN 100 WHEN contains(lower(label), 'a') THEN 70 ELSE 20 END) + CASE kind WHEN 'Class' THEN 6 WHEN 'Process' THEN 4 ELSE 0 END AS BIGINT) AS score FROM e WHERE contains(lower(text), 'a') ORDER BY score DESC, label, kind LIMIT 10")
def _(spark, d):
    region, nation, part = (read(spark, d, t) for t in ("region", "nation", "part"))
    a = region.select(F.lit("Class").alias("kind"), F.col("r_name").alias("label"), F.col("r_name").alias("text"))
    b = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("Process").alias("kind"), F.col("n_name").alias("label"), F.concat_ws(" ", "n_name", "r_name").alias("text"))
    c = part.select(F.lit("Series").alias("kind"), F.col("p_type").alias("label"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    return corpus.ranked_search(a.unionByName(b).unionByName(c).distinct(), "a")


@query("top7_plus_other", "WITH c AS (SELECT n_name AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS r, count(*) OVER () AS g FROM c) SELECT CASE WHEN g <= 8 OR r < 8 THEN k ELSE 'other' END AS grp, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def _(spark, d):
    return corpus.top_and_rest(read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")), "n_name")


@query("tag_fraction_matrix", f"WITH {META}, l AS (UNPIVOT (SELECT cls, event_like, bursty, periodic FROM meta) ON event_like, bursty, periodic INTO NAME tag VALUE value) SELECT cls, tag, {r('''avg(CASE WHEN value = 'yes' THEN 1.0 ELSE 0.0 END)''', 'fraction')} FROM l GROUP BY cls, tag")
def _(spark, d):
    return corpus.tag_fraction(series_meta(spark, d), "cls", ["event_like", "bursty", "periodic"])


@query("keywords", f"WITH {META} SELECT id, concat_ws(',', CASE WHEN event_like = 'yes' THEN 'event_like' END, CASE WHEN bursty = 'yes' THEN 'bursty' END, CASE WHEN discrete = 'yes' THEN 'discrete' END, CASE WHEN periodic = 'yes' THEN 'periodic' END) AS keywords FROM meta")
def _(spark, d):
    meta = series_meta(spark, d)
    return meta.select("id", corpus.keywords(meta, ["event_like", "bursty", "discrete", "periodic"]).alias("keywords"))


@query("tag_merge", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, CASE WHEN user_id % 2 = 0 THEN 'family' END, 'no') AS tag FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", corpus.merge_tags(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), F.when(F.col("user_id") % 2 == 0, F.lit("family")), "no").alias("tag"))


@query("group_first", f"WITH {META} SELECT family, min(id) AS id FROM meta GROUP BY family")
def _(spark, d):
    return corpus.group_first(series_meta(spark, d), ["family"], ["id"]).select("family", "id")


@query("by_class", f"WITH {META}, f AS (SELECT cls, family, min(id) AS o FROM meta GROUP BY 1, 2) SELECT cls, string_agg(family, ',' ORDER BY o, family) AS families FROM f GROUP BY cls")
def _(spark, d):
    return corpus.by_class(series_meta(spark, d), "cls", "family", "id")


@query("quota_report", f"WITH {META}, h AS (SELECT cls, count(*) AS registered FROM meta GROUP BY cls), w(cls, declared) AS (VALUES ('A', 20), ('B', 20), ('F', 20), ('Z', 5)) SELECT coalesce(w.cls, h.cls) AS cls, CAST(coalesce(registered, 0) AS BIGINT) AS registered, CAST(coalesce(declared, 0) AS BIGINT) AS declared, CAST(coalesce(registered, 0) - coalesce(declared, 0) AS BIGINT) AS gap FROM w FULL JOIN h ON w.cls = h.cls")
def _(spark, d):
    return corpus.quota_report(series_meta(spark, d).withColumn("n", F.lit(1)), {"A": 20, "B": 20, "F": 20, "Z": 5})


@query("family_rollup", f"WITH {SER}, {META} SELECT coalesce(cls, 'total') AS cls, coalesce(family, 'total') AS family, count(*) AS n, {r('avg(v)', 'mean')} FROM s JOIN meta USING (id) GROUP BY ROLLUP (cls, family)")
def _(spark, d):
    return corpus.rollup_counts(series_user(spark, d).join(series_meta(spark, d), "id"), ["cls", "family"], "v")


UNI = "(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


@query("hash_uniform", f"SELECT p_partkey, {r(UNI.format(parts=chr(39) + 'seed' + chr(39) + ', CAST(p_partkey AS VARCHAR)'), 'u')} FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", C.uniform("seed", F.col("p_partkey").cast("string")).alias("u"))


@query("seeded_sample", f"WITH o AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {UNI.format(parts=chr(39) + 'quiz' + chr(39) + ', CAST(c_custkey AS VARCHAR)')}, c_custkey) AS o FROM customer) SELECT c_nationkey, c_custkey FROM o WHERE o <= 7")
def _(spark, d):
    return corpus.seeded_sample(read(spark, d, "customer"), "quiz", "c_custkey", "c_nationkey", 7).select("c_nationkey", "c_custkey")


@query("lhs_strata", f"SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY {UNI.format(parts=chr(39) + 'lhs' + chr(39) + ', CAST(s_suppkey AS VARCHAR)')}, s_suppkey) - 1 AS BIGINT) AS stratum, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
def _(spark, d):
    return corpus.strata(read(spark, d, "supplier"), "lhs", "s_suppkey", "s_nationkey")


@query("as_of_join", "SELECT e.event_id, (SELECT max_by(p.event_id, p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type <> 'purchase'")
def _(spark, d):
    events = read(spark, d, "events")
    left = events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return corpus.as_of(left, right, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("done_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(spark, d):
    done = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


# ---- features ---------------------------------------------------------------------------------------------

FE = "f AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS grp, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), w AS (SELECT id, grp, unnest(f) AS v, generate_subscripts(f, 1) - 1 AS j FROM f), q AS (SELECT j, quantile_cont(v, 0.5) AS med, CASE WHEN quantile_cont(v, 0.75) = quantile_cont(v, 0.25) THEN stddev_pop(v) + 1e-12 ELSE quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END AS iqr FROM w GROUP BY j)"
PAIRS = "pr AS (SELECT a.id, b.id AS other, a.grp AS ga, b.grp AS gb, list_distance(a.f, b.f) AS d FROM f a JOIN f b ON a.id <> b.id), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM pr)"


@query("robust_sigmoid", f"WITH {FE} SELECT id, CAST(w.j AS BIGINT) AS j, {r('1 / (1 + exp(-greatest(least((v - med) / (iqr / 1.35), 50), -50)))', 's')} FROM w JOIN q USING (j)")
def _(spark, d):
    return similarity.robust_sigmoid(features(spark, d))


@query("knn8", f"WITH {FE}, {PAIRS} SELECT id, rank, other, {r('d', 'd')} FROM nn WHERE rank <= 8")
def _(spark, d):
    f = features(spark, d)
    return similarity.nearest(f, f, 8)


LOOK = "lk AS (SELECT id, other, d, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM pr WHERE ga <> gb), md AS (SELECT median(d) AS m FROM nn WHERE rank = 1)"


@query("lookalikes16", f"WITH {FE}, {PAIRS}, {LOOK} SELECT id, rank, other, {r('d', 'd')}, CASE WHEN d < m THEN 'near' WHEN d < 1.12 * m THEN 'close' ELSE 'loose' END AS tier FROM lk, md WHERE rank <= 16")
def _(spark, d):
    return similarity.lookalike_tiers(features(spark, d))


@query("median_nn", f"WITH {FE}, {PAIRS} SELECT {r('median(d)', 'median_nn')} FROM nn WHERE rank = 1")
def _(spark, d):
    return similarity.median_nearest(features(spark, d))


@query("coverage_gaps", f"WITH {FE}, {PAIRS}, a AS (SELECT id, min(d) AS d FROM pr WHERE id % 2 = 0 AND other % 2 = 0 GROUP BY id), l AS (SELECT quantile_cont(d, 0.95) AS m FROM a), b AS (SELECT id, min(d) AS d FROM pr WHERE id % 2 = 1 AND other % 2 = 0 GROUP BY id) SELECT id, {r('d', 'd')} FROM b, l WHERE d > m")
def _(spark, d):
    f = features(spark, d)
    return similarity.coverage_gaps(f.filter("id % 2 = 1"), f.filter("id % 2 = 0"))


@query("duplicate_pairs", f"""WITH {FE}, z AS (SELECT id, grp, j, greatest(least((v - med) / iqr, 10), -10) AS z FROM w JOIN q USING (j)), g AS (SELECT id, grp, list(z ORDER BY j) AS f FROM z GROUP BY 1, 2), p AS (SELECT a.grp, a.id AS a, b.id AS b, list_distance(a.f, b.f) AS d FROM g a JOIN g b ON a.grp = b.grp AND a.id < b.id),
 l AS (SELECT grp, 0.85 * median(d) AS m, count(*) AS n FROM p GROUP BY grp) SELECT a, b, {r('d', 'd')} FROM p JOIN l USING (grp) WHERE n >= 3 AND d < m""")
def _(spark, d):
    return similarity.duplicate_pairs(features(spark, d), share=0.85)


@query("pca_scores")
def _(spark, d):
    return similarity.pca(features(spark, d))


# ---- generators and streams -------------------------------------------------------------------------------


@query("families", None)
def _(spark, d):
    from tideloom.generators import tables

    return tables.families(spark).select("cls", "family", "profile", F.col("n").cast("long").alias("n"))


@query("generated_corpus", None)
def _(spark, d):
    """Every series of the full profile, as a digest."""
    from tideloom.generators import tables

    made = tables.generate(tables.selection(spark, "full"))
    return made.select("id", "cls", "family", "attempt", "keywords", "sha256", "error")


@query("event_windows", f"SELECT user_id AS id, date_trunc('day', ts) AS start, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'sd')} FROM events GROUP BY 1, 2")
def _(spark, d):
    from tideloom.streaming.monitor import windowed_stats

    return windowed_stats(read(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


from tideloom.plans import surveyed  # noqa: E402, F401  registers its queries with `query`
