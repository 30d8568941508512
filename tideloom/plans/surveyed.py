"""Registered queries of operators in their full surveyed form, beside the shorter ones of the catalogue."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tideloom.operators import review, similarity
from tideloom.operators import series as S
from tideloom.plans.catalogue import DAY, DFT, FE, META, ORACLE_SQL, SCREEN, SER, Z, _windows, query, r
from tideloom.sources.bridge import features, read, series_day, series_meta, series_user

STATE = "CASE WHEN id % 13 = 0 THEN 'no' ELSE 'yes' END AS stationary"


@query("gate_composition_full", f"""WITH {SER}, {META}, {_windows(5)}, g AS (SELECT *, {STATE}, cls IN ('F','G','H','L') AND deterministic IN ('yes','partly') AS settled FROM (SELECT id, count(DISTINCT v) AS k FROM s GROUP BY id) JOIN meta USING (id) JOIN (SELECT id, sm, ss, vr FROM ws) USING (id))
 SELECT id, CASE WHEN discrete = 'yes' THEN 'discrete' WHEN k < 30 THEN 'few values' WHEN cls IN ('F','G') AND periodic = 'yes' THEN 'periodic' WHEN stationary = 'no' THEN 'ok' WHEN sm > 0.5 THEN 'mean'
 WHEN bursty = 'yes' OR event_like = 'yes' THEN 'ok' WHEN ss > CASE WHEN settled THEN 0.3 ELSE 0.5 END OR vr > CASE WHEN settled THEN 6 ELSE 20 END THEN 'variance' ELSE 'ok' END AS verdict FROM g""")
def _(spark, d):
    meta = series_meta(spark, d).withColumn("stationary", F.when(F.pmod("id", F.lit(13)) == 0, "no").otherwise("yes"))
    return S.gate_composition(series_user(spark, d), meta, 30)


_T = lambda c: f"{r(f'avg({c})', c)}, {r(f'avg({c}) / (stddev_samp({c}) / sqrt(count({c})))', 't_' + c)}"


@query("reversibility_segments", f"""WITH {DAY}, s0 AS (SELECT *, floor(count(*) OVER (PARTITION BY id) / 20) AS size FROM s), s1 AS (SELECT id, CAST(floor(t / size) AS BIGINT) AS g, t, v FROM s0 WHERE t < size * 20),
 u AS (SELECT id, g, t, (row_number() OVER (PARTITION BY id, g ORDER BY v, t) - 0.5) / count(*) OVER (PARTITION BY id, g) - 0.5 AS u FROM s1), x AS (SELECT id, g, t, u * sqrt(12) AS x, (u * u - avg(u * u) OVER (PARTITION BY id, g)) / (stddev_pop(u * u) OVER (PARTITION BY id, g) + 1e-300) AS y FROM u),
 p AS (SELECT a.id, a.g, b.t - a.t AS lag, a.x AS x, b.x AS z, b.x - a.x AS dx, b.y - a.y AS dy FROM x a JOIN x b ON a.id = b.id AND a.g = b.g AND b.t - a.t IN (1, 2, 4, 8, 16)),
 q AS (SELECT id, g, lag, avg(dx * dx * dx) / (pow(avg(dx * dx), 1.5) + 1e-300) AS trev, avg(dy * dy * dy) / (pow(avg(dy * dy), 1.5) + 1e-300) AS trev2, avg(x * x * z - x * z * z) AS bic FROM p GROUP BY ALL)
 SELECT id, lag, {_T('trev')}, {_T('trev2')}, {_T('bic')} FROM q GROUP BY id, lag""")
def _(spark, d):
    """The audit's five lags over twenty segments; the catalogue's reversibility takes three lags over the whole."""
    return S.reversibility_audit(series_day(spark, d), [1, 2, 4, 8, 16])


@query("periodicity", f"""WITH {SER}, {DFT}, o AS (SELECT id, n, k, row_number() OVER (PARTITION BY id ORDER BY round(power, 6) DESC, k) AS o FROM p), l AS (SELECT id, n, CAST(round_even(n / k, 0) AS BIGINT) AS lag FROM o WHERE o = 1),
 zz AS (SELECT id, t, v - avg(v) OVER (PARTITION BY id) AS z FROM s), e AS (SELECT id, sum(z * z) AS e FROM zz GROUP BY id), x AS (SELECT a.id, sum(a.z * b.z) AS x FROM zz a JOIN l ON a.id = l.id JOIN zz b ON b.id = a.id AND b.t = a.t + l.lag GROUP BY a.id)
 SELECT l.id, {r('CASE WHEN lag >= 2 AND lag < floor(n / 2) THEN x / e ELSE 0 END', 'r')} FROM l JOIN e USING (id) LEFT JOIN x USING (id)""")
def _(spark, d):
    return S.periodicity(series_user(spark, d))


@query("spectral_period", f"""WITH {SER}, c AS (SELECT id, t, v - avg(v) OVER (PARTITION BY id) AS z, count(*) OVER (PARTITION BY id) AS n FROM s), h AS (SELECT id, t, n, z * (0.5 - 0.5 * cos({2 * math.pi!r} * t / (n - 1))) AS z FROM c WHERE n >= 32), w AS (SELECT id, n, t, z, unnest(range(2, CAST(floor(n / 2) AS BIGINT) + 1)) AS k FROM h),
 p AS (SELECT id, n, k, pow(sum(z * cos({2 * math.pi!r} * k * t / n)), 2) + pow(sum(z * sin({2 * math.pi!r} * k * t / n)), 2) AS p FROM w GROUP BY ALL), q AS (SELECT *, quantile_cont(CASE WHEN p > 0 THEN p END, 0.5) OVER (PARTITION BY id) AS m, row_number() OVER (PARTITION BY id ORDER BY round(p, 6) DESC, k) AS o FROM p)
 SELECT i.id, {r('CASE WHEN round(p, 6) >= 5 * m AND n / k >= 3 AND n / k <= n / 2.5 THEN n / k END', 'period')} FROM (SELECT DISTINCT id FROM s) i LEFT JOIN (SELECT * FROM q WHERE o = 1) q USING (id)""")
def _(spark, d):
    return S.spectral_period(series_user(spark, d))


@query("best_start", f"""WITH {SER}, c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s), w AS (SELECT DISTINCT id, n, CAST(round_even(i / 8.0 * (n - 24), 0) AS BIGINT) AS start FROM c, range(9) AS f(i) WHERE n >= 24),
 p AS (SELECT w.id, start, stddev_pop(v) AS sd FROM w JOIN s ON s.id = w.id AND t >= start AND t < start + 24 GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sd, 9) DESC, start) AS o FROM p) SELECT id, start, {r('sd', 'sd')} FROM q WHERE o = 1""")
def _(spark, d):
    return S.best_start(series_user(spark, d), 24)


@query("recurrence_blocks", f"""WITH {SER}, {Z}, e AS (SELECT id, t, z AS a, lead(z) OVER w AS b, lead(z, 2) OVER w AS c FROM z WINDOW w AS (PARTITION BY id ORDER BY t)), f AS (SELECT *, count(*) OVER (PARTITION BY id) AS m FROM e WHERE c IS NOT NULL), p AS (SELECT x.id, x.m, x.t AS i, y.t AS j, pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) AS d FROM f x JOIN f y ON x.id = y.id AND y.t >= x.t),
 q AS (SELECT id, quantile_cont(d, 0.1) AS eps FROM p WHERE j > i GROUP BY id) SELECT id, CAST(floor(i / ceil(m / 8.0)) AS BIGINT) AS a, CAST(floor(j / ceil(m / 8.0)) AS BIGINT) AS b, count(*) AS n FROM p JOIN q USING (id) WHERE d <= eps GROUP BY ALL""")
def _(spark, d):
    return S.recurrence_blocks(series_user(spark, d), 8)


_SIG = lambda factor: f"1 / (1 + exp(-greatest(least((v - med) / (iqr * {factor!r}), 50), -50)))"


@query("robust_sigmoid_figures", f"WITH {FE} SELECT id, j, {r(_SIG(1.35), 's')} FROM w JOIN q USING (j)")
def _(spark, d):
    return similarity.robust_sigmoid(features(spark, d), 1.35)


@query("robust_sigmoid_z", f"WITH {FE}, g AS (SELECT id, j, {_SIG(1 / 1.35)} AS s FROM w JOIN q USING (j)) SELECT id, j, {r('(s - avg(s) OVER (PARTITION BY j)) / CASE WHEN stddev_pop(s) OVER (PARTITION BY j) = 0 THEN 1 ELSE stddev_pop(s) OVER (PARTITION BY j) END', 'z')} FROM g")
def _(spark, d):
    return similarity.robust_sigmoid_z(features(spark, d))


@query("clean_features", f"""WITH {FE}, h AS (SELECT id, j, CASE WHEN j <> 3 AND NOT (id % 7 = 0 AND j % 5 = 1) THEN v END AS v FROM w), m AS (SELECT id, j, coalesce(v, avg(v) OVER (PARTITION BY j)) AS v FROM h WHERE j <> 3)
 SELECT id, j, {r('greatest(least((v - avg(v) OVER (PARTITION BY j)) / (stddev_pop(v) OVER (PARTITION BY j) + 1e-12), 8), -8)', 'z')} FROM m""")
def _(spark, d):
    """Column 3 has no value, and every seventh vector lacks every fifth."""
    gone = lambda x, j: F.when((j == 3) | ((F.pmod("id", F.lit(7)) == 0) & (j % 5 == 1)), F.when(j % 2 == 0, F.lit(None)).otherwise(float("nan"))).otherwise(x)
    return similarity.clean_features(features(spark, d).withColumn("f", F.transform("f", gone)))


# ---- browsing and review ----------------------------------------------------------------------------------


@query("chips_yes_or_partly", f"WITH {META} SELECT id, family FROM meta WHERE deterministic IN ('yes', 'partly') AND bursty IN ('yes', 'partly') AND cls IN ('A', 'B', 'F', 'G')")
def _(spark, d):
    return review.chips(series_meta(spark, d), {"deterministic": ("yes", "partly"), "bursty": ("yes", "partly"), "cls": ("A", "B", "F", "G")}).select("id", "family")


_NAMED = "nm AS (SELECT DISTINCT id, cls, family, CASE WHEN id % 3 = 0 THEN family || ' calm' ELSE family || ' ' || CAST(id % 2 AS VARCHAR) END AS name, CASE WHEN id % 2 = 0 THEN 'noise' ELSE 'flow' END AS sys FROM meta)"


def _named(spark, d):
    family, i = F.col("family"), F.col("id")
    name = F.when(F.pmod(i, F.lit(3)) == 0, F.concat(family, F.lit(" calm"))).otherwise(F.concat(family, F.lit(" "), F.pmod(i, F.lit(2)).cast("string")))
    return series_meta(spark, d).select("id", "cls", "family", name.alias("name"), F.when(F.pmod(i, F.lit(2)) == 0, "noise").otherwise("flow").alias("sys"))


_INDEX = f"""{_NAMED}, sz AS (SELECT cls, family, count(*) AS size FROM nm GROUP BY ALL), gr AS (SELECT cls, name, count(*) AS n, min(family) AS family, max(family) AS last, min(sys) AS words FROM nm GROUP BY ALL),
 ix AS (SELECT 'Class' AS kind, cls AS label, lower(cls) AS text FROM nm GROUP BY cls UNION ALL SELECT 'Process', family, lower(family || ' ' || cls) FROM nm GROUP BY cls, family
 UNION ALL SELECT 'Series', CASE WHEN n > 1 THEN name || ' x' || n ELSE name END, lower(name || ' ' || family || ' ' || words) FROM gr JOIN sz USING (cls, family) WHERE NOT (n > 1 AND n = size AND family = last))"""


@query("search_index", f"WITH {META}, {_INDEX} SELECT * FROM ix")
def _(spark, d):
    return review.search_index(_named(spark, d), F.col("sys"))


@query("ranked_search_words", f"""WITH {META}, {_INDEX}, w AS (SELECT DISTINCT * FROM ix WHERE contains(text, 'calm') AND contains(text, 'fam1')),
 z AS (SELECT label, kind, CAST((CASE WHEN starts_with(lower(label), 'calm fam1') THEN 100 WHEN contains(lower(label), 'calm fam1') THEN 70 WHEN contains(lower(label), 'calm') AND contains(lower(label), 'fam1') THEN 55 ELSE 20 END) + CASE kind WHEN 'Class' THEN 6 WHEN 'Process' THEN 4 ELSE 0 END AS BIGINT) AS score FROM w) SELECT * FROM z ORDER BY score DESC, label, kind LIMIT 10""")
def _(spark, d):
    """Two words that no label holds side by side."""
    from tideloom.operators import corpus

    return corpus.ranked_search(review.search_index(_named(spark, d), F.col("sys")).distinct(), "Calm  fam1")


@query("labels_and_names", f"""WITH {META} SELECT id, array_to_string(list_filter([CASE WHEN id % 5 > 0 THEN 'domain' || CAST(id % 5 AS VARCHAR) END, CASE WHEN event_like = 'yes' THEN 'events' END, CASE WHEN bursty = 'yes' THEN 'bursts' END, CASE WHEN periodic = 'yes' THEN 'periodic' END], lambda x: x IS NOT NULL)[1:3], ',') AS labels,
 CASE WHEN periodic = 'yes' AND bursty = 'yes' THEN 'Bursting cycle' WHEN periodic = 'yes' THEN 'Cycle' ELSE upper(family[1]) || family[2:] END AS name FROM meta""")
def _(spark, d):
    yes = lambda c: F.col(c) == "yes"
    domain = F.when(F.pmod("id", F.lit(5)) > 0, F.concat(F.lit("domain"), F.pmod("id", F.lit(5)).cast("string"))).otherwise("abstract")
    shown = F.array_join(review.labels(domain, {"events": yes("event_like"), "bursts": yes("bursty"), "periodic": yes("periodic")}), ",")
    name = review.display_name(F.col("family"), [(yes("periodic") & yes("bursty"), "Bursting cycle"), (yes("periodic"), "Cycle")])
    return series_meta(spark, d).select("id", shown.alias("labels"), name.alias("name"))


@query("multi_selection", f"WITH {META} SELECT id FROM meta WHERE event_like = 'yes' AND family IN ('fam0', 'fam5', 'fam10') AND cls IN ('F', 'A', 'G') AND id <= 120")
def _(spark, d):
    meta = series_meta(spark, d).withColumn("event_like", F.col("event_like") == "yes")
    return review.select(meta, "event_like", range(0, 121), ["fam0", "fam5", "fam10"], ["F", "A", "G"]).select("id")


_NOTES = "nt AS (SELECT user_id AS id, event_type AS category, CASE WHEN event_id % 97 = 0 THEN 'redundant with another' WHEN event_id % 5 = 0 THEN 'point mass at zero' ELSE 'odd' END AS note FROM events)"


def _notes(spark, d):
    text = F.when(F.pmod("event_id", F.lit(97)) == 0, "redundant with another").when(F.pmod("event_id", F.lit(5)) == 0, "point mass at zero").otherwise("odd")
    return read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("category"), text.alias("note"), "event_id")


@query("note_counts", f"WITH {_NOTES} SELECT category, count(DISTINCT id) AS n FROM nt GROUP BY category")
def _(spark, d):
    return review.note_counts(_notes(spark, d))


@query("suggestions", """WITH nt AS (SELECT user_id * 100 + event_id % 40 AS id, event_type AS category, CASE WHEN event_id % 97 = 0 THEN 'redundant with another' WHEN event_id % 5 = 0 THEN 'point mass at zero' ELSE 'odd' END AS note FROM events), g AS (SELECT id, list(DISTINCT category) AS c, list(note) AS n FROM nt GROUP BY id)
 SELECT id, CASE WHEN id IN (101, 205) OR list_has_all(['click', 'view'], c) OR (list_contains(c, 'purchase') AND list_contains(n, 'point mass at zero')) THEN 'keep' WHEN list_contains(n, 'redundant with another') THEN 'drop' ELSE 'fix' END AS suggestion FROM g""")
def _(spark, d):
    notes = _notes(spark, d).withColumn("id", F.col("id") * 100 + F.pmod("event_id", F.lit(40)))
    return review.suggestions(notes, [101, 205], ["click", "view"], {"purchase": "point mass"}, ["redundant with"])


@query("map_hits", "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE label IN (1, 3)), c AS (SELECT * FROM (VALUES (1, 0.0, 0.0), (2, 0.5, -0.25), (3, 9.0, 9.0)) AS c(click, cx, cy)), q AS (SELECT click, id, row_number() OVER (PARTITION BY click ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), id) AS o FROM p, c) SELECT CAST(click AS BIGINT) AS click, id FROM q WHERE o = 1")
def _(spark, d):
    at = lambda i: F.element_at("embedding", i).cast("double")
    points = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), at(1).alias("x"), at(2).alias("y"), F.col("label").isin(1, 3).alias("lit"))
    return review.map_hits(points, {1: (0, 0), 2: (0.5, -0.25), 3: (9, 9)})


@query("previews", f"WITH {META}, f AS (SELECT cls, family, min(id) AS ord FROM meta GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY ord) - 1 AS pos, greatest(1, floor(count(*) OVER (PARTITION BY cls) / 3)) AS step FROM f) SELECT cls, family FROM o WHERE pos % step = 0 AND pos / step < 3")
def _(spark, d):
    return review.previews(series_meta(spark, d).groupBy("cls", "family").agg(F.min("id").alias("ord")))


# ---- generators ---------------------------------------------------------------------------------------------


def _declared(profile: str) -> str:
    """Every family of a profile with its quota and no series that breaks a rule."""
    from tideloom.generators import registry

    rows = ", ".join(f"('{g.cls}', '{g.key}', {g.quota[profile]}, 0, 0, 0, 0)" for g in registry.load().values() if g.quota[profile])
    return f"SELECT cls, family, CAST(n AS BIGINT) AS n, CAST(a AS BIGINT) AS n_failed, CAST(b AS BIGINT) AS n_wrong_values, CAST(c AS BIGINT) AS n_mean_drift, CAST(d AS BIGINT) AS n_variance_drift FROM (VALUES {rows}) AS v(cls, family, n, a, b, c, d)"


def breaches(spark, profile: str, classes: list[str] | None = None):
    """Generates all series of a profile (or of some classes) and counts, by family, those that break the profile's rules, in DataFrame functions."""
    from tideloom.generators import tables

    made = tables.generate(tables.selection(spark, profile, classes), profile=profile)
    strict = F.lit(profile == "stationary1000")
    values = F.array_distinct(F.transform("x", lambda v: v))
    odd = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) > 1e12)) | (F.size("x") != 1000) | (F.size(values) < F.when(F.col("discrete_valued") == "yes", 2).otherwise(F.when(strict, 100).otherwise(10))) | (strict & (F.col("discrete_valued") == "yes"))
    windows = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda w: F.slice("x", w * 200 + 1, 200))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    sd = lambda a: F.sqrt(mean(F.transform(a, lambda v: (v - mean(a)) * (v - mean(a)))))
    stats = made.select("cls", "family", "error", "deterministic", F.col("error").isNull().alias("made"), odd.alias("odd"), sd(F.col("x")).alias("sd"), F.transform(windows, mean).alias("m"), F.transform(windows, sd).alias("s"), (F.col("stationary") != "no").alias("settled"), ((F.col("bursty") == "yes") | (F.col("event_like") == "yes")).alias("exempt"))
    tight = F.col("cls").isin("F", "G", "H", "L") & F.col("deterministic").isin("yes", "partly")
    held = strict & F.col("made") & F.col("settled")
    wild = (sd(F.col("s")) > F.when(tight, 0.3).otherwise(0.5) * F.col("sd")) | (F.pow(F.array_max("s"), 2) > F.when(tight, 6.0).otherwise(20.0) * F.greatest(F.pow(F.array_min("s"), 2), F.lit(1e-12)))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return stats.groupBy("cls", "family").agg(F.count("*").alias("n"), count(~F.col("made")).alias("n_failed"), count(F.col("made") & F.col("odd")).alias("n_wrong_values"), count(held & (sd(F.col("m")) > 0.5 * F.col("sd"))).alias("n_mean_drift"), count(held & ~F.col("exempt") & wild).alias("n_variance_drift"))


def _quotas(profile: str) -> str:
    from tideloom.generators import registry

    have = ", ".join(f"('{g.cls}', {g.quota[profile]})" for g in registry.load().values())
    want = ", ".join(f"('{c}', {n})" for c, n in registry.DECLARED[profile].items())
    return f"SELECT cls, CAST(coalesce(h, 0) AS BIGINT) AS registered, CAST(w AS BIGINT) AS declared, CAST(coalesce(h, 0) - w AS BIGINT) AS gap FROM (VALUES {want}) AS v(cls, w) LEFT JOIN (SELECT cls, sum(n) AS h FROM (VALUES {have}) AS u(cls, n) GROUP BY cls) USING (cls)"


@query("quotas_full", _quotas("full"))
def _(spark, d):
    from tideloom.plans import lifecycle

    return lifecycle.quotas(spark, "full")


@query("quotas_stationary1000", _quotas("stationary1000"))
def _(spark, d):
    from tideloom.plans import lifecycle

    return lifecycle.quotas(spark, "1000x1000")


@query("profile_stationary1000", _declared("stationary1000"))
def _(spark, d):
    """All series of the stationary profile, held against its quotas and gates."""
    return breaches(spark, "stationary1000")


@query("profile_full", _declared("full"))
def _(spark, d):
    """All series of the full profile, held against its quotas and the validity gate."""
    return breaches(spark, "full")


# ---- SQL of queries that the catalogue registers without ----------------------------------------------------

_TWO_PI = repr(2 * math.pi)
#: All twelve issues. A flat head needs over 15 steps in the first twentieth, that is 16 samples there.
_FULL = f"""{SCREEN[: SCREEN.index("sc AS (SELECT")]} dc AS (SELECT id, t, v - avg(v) OVER (PARTITION BY id) AS z, count(*) OVER (PARTITION BY id) AS n FROM s), dw AS (SELECT id, n, t, z, unnest(range(1, CAST(floor(n / 2) AS BIGINT) + 1)) AS k FROM dc WHERE n >= 2),
 dp AS (SELECT id, n, k, pow(sum(z * cos({_TWO_PI} * k * t / n)), 2) + pow(sum(z * sin({_TWO_PI} * k * t / n)), 2) AS power FROM dw GROUP BY ALL),
 dq AS (SELECT id, n, k, sum(power) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, sum(power) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY round(power, 6) DESC, k) AS o FROM dp),
 pe AS (SELECT id, k AS periods, CAST(round_even(n / k, 0) AS BIGINT) AS lag, near / total AS share FROM dq WHERE o = 1),
 ag AS (SELECT a.id, sum(a.z * b.z) / max(e) AS again FROM dc a JOIN pe ON pe.id = a.id JOIN dc b ON b.id = a.id AND b.t = a.t + lag JOIN (SELECT id, sum(z * z) AS e FROM dc GROUP BY id) x ON x.id = a.id WHERE lag BETWEEN 2 AND 299 AND e > 0 GROUP BY a.id),
 st AS (SELECT id, max(d) AS step, quantile_cont(d, 0.99) AS step99 FROM (SELECT id, abs(v - lag(v) OVER (PARTITION BY id ORDER BY t)) AS d FROM s) GROUP BY id),
 hf AS (SELECT id, sum(flat::INT) AS run FROM (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY t) AS g FROM (SELECT id, t, n, coalesce(abs(v - lag(v) OVER (PARTITION BY id ORDER BY t)) < 1e-6 * CASE WHEN sd = 0 THEN 1 ELSE sd END, false) AS flat FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, stddev_pop(v) OVER (PARTITION BY id) AS sd FROM s)) WHERE t < floor(n / 20)) GROUP BY id, g), hd AS (SELECT id, max(run) AS head_run FROM hf GROUP BY id),
 {FE}, fz AS (SELECT id, j, greatest(least((v - med) / iqr, 10), -10) AS z FROM w JOIN q USING (j)), fg AS (SELECT id, family AS grp, list(z ORDER BY j) AS f FROM fz JOIN meta USING (id) GROUP BY id, family),
 fp AS (SELECT a.grp, a.id AS a, b.id AS b, list_distance(a.f, b.f) AS d FROM fg a JOIN fg b ON a.grp = b.grp AND a.id < b.id), fl2 AS (SELECT grp, 0.15 * median(d) AS m, count(*) AS n FROM fp GROUP BY grp), du AS (SELECT DISTINCT unnest([a, b]) AS id FROM fp JOIN fl2 USING (grp) WHERE n >= 3 AND d < m),
 sc AS (SELECT al.id, family, tau > 6 OR coalesce(share > 0.3 AND periods < 35, false) AS slow, NOT (event_like = 'yes' OR bursty = 'yes') AND (sm > 0.35 OR ss > 0.35 OR vr > 8) AS drift, coalesce(abs(hm - mm) > md OR NOT (hs / md > 0.3 AND hs / md < 3), false) OR coalesce(head_run > 15, false) AS onset, coalesce(abs(tm - mm) > md OR NOT (tsd / md > 0.3 AND tsd / md < 3), false) AS ending,
 run > 30 AND common / n <= 0.2 AS flat, (hi - lo) / greatest(q9 - q1, 1e-12) > 3 AS spiky, k < 200 OR common / n > 0.4 AS levels, event_like = 'yes' AND n_events < 25 AS few_events, coalesce(cls <> 'H' AND again > 0.95, false) AS periodic, coalesce(share > 0.8, false) AS sinusoid, coalesce(al.id % 6 = 0 AND step > 12 * greatest(step99, 1e-12), false) AS jumps, du.id IS NOT NULL AS duplicate
 FROM al LEFT JOIN pe ON pe.id = al.id LEFT JOIN ag ON ag.id = al.id LEFT JOIN st ON st.id = al.id LEFT JOIN hd ON hd.id = al.id LEFT JOIN du ON du.id = al.id),
 scr AS (SELECT *, CAST(slow::INT + drift::INT + onset::INT + ending::INT + flat::INT + spiky::INT + levels::INT + few_events::INT + periodic::INT + sinusoid::INT + jumps::INT + duplicate::INT AS BIGINT) AS n_issues FROM sc)"""
ORACLE_SQL["screen_full"] = f"WITH {_FULL} SELECT * FROM scr"
ORACLE_SQL["screen_full_summary"] = f"WITH {_FULL} SELECT family, count(*) AS series, CAST(sum((n_issues > 0)::INT) AS BIGINT) AS flagged, CAST(sum(n_issues) AS BIGINT) AS issues FROM scr GROUP BY family"


def _families() -> str:
    from tideloom.generators import registry

    rows = ", ".join(f"('{g.cls}', '{g.key}', '{p}', {g.quota[p]})" for g in registry.load().values() for p in registry.PROFILES)
    return f"SELECT cls, family, profile, CAST(n AS BIGINT) AS n FROM (VALUES {rows}) AS v(cls, family, profile, n)"


ORACLE_SQL["families"] = _families()
