"""Operators on metadata rows: selection, search, grouping, tags, sampling and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.columns import uniform
from tideloom.operators import series as S
from tideloom.operators import similarity


def subset(df: DataFrame, where: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows where every named column, as text, is one of its values; unknown columns raise KeyError."""
    for column in where:
        if column not in df.columns:
            raise KeyError(column)
    return df.filter(reduce(lambda a, b: a & b, (F.col(c).cast("string").isin(list(v)) for c, v in where.items()), F.lit(True)))


def chip_filter(df: DataFrame, tags: Mapping[str, str], text: Column, query: str) -> DataFrame:
    """Rows with all tags present and the query in the text, whatever its case."""
    has = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in tags.items()), F.lit(True))
    return df.filter(has & F.contains(F.lower(text), F.lit(query.lower())))


def chip_counts(df: DataFrame, tags: Sequence[str], absent: Sequence[str] = ("no", "na", "none")) -> DataFrame:
    """(chip, n) of the tag values present, without those that every row has."""
    chips = F.explode(F.array(*(F.concat(F.lit(t + ":"), F.col(t)) for t in tags)))
    total = df.agg(F.count("*").alias("total"))
    counts = df.select(chips.alias("chip")).filter(~F.substring_index("chip", ":", -1).isin(list(absent))).groupBy("chip").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total), how="cross").filter("n < total").select("chip", "n")


def ranked_search(entries: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(label, kind, score): the best entries whose text holds all words. entries: kind, label, text.

    100 for a label that starts with the query, 70 that holds it, 55 that holds all words, else 20; classes add 6, processes 4.
    """
    query = " ".join(query.lower().split())
    words = query.split(" ")
    label, text = F.lower("label"), F.lower("text")
    all_in = lambda c: reduce(lambda a, b: a & b, (F.contains(c, F.lit(w)) for w in words))
    score = F.when(label.startswith(query), 100).when(F.contains(label, F.lit(query)), 70).when(all_in(label), 55).otherwise(20)
    score = score + F.when(F.col("kind") == "Class", 6).when(F.col("kind") == "Process", 4).otherwise(0)
    return entries.filter(all_in(text)).select("label", "kind", score.cast("long").alias("score")).orderBy(F.desc("score"), "label", "kind").limit(limit)


def top_and_rest(df: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(grp, n): counts by key; beyond `most` groups the top `most` - 1 and one `other`."""
    counts = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    # counts are few rows: one for each group
    ranked = counts.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "k"))).withColumn("groups", F.count("*").over(Window.partitionBy()))
    name = F.when((F.col("groups") <= most) | (F.col("r") < most), F.col("k")).otherwise("other")
    return ranked.groupBy(name.alias("grp")).agg(F.sum("n").alias("n"))


def tag_fraction(df: DataFrame, by: str, tags: Sequence[str]) -> DataFrame:
    """(by, tag, fraction): share of rows with `yes`, by group."""
    long = df.select(by, F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).alias("value")) for t in tags))).alias("x"))
    return long.groupBy(by, F.col("x.tag").alias("tag")).agg(F.avg(F.when(F.col("x.value") == "yes", 1.0).otherwise(0.0)).alias("fraction"))


def keywords(df: DataFrame, tags: Sequence[str]) -> Column:
    """The names of the tags that are yes, joined by commas."""
    return F.concat_ws(",", *(F.when(F.col(t) == "yes", F.lit(t)) for t in tags))


def merge_tags(info: Column, family: Column, default: str) -> Column:
    """A series' own value, else its family's, else the default."""
    return F.coalesce(info, family, F.lit(default))


def group_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def by_class(df: DataFrame, cls: str, family: str, order: str) -> DataFrame:
    """(cls, families): each class's families in order, joined by commas."""
    first = df.groupBy(cls, family).agg(F.min(order).alias("o"))
    return first.groupBy(F.col(cls).alias("cls")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", family))), lambda x: x[family]), ",").alias("families"))


def quota_report(families: DataFrame, declared: Mapping[str, int]) -> DataFrame:
    """(cls, registered, declared, gap) from families: cls, n."""
    spark = families.sparkSession
    want = spark.createDataFrame(list(declared.items()), "cls string, declared long")
    have = families.groupBy("cls").agg(F.sum("n").cast("long").alias("registered"))
    return want.join(have, "cls", "full").select("cls", F.coalesce("registered", F.lit(0)).cast("long").alias("registered"), F.coalesce("declared", F.lit(0)).cast("long").alias("declared")).withColumn("gap", F.col("registered") - F.col("declared"))


def rollup_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts and means over all prefixes of the keys; `total` stands for a key rolled up."""
    out = df.rollup(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(*(F.coalesce(F.col(k).cast("string"), F.lit("total")).alias(k) for k in keys), "n", "mean")


def seeded_sample(df: DataFrame, seed: str, key: str, by: str, per_group: int) -> DataFrame:
    """`per_group` rows of each group, drawn by hash of seed and key: the same rows for any order and partitions."""
    return group_limit(df, by, [uniform(F.lit(seed), F.col(key).cast("string")), F.col(key)], per_group)


def group_limit(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def strata(df: DataFrame, seed: str, key: str, by: str) -> DataFrame:
    """(key, stratum, n): a Latin-hypercube stratum of each row in its group, a permutation by hash."""
    order = Window.partitionBy(by).orderBy(uniform(F.lit(seed), F.col(key).cast("string")), key)
    return df.select(key, by, (F.row_number().over(order) - 1).cast("long").alias("stratum"), F.count("*").over(Window.partitionBy(by)).alias("n"))


def audit_stationarity(series: DataFrame, meta: DataFrame) -> DataFrame:
    """(family, n, max_sm, max_ss, flagged) over the window statistics."""
    flagged = (F.col("sm") > 0.5) | (F.col("ss") > 0.35) | (F.col("vr") > 10)
    return S.window_stationarity(series).join(meta, "id").groupBy("family").agg(F.count("*").alias("series"), F.max("sm").alias("max_sm"), F.max("ss").alias("max_ss"), F.sum(flagged.cast("long")).alias("flagged"))


def audit_quantiles(series: DataFrame, at: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(statistic, q, value) of the window statistics of all series."""
    stats = S.window_stationarity(series).agg(*(F.percentile(c, list(at)).alias(c) for c in ("sm", "ss", "vr")))
    long = stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).alias("v")) for c in ("sm", "ss", "vr")))).alias("x"))
    return long.select("x.statistic", F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), F.col("x.v").alias("value"))).alias("y")).select("statistic", F.col("y.q").alias("q"), F.col("y.value").alias("value"))


def audit_length(series: DataFrame, meta: DataFrame, most_lag: int = 500) -> DataFrame:
    """(family, series, tau_med, tau_max, spans_min, events_min, distinct_min): length in correlation times, events and distinct values by family.

    Series without variance have an infinite correlation time and span none; spans_min under 20 marks a family as too short.
    """
    flat = series.groupBy("id").agg((F.min("v") == F.max("v")).alias("flat"))
    tau = S.acf_time(series, most_lag).join(flat, "id").select("id", F.when(F.col("flat"), float("inf")).otherwise(F.col("tau")).alias("tau"))
    return _lengths(series, meta, tau)


def audit_length_browser(series: DataFrame, meta: DataFrame, most_lag: int = 40) -> DataFrame:
    """audit_length with the browser's correlation time, at most `most_lag`, also for series without variance."""
    return _lengths(series, meta, S.acf_time(series, most_lag))


def _lengths(series: DataFrame, meta: DataFrame, tau: DataFrame) -> DataFrame:
    size = series.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("v").alias("k"))
    all_ = size.join(tau, "id").join(S.excursions(series), "id").join(meta, "id")
    return all_.groupBy("family").agg(
        F.count("*").alias("series"), F.percentile("tau", 0.5).alias("tau_med"), F.max("tau").alias("tau_max"), F.min(F.col("n") / F.col("tau")).alias("spans_min"), F.min("n_events").alias("events_min"), F.min("k").alias("distinct_min")
    )


def screen(series: DataFrame, meta: DataFrame, profiles: DataFrame | None = None, levels: int = 200, few_events: int = 25) -> DataFrame:
    """One row a series: the twelve issue flags of the reference's screen and their number.

    meta: id, cls, family, event_like, bursty, continuous_time. profiles: id, f, a feature vector a series; without them
    nothing is a duplicate. Ten windows; head and tail are a twentieth of the series. The defaults, least distinct
    values and least events, are those for 1000 samples.
    """
    out = _screened(series, meta)
    period = S.dominant_period(series).select("id", F.col("k").alias("periods"), F.rint("period").cast("long").alias("lag"))
    again = S.acf(series, 299).join(period, "id").filter("k = lag AND lag >= 2").select("id", F.col("r").alias("again"))
    steps = series.select("id", F.abs(F.col("v") - F.lag("v").over(S.in_order())).alias("d")).groupBy("id").agg(F.max("d").alias("step"), F.percentile("d", 0.99).alias("step99"))
    head = S.longest_flat(series, 1e-6, 20).withColumnRenamed("run", "head_run")
    for more in (period, S.spectral_peak(series).drop("peaked"), again, steps, head):
        out = out.join(more, "id", "left")
    flags = _eight(levels, few_events)
    flags["slow"] = flags["slow"] | F.coalesce((F.col("share") > 0.3) & (F.col("periods") < 35), F.lit(False))
    flags["onset"] = F.coalesce(flags["onset"], F.lit(False)) | F.coalesce(F.col("head_run") > 15, F.lit(False))
    flags["periodic"] = (F.col("cls") != "H") & (F.col("again") > 0.95)
    flags["sinusoid"] = F.col("share") > 0.8
    flags["jumps"] = (F.col("continuous_time") == "yes") & (F.col("step") > 12 * F.greatest("step99", F.lit(1e-12)))
    if profiles is None:
        flags["duplicate"] = F.lit(False)
    else:
        pairs = similarity.duplicate_pairs(profiles.select("id", "f").join(meta.select("id", F.col("family").alias("grp")), "id"))
        out = out.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("double", F.lit(True)), "id", "left")
        flags["duplicate"] = F.col("double")
    return _counted(out, flags)


def screen_short(series: DataFrame, meta: DataFrame) -> DataFrame:
    """The screen's eight issues that short series can show, with thresholds for under 100 samples: 40 values, 2 events.

    Without periodic, sinusoid, jumps, duplicate, few slow periods and a flat head.
    """
    return _counted(_screened(series, meta), _eight(40, 2))


def _screened(series: DataFrame, meta: DataFrame) -> DataFrame:
    """The statistics of both screens. meta: id, cls, event_like, bursty."""
    numbered = series.withColumn("n", F.count("*").over(S.by_id()))
    edge = F.floor(F.col("n") / 20)
    part = F.when(F.col("t") < edge, "head").when(F.col("t") >= F.col("n") - edge, "tail").otherwise("mid")
    ends = numbered.groupBy("id").agg(
        F.max("n").alias("n"), F.stddev_pop("v").alias("sd"), F.max("v").alias("hi"), F.min("v").alias("lo"), F.percentile("v", [0.01, 0.99]).alias("q"), F.countDistinct("v").alias("k"),
        *(f(F.when(part == p, F.col("v"))).alias(f"{p}_{name}") for p in ("head", "mid", "tail") for name, f in (("m", F.avg), ("s", F.stddev_pop)))
    )
    common = series.groupBy("id", "v").agg(F.count("*").alias("c")).groupBy("id").agg(F.max("c").alias("common"))
    return ends.join(S.window_stationarity(series, 10).drop("n"), "id").join(S.acf_time(series), "id").join(S.longest_flat(series, 1e-6), "id").join(S.excursions(series, 3.0), "id").join(common, "id").join(meta, "id")


def _eight(levels: int, few_events: int) -> dict[str, Column]:
    event = (F.col("event_like") == "yes") | (F.col("bursty") == "yes")
    mid = F.when(F.col("mid_s") == 0, 1.0).otherwise(F.col("mid_s"))
    off = lambda p: (F.abs(F.col(f"{p}_m") - F.col("mid_m")) > mid) | ~((F.col(f"{p}_s") / mid > 0.3) & (F.col(f"{p}_s") / mid < 3))
    return {
        "slow": F.col("tau") > 6,
        "drift": ~event & ((F.col("sm") > 0.35) | (F.col("ss") > 0.35) | (F.col("vr") > 8)),
        "onset": off("head"),
        "ending": off("tail"),
        "flat": (F.col("run") > 30) & (F.col("common") / F.col("n") <= 0.2),
        "spiky": (F.col("hi") - F.col("lo")) / F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-12)) > 3,
        "levels": (F.col("k") < levels) | (F.col("common") / F.col("n") > 0.4),
        "few_events": (F.col("event_like") == "yes") & (F.col("n_events") < few_events),
    }


def _counted(out: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    out = out.select("id", "family", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()))
    return out.withColumn("n_issues", reduce(lambda a, b: a + b, (F.col(k).cast("long") for k in flags)))


def screen_summary(screened: DataFrame) -> DataFrame:
    """(family, series, flagged, issues)."""
    return screened.groupBy("family").agg(F.count("*").alias("series"), F.sum((F.col("n_issues") > 0).cast("long")).alias("flagged"), F.sum("n_issues").alias("issues"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with the last `value` of right at or before each row's time: one union and one window, no range join."""
    tagged = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).alias("_v")).unionByName(right.select(by, at, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn(value, F.last("_v", ignorenulls=True).over(order)).filter("_side = 1").drop("_side", "_v")
