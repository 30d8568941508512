"""Operators on long series (id, t, v): transforms, statistics, spectra and gates.

Every operator partitions by id and keeps all other work inside that one shuffle where
it can. Zero variance counts as a deviation of 1, as in the reference semantics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_id() -> WindowSpec:
    return Window.partitionBy("id")


def in_order() -> WindowSpec:
    return by_id().orderBy("t")


def to_arrays(series: DataFrame) -> DataFrame:
    """(id, x): values in order."""
    return series.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("p")).select("id", F.transform("p", lambda p: p["v"]).alias("x"))


def to_long(arrays: DataFrame) -> DataFrame:
    return arrays.select("id", F.posexplode("x").alias("t", "v")).withColumn("t", F.col("t").cast("long"))


def _sd(column: Column) -> Column:
    return F.when(column == 0, 1.0).otherwise(column)


# ---- gates -------------------------------------------------------------------------------------------------


def window_stationarity(series: DataFrame, windows: int = 5) -> DataFrame:
    """(id, n, sm, ss, vr): spread of window means and deviations in units of the whole, and the largest ratio of variances.

    The tail that does not fill a window is left out of the windows but not of the whole.
    """
    numbered = series.withColumn("n", F.count("*").over(by_id())).withColumn("sd", F.stddev_pop("v").over(by_id()))
    width = F.floor(F.col("n") / windows)
    part = numbered.withColumn("w", F.floor(F.col("t") / width)).filter(F.col("w") < windows)
    stats = part.groupBy("id", "n", "sd", "w").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    out = stats.groupBy("id", "n", "sd").agg(F.stddev_pop("m").alias("a"), F.stddev_pop("s").alias("b"), F.max("s").alias("hi"), F.min("s").alias("lo"))
    return out.select("id", "n", (F.col("a") / _sd(F.col("sd"))).alias("sm"), (F.col("b") / _sd(F.col("sd"))).alias("ss"), (F.col("hi") * F.col("hi") / F.greatest(F.col("lo") * F.col("lo"), F.lit(1e-12))).alias("vr"))


def stationarity_gate(series: DataFrame, meta: DataFrame) -> DataFrame:
    """(id, verdict): ok, mean or variance. meta: id, cls, event_like, bursty, deterministic."""
    tight = F.col("cls").isin("F", "G", "H", "L") & F.col("deterministic").isin("yes", "partly")
    exempt = (F.col("event_like") == "yes") | (F.col("bursty") == "yes")
    most_s, most_v = F.when(tight, 0.3).otherwise(0.5), F.when(tight, 6.0).otherwise(20.0)
    verdict = F.when(F.col("sm") > 0.5, "mean").when(~exempt & ((F.col("ss") > most_s) | (F.col("vr") > most_v)), "variance").otherwise("ok")
    return window_stationarity(series).join(meta, "id").select("id", verdict.alias("verdict"))


def validity_gate(series: DataFrame, meta: DataFrame) -> DataFrame:
    """(id, reason): the first reason against a series, null if none. meta: id, discrete."""
    bad = F.max((F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).cast("int"))
    stats = series.groupBy("id").agg(bad.alias("bad"), F.max(F.abs("v")).alias("top"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.countDistinct("v").alias("k"))
    reason = F.when(F.col("bad") == 1, "non-finite").when(F.col("top") > 1e12, "overflow").when(F.col("lo") == F.col("hi"), "constant")
    reason = reason.when((F.col("discrete") != "yes") & (F.col("k") < 10), "few values").when((F.col("discrete") == "yes") & (F.col("k") < 2), "single-valued")
    return stats.join(meta, "id").select("id", F.col("k").alias("n_distinct"), reason.alias("reason"))


def real_valued_gate(series: DataFrame, meta: DataFrame, least: int = 100) -> DataFrame:
    """(id, reason): discrete, few distinct values, or a periodic map or flow; null if none. meta: id, cls, discrete, periodic."""
    stats = series.groupBy("id").agg(F.countDistinct("v").alias("k"))
    reason = F.when(F.col("discrete") == "yes", "discrete").when(F.col("k") < least, "few values").when(F.col("cls").isin("F", "G") & (F.col("periodic") == "yes"), "periodic")
    return stats.join(meta, "id").select("id", reason.alias("reason"))


# ---- correlation and spectra -------------------------------------------------------------------------------


def acf(series: DataFrame, lags: int) -> DataFrame:
    """(id, k, r): biased autocorrelation at lags 1..lags; 0 for constant series."""
    centred = series.select("id", "t", (F.col("v") - F.avg("v").over(by_id())).alias("z"))
    ahead = centred.select("id", "t", "z", F.collect_list("z").over(in_order().rowsBetween(1, lags)).alias("next"))
    sums = ahead.select("id", F.posexplode("next").alias("k", "y"), "z").groupBy("id", (F.col("k") + 1).cast("long").alias("k")).agg(F.sum(F.col("z") * F.col("y")).alias("c"))
    total = centred.groupBy("id").agg(F.sum(F.col("z") * F.col("z")).alias("c0"))
    return sums.join(total, "id").select("id", "k", F.when(F.col("c0") > 0, F.col("c") / F.col("c0")).otherwise(0.0).alias("r"))


def acf_time(series: DataFrame, most: int = 40) -> DataFrame:
    """(id, tau): the first lag below `most` with autocorrelation under 1/e, else `most`.

    40 is the browser's limit; the audit of lengths searches 500 lags.
    """
    first = acf(series, most - 1).groupBy("id").agg(F.min(F.when(F.col("r") < math.exp(-1), F.col("k"))).alias("k"))
    flat = series.groupBy("id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return flat.join(first, "id", "left").select("id", F.when(F.col("lo") == F.col("hi"), most).otherwise(F.coalesce("k", F.lit(most))).cast("long").alias("tau"))


def dft(series: DataFrame) -> DataFrame:
    """(id, n, k, power): squared modulus of the transform of the centred series at k = 1..n/2.

    Each value meets its series' own frequencies through an exploded sequence, not a join; sums
    combine on the map side. For series too long for n^2/2 terms use fft_power.
    """
    centred = series.select("id", "t", (F.col("v") - F.avg("v").over(by_id())).alias("z"), F.count("*").over(by_id()).alias("n"))
    wide = centred.filter("n >= 2").select("id", "n", "t", "z", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))).alias("k"))
    angle = 2 * math.pi * F.col("k") * F.col("t") / F.col("n")
    out = wide.groupBy("id", "n", "k").agg(F.sum(F.col("z") * F.cos(angle)).alias("a"), F.sum(F.col("z") * F.sin(angle)).alias("b"))
    return out.select("id", "n", F.col("k").cast("long").alias("k"), (F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("power"))


def dominant_period(series: DataFrame) -> DataFrame:
    """(id, k, period) of the largest power, the smallest k on ties."""
    top = dft(series).groupBy("id", "n").agg(F.min_by("k", F.struct(-F.round("power", 6), F.col("k"))).alias("k"))
    return top.select("id", "k", (F.col("n") / F.col("k")).alias("period"))


def spectral_peak(series: DataFrame, share: float = 0.25, reach: int = 2) -> DataFrame:
    """(id, share, peaked): part of the power within `reach` bins of the largest."""
    power = dft(series)
    by_k = Window.partitionBy("id").orderBy("k").rowsBetween(-reach, reach)
    near = power.withColumn("near", F.sum("power").over(by_k))
    out = near.groupBy("id").agg(F.min_by("near", F.struct(-F.round("power", 6), F.col("k"))).alias("near"), F.sum("power").alias("total"))
    part = F.when(F.col("total") > 0, F.col("near") / F.col("total")).otherwise(0.0)
    return out.select("id", part.alias("share"), (part > share).alias("peaked"))


def welch(series: DataFrame, length: int = 256) -> DataFrame:
    """(id, k, psd, segments): Hann-windowed, mean-removed, half-overlapping segments, averaged."""
    half = length // 2
    counted = series.withColumn("n", F.count("*").over(by_id()))
    starts = F.array(F.floor(F.col("t") / half).cast("long"), (F.floor(F.col("t") / half) - 1).cast("long"))
    seg = counted.select("id", "t", "v", "n", F.explode(starts).alias("s")).filter((F.col("s") >= 0) & (F.col("s") * half + length <= F.col("n")))
    seg = seg.withColumn("j", F.col("t") - F.col("s") * half).withColumn("z", F.col("v") - F.avg("v").over(Window.partitionBy("id", "s")))
    weight = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("j") / (length - 1))
    norm = sum((0.5 - 0.5 * math.cos(2 * math.pi * i / (length - 1))) ** 2 for i in range(length))
    seg = seg.select("id", "s", "j", (F.col("z") * weight).alias("z"), F.explode(F.sequence(F.lit(1), F.lit(half))).alias("k"))
    angle = 2 * math.pi * F.col("k") * F.col("j") / length
    power = seg.groupBy("id", "s", "k").agg(F.sum(F.col("z") * F.cos(angle)).alias("a"), F.sum(F.col("z") * F.sin(angle)).alias("b"))
    psd = (F.col("a") * F.col("a") + F.col("b") * F.col("b")) / norm
    return power.groupBy("id", F.col("k").cast("long").alias("k")).agg(F.avg(psd).alias("psd"), F.count("*").alias("segments"))


# ---- point transforms --------------------------------------------------------------------------------------


def zscore(series: DataFrame) -> DataFrame:
    return series.select("id", "t", ((F.col("v") - F.avg("v").over(by_id())) / _sd(F.stddev_pop("v").over(by_id()))).alias("z"))


def clip(series: DataFrame, c: float) -> DataFrame:
    """Saturates at the mean plus and minus c deviations."""
    m, s = F.avg("v").over(by_id()), F.stddev_pop("v").over(by_id())
    return series.select("id", "t", F.least(F.greatest("v", m - c * s), m + c * s).alias("v"))


def quantise(series: DataFrame, levels: int) -> DataFrame:
    """(id, t, level): how many of the equal-probability cuts lie below the value."""
    cuts = series.groupBy("id").agg(F.percentile("v", [i / levels for i in range(1, levels)]).alias("cuts"))
    return series.join(cuts, "id").select("id", "t", F.size(F.filter("cuts", lambda c: c < F.col("v"))).cast("long").alias("level"))


def minmax_u8(series: DataFrame) -> DataFrame:
    lo, hi = F.min("v").over(by_id()), F.max("v").over(by_id())
    return series.select("id", "t", F.when(hi > lo, F.floor(255 * (F.col("v") - lo) / (hi - lo) + 0.5)).otherwise(0).cast("long").alias("u8"))


def integrate(series: DataFrame) -> DataFrame:
    """Running sum of the centred series."""
    centred = series.select("id", "t", (F.col("v") - F.avg("v").over(by_id())).alias("z"))
    return centred.select("id", "t", F.sum("z").over(in_order().rowsBetween(Window.unboundedPreceding, 0)).alias("v"))


def moving_average(series: DataFrame, reach: int) -> DataFrame:
    return series.select("id", "t", F.avg("v").over(in_order().rowsBetween(-reach, reach)).alias("v"))


def downsample(series: DataFrame, k: int) -> DataFrame:
    """Every k-th sample, renumbered."""
    return series.filter(F.col("t") % k == 0).select("id", F.floor(F.col("t") / k).cast("long").alias("t"), "v")


def readout(series: DataFrame) -> DataFrame:
    """Nonlinear readouts of the standardised series: square, absolute value, exponential, cube, product with the last value."""
    z = zscore(series)
    last = F.lag("z").over(in_order())
    return z.select("id", "t", (F.col("z") * F.col("z")).alias("square"), F.abs("z").alias("size"), F.exp(F.col("z") / 2).alias("exp_half"), F.pow("z", F.lit(3.0)).alias("cube"), (F.col("z") * last).alias("lagged"))


def outliers(series: DataFrame, c: float = 4.0) -> DataFrame:
    """(id, t, deviation, far): distance from the median in median absolute deviations (the deviation, or 1, where that is 0)."""
    centre = series.groupBy("id").agg(F.percentile("v", 0.5).alias("med"), F.stddev_pop("v").alias("sd"))
    dev = series.join(centre, "id").withColumn("d", F.abs(F.col("v") - F.col("med")))
    mad = dev.groupBy("id").agg(F.percentile("d", 0.5).alias("mad"))
    scale = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return dev.join(mad, "id").select("id", "t", (F.col("d") / scale).alias("deviation"), (F.col("d") > c * scale).alias("far"))


def excursions(series: DataFrame, c: float = 4.0) -> DataFrame:
    """(id, n_events): rises of `far` (not at the first sample)."""
    far = outliers(series, c)
    rise = F.col("far") & ~F.lag("far").over(in_order())
    return far.select("id", F.coalesce(rise, F.lit(False)).alias("rise")).groupBy("id").agg(F.sum(F.col("rise").cast("long")).alias("n_events"))


def crossings(series: DataFrame) -> DataFrame:
    """(id, n_crossings): changes of sign of the centred series."""
    sign = series.select("id", "t", F.signum(F.col("v") - F.avg("v").over(by_id())).alias("s"))
    change = F.when(F.col("s") != F.lag("s").over(in_order()), 1).otherwise(0)
    return sign.select("id", change.alias("c")).groupBy("id").agg(F.sum("c").alias("n_crossings"))


def longest_flat(series: DataFrame, tolerance: float, head: int | None = None) -> DataFrame:
    """(id, run): most consecutive steps smaller than `tolerance` deviations; with `head`, in the first 1 / `head` of the series."""
    step = series.select("id", "t", F.count("*").over(by_id()).alias("n"), (F.abs(F.col("v") - F.lag("v").over(in_order())) < tolerance * _sd(F.stddev_pop("v").over(by_id()))).alias("flat"))
    if head is not None:
        step = step.filter(F.col("t") < F.floor(F.col("n") / head))
    run = step.select("id", F.coalesce("flat", F.lit(False)).alias("flat"), F.sum(F.when(F.col("flat"), 0).otherwise(1)).over(in_order()).alias("g"))
    return run.groupBy("id", "g").agg(F.sum(F.col("flat").cast("long")).alias("run")).groupBy("id").agg(F.max("run").alias("run"))


def ma_filter(series: DataFrame, theta: list[float]) -> DataFrame:
    """x[t] + sum theta[k] x[t-k]; missing lags are 0."""
    value = F.col("v")
    for k, th in enumerate(theta, 1):
        value = value + th * F.coalesce(F.lag("v", k).over(in_order()), F.lit(0.0))
    return series.select("id", "t", value.alias("v"))


def lag_products(series: DataFrame, c: float) -> DataFrame:
    """Bilinear and quadratic lag forms: v + c v[-1] v[-2], and v + 0.5 v[-1] + 0.25 v[-2] + c v[-1]^2 - c v[-1] v[-2]."""
    a, b = (F.coalesce(F.lag("v", k).over(in_order()), F.lit(0.0)) for k in (1, 2))
    v = F.col("v")
    return series.select("id", "t", (v + c * a * b).alias("bilinear"), (v + 0.5 * a + 0.25 * b + c * a * a - c * a * b).alias("volterra"))


def phase_portrait(series: DataFrame, lag: int) -> DataFrame:
    """(id, t, x, y): values and what follows them after `lag` samples."""
    return series.select("id", "t", F.col("v").alias("x"), F.lead("v", lag).over(in_order()).alias("y")).filter("y IS NOT NULL")


def rank_remap(series: DataFrame, target: DataFrame) -> DataFrame:
    """(id, t, v): the value's average rank looked up, with linear interpolation, among the sorted target values (v) of all ids."""
    n = F.count("*").over(by_id())
    rank = F.rank().over(by_id().orderBy("v")) + (F.count("*").over(Window.partitionBy("id", "v")) - 1) / 2
    ranked = series.select("id", "t", F.when(n > 1, (rank - 1) / (n - 1)).otherwise(0.0).alias("q"))
    sorted_target = target.agg(F.sort_array(F.collect_list("v")).alias("goal"))  # one distribution, a parameter of the operator
    at = F.col("q") * (F.size("goal") - 1)
    low = F.floor(at)
    a, b = F.element_at("goal", (low + 1).cast("int")), F.element_at("goal", F.least(low + 2, F.size("goal")).cast("int"))
    return ranked.join(F.broadcast(sorted_target), how="cross").select("id", "t", (a + (at - low) * (b - a)).alias("v"))


def zoh_fill(series: DataFrame, missing: Column) -> DataFrame:
    """Missing samples take the last one there (the next one before the first)."""
    there = F.when(~missing, F.col("v"))
    last = F.last(there, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(there, ignorenulls=True).over(in_order().rowsBetween(0, Window.unboundedFollowing))
    return series.select("id", "t", F.coalesce(last, first).alias("v"))


def linear_fill(series: DataFrame, missing: Column) -> DataFrame:
    """Missing samples lie on the line between their neighbours; ends take the nearest one."""
    back, ahead = in_order().rowsBetween(Window.unboundedPreceding, 0), in_order().rowsBetween(0, Window.unboundedFollowing)
    there = F.when(~missing, F.struct("t", "v"))
    both = series.select("id", "t", F.last(there, ignorenulls=True).over(back).alias("p"), F.first(there, ignorenulls=True).over(ahead).alias("n"))
    p, n = F.col("p.v"), F.col("n.v")
    line = p + (n - p) * (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))
    return both.select("id", "t", F.when(F.col("p").isNull(), n).when(F.col("n").isNull() | (F.col("n.t") == F.col("p.t")), p).otherwise(line).alias("v"))


# ---- point processes ---------------------------------------------------------------------------------------


def inter_event(events: DataFrame) -> DataFrame:
    """(id, t, gap) of events (id, at): time since the event before."""
    order = Window.partitionBy("id").orderBy("at")
    return events.select("id", (F.row_number().over(order) - 1).cast("long").alias("t"), (F.col("at") - F.lag("at").over(order)).alias("gap")).filter("gap IS NOT NULL")


def burstiness(events: DataFrame) -> DataFrame:
    """(id, b): (sd - mean) / (sd + mean) of the gaps; null below three gaps or where both are 0."""
    stats = inter_event(events).groupBy("id").agg(F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"), F.count("*").alias("n"))
    return stats.select("id", F.when((F.col("n") >= 3) & (F.col("m") + F.col("s") > 0), (F.col("s") - F.col("m")) / (F.col("s") + F.col("m"))).alias("b"))


def bin_events(events: DataFrame, width: float, bins: int | None = None) -> DataFrame:
    """(id, bin, n): events per bin in [0, bins), empty bins as 0; without `bins`, up to the bin of the latest event of all."""
    at = events.select("id", F.floor(F.col("at") / width).cast("long").alias("bin"))
    counts = at.filter("bin >= 0" if bins is None else F.col("bin").between(0, bins - 1)).groupBy("id", "bin").agg(F.count("*").alias("n"))
    ids = events.select("id").distinct()
    last = F.lit(0 if bins is None else bins - 1).cast("long")
    if bins is None:
        ids, last = ids.join(F.broadcast(at.agg(F.greatest(F.max("bin"), last).alias("last"))), how="cross"), F.col("last")
    grid = ids.select("id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin"))
    return grid.join(counts, ["id", "bin"], "left").select("id", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def kernel_rate(binned: DataFrame, sigma: float, reach: int) -> DataFrame:
    """(id, bin, rate): Gaussian-weighted counts within `reach` bins, weights of the whole kernel."""
    weights = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
    total = sum(weights.values())
    order = Window.partitionBy("id").orderBy("bin")
    value = F.lit(0.0)
    for k, w in weights.items():
        near = F.lead("n", k).over(order) if k > 0 else F.lag("n", -k).over(order) if k < 0 else F.col("n")
        value = value + (w / total) * F.coalesce(near, F.lit(0))
    return binned.select("id", "bin", value.alias("rate"))


# ---- distances of distributions ----------------------------------------------------------------------------


def ks_uniform(series: DataFrame) -> DataFrame:
    """(id, d): largest gap between the empirical distribution and the uniform one on the series' own range."""
    lo, hi = F.min("v").over(by_id()), F.max("v").over(by_id())
    n = F.count("*").over(by_id())
    i = F.row_number().over(by_id().orderBy("v", "t"))
    p = F.when(hi > lo, (F.col("v") - lo) / (hi - lo)).otherwise(0.0)
    return series.select("id", F.greatest(i / n - p, p - (i - 1) / n).alias("d")).groupBy("id").agg(F.max("d").alias("d"))


def ks_halves(series: DataFrame) -> DataFrame:
    """(id, d): two-sample distance between the first and the second half of each series."""
    n = F.count("*").over(by_id())
    side = series.select("id", "v", (F.col("t") < F.floor(n / 2)).alias("first"))
    up_to = Window.partitionBy("id").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    one, two = F.col("first").cast("int"), (~F.col("first")).cast("int")
    gap = F.abs(F.sum(one).over(up_to) / F.sum(one).over(Window.partitionBy("id")) - F.sum(two).over(up_to) / F.sum(two).over(Window.partitionBy("id")))
    return side.select("id", gap.alias("d")).groupBy("id").agg(F.max("d").alias("d"))


def reversibility(series: DataFrame, lags: list[int]) -> DataFrame:
    """(id, lag, trev, trev2, bic): third moments of rank differences, of the squared ranks' too, and the bicovariance; ties by time."""
    n = F.count("*").over(by_id())
    u = (F.row_number().over(by_id().orderBy("v", "t")) - 0.5) / n - 0.5
    ranked = series.select("id", "t", (u * math.sqrt(12)).alias("x"), (u * u).alias("q"))
    ranked = ranked.select("id", "t", "x", ((F.col("q") - F.avg("q").over(by_id())) / (F.stddev_pop("q").over(by_id()) + 1e-300)).alias("y"))
    ahead = ranked.select("id", "x", "y", F.array(*(F.struct(F.lit(k).cast("long").alias("lag"), F.lead("x", k).over(in_order()).alias("x"), F.lead("y", k).over(in_order()).alias("y")) for k in lags)).alias("a"))
    pairs = ahead.select("id", "x", "y", F.explode("a").alias("a")).filter("a.x IS NOT NULL")
    dx, dy, x, z = F.col("a.x") - F.col("x"), F.col("a.y") - F.col("y"), F.col("x"), F.col("a.x")
    trev = lambda d: F.avg(d * d * d) / (F.pow(F.avg(d * d), F.lit(1.5)) + 1e-300)
    return pairs.groupBy("id", F.col("a.lag").alias("lag")).agg(trev(dx).alias("trev"), trev(dy).alias("trev2"), F.avg(x * x * z - x * z * z).alias("bic"))


def _delay_distances(x: list[float], lag: int, quantile: float) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(squared distances of a series' 3-point delay vectors, their quantile over pairs, distances of pairs); None below two vectors.

    Values of few digits give equal distances that differ in the last bit, and whole pairs hang on it where the
    quantile meets such a tie. So every sum runs in SQL's order: the mean and the deviation (Welford) value by value
    in time, the quantile as lower + (upper - lower) * fraction.
    """
    x = np.asarray(x, float)
    mean = spread = total = 0.0
    for n, v in enumerate(x.tolist(), 1):
        total += v
        off = v - mean
        mean += off / n
        spread += off * (v - mean)
    m = len(x) - 2 * lag
    if m < 2:
        return None
    sd = math.sqrt(spread / len(x))
    z = (x - total / len(x)) / (sd if sd > 0 else 1.0)
    d = np.zeros((m, m))
    for k in range(3):
        e = z[k * lag : k * lag + m]
        d += (e[:, None] - e[None]) ** 2
    pairs = d[np.triu_indices(m, 1)]
    at = (len(pairs) - 1) * quantile
    low, high = math.floor(at), math.ceil(at)
    part = np.partition(pairs, (low, high))
    return d, float(part[low] + (part[high] - part[low]) * (at - low)), pairs


def recurrence(series: DataFrame, lag: int = 1, quantile: float = 0.1) -> DataFrame:
    """(id, eps, rate): quantile of squared distances of 3-point delay vectors, and the share of pairs within it.

    Each series is one array in an Arrow batch and its distances are one numpy matrix, so
    cost and memory are those of the series' length squared and nothing is joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("id"), batch.column("x").to_pylist()):
                if (got := _delay_distances(x, lag, quantile)) is not None:
                    yield pa.RecordBatch.from_pydict({"id": pa.array([i.as_py()], batch.column("id").type), "eps": [got[1]], "rate": [float((got[2] <= got[1]).mean())]})

    kind = series.schema["id"].dataType.simpleString()
    return to_arrays(series).select("id", "x").mapInArrow(run, f"id {kind}, eps double, rate double")


# ---- gates, audits and spectra as the reference surveys them ----------------------------------------------


def gate_composition(series: DataFrame, meta: DataFrame, levels: int = 100) -> DataFrame:
    """(id, verdict): the first rule of the stationary profile that a series breaks, else ok.

    Real values and no periodic maps or flows; then, unless tagged nonstationary, the mean
    and, but for events and bursts, the variance over five windows; settled deterministic
    systems (classes F, G, H, L) have the tighter bounds. meta: id, cls, discrete, periodic,
    stationary, bursty, event_like, deterministic.
    """
    both = real_valued_gate(series, meta, levels).join(window_stationarity(series), "id").join(meta, "id")
    settled = F.col("cls").isin("F", "G", "H", "L") & F.col("deterministic").isin("yes", "partly")
    variance = (F.col("ss") > F.when(settled, 0.3).otherwise(0.5)) | (F.col("vr") > F.when(settled, 6.0).otherwise(20.0))
    exempt = (F.col("bursty") == "yes") | (F.col("event_like") == "yes")
    drift = F.when(F.col("stationary") == "no", F.lit(None)).when(F.col("sm") > 0.5, "mean").when(~exempt & variance, "variance")
    return both.select("id", F.coalesce("reason", drift, F.lit("ok")).alias("verdict"))


def reversibility_audit(series: DataFrame, lags: list[int], segments: int = 20) -> DataFrame:
    """(id, lag, trev, t_trev, trev2, t_trev2, bic, t_bic): means of the statistics over equal segments and mean / (sd / sqrt(segments))."""
    n = F.count("*").over(by_id())
    size = F.floor(n / segments)
    cut = series.withColumn("size", size).filter((F.col("size") > 0) & (F.col("t") < F.col("size") * segments))
    cut = cut.select(F.struct("id", F.floor(F.col("t") / F.col("size")).alias("segment")).alias("id"), "t", "v")
    stats = reversibility(cut, lags).select(F.col("id.id").alias("id"), "lag", "trev", "trev2", "bic")
    t = lambda c: F.avg(c) / (F.stddev_samp(c) / F.sqrt(F.count(c)))
    return stats.groupBy("id", "lag").agg(*(f(c).alias(p + c) for c in ("trev", "trev2", "bic") for p, f in (("", F.avg), ("t_", t))))


def periodicity(series: DataFrame) -> DataFrame:
    """(id, r): autocorrelation at the lag of the dominant period; 0 where that lag is under 2 or over half the length."""
    centred = series.select("id", "t", (F.col("v") - F.avg("v").over(by_id())).alias("z"), F.count("*").over(by_id()).alias("n"))
    lag = dominant_period(series).select("id", F.rint("period").cast("int").alias("lag"))
    arrays = centred.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "z"))), lambda x: x["z"]).alias("x")).join(lag, "id", "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))
    size = F.size("x")
    fits = (F.col("lag") >= 2) & (F.col("lag") < F.floor(size / 2))
    ahead = F.slice("x", F.coalesce("lag", F.lit(0)) + 1, F.greatest(size - F.coalesce("lag", F.lit(0)), F.lit(0)))
    return arrays.select("id", F.when(fits, dot(F.slice("x", 1, F.size(ahead)), ahead) / dot(F.col("x"), F.col("x"))).otherwise(0.0).alias("r"))


def spectral_period(series: DataFrame) -> DataFrame:
    """(id, period): period of the largest Hann-windowed power from two cycles on, where it is clear: at least five times
    the median power, at least 3 samples and at most n / 2.5; null elsewhere and below 32 samples.
    """
    n = F.count("*").over(by_id())
    hann = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("t") / (n - 1))
    rows = series.select("id", "t", n.alias("n"), ((F.col("v") - F.avg("v").over(by_id())) * hann).alias("z")).filter("n >= 32")
    waves = rows.select("id", "t", "n", "z", F.explode(F.sequence(F.lit(2).cast("long"), F.floor(F.col("n") / 2))).alias("k"))
    angle = 2 * math.pi * F.col("k") * F.col("t") / F.col("n")
    power = waves.groupBy("id", "n", "k").agg((F.pow(F.sum(F.col("z") * F.cos(angle)), 2) + F.pow(F.sum(F.col("z") * F.sin(angle)), 2)).alias("p"))
    top = power.groupBy("id", "n").agg(F.max(F.struct(F.round("p", 6).alias("p"), (-F.col("k")).alias("k"))).alias("best"), F.percentile(F.when(F.col("p") > 0, F.col("p")), 0.5).alias("median"))
    period = F.col("n") / -F.col("best.k")
    clear = (F.col("best.p") >= 5 * F.col("median")) & (period >= 3) & (period <= F.col("n") / 2.5)
    return series.select("id").distinct().join(top.select("id", F.when(clear, period).alias("period")), "id", "left")


def best_start(series: DataFrame, width: int, starts: int = 9) -> DataFrame:
    """(id, start, sd): of `starts` evenly spread windows the first with the largest deviation; series shorter than a window have none."""
    n = F.count("*").over(by_id())
    first = lambda i: F.rint(i / (starts - 1) * (F.col("n") - width)).cast("long")
    rows = series.select("id", "t", "v", n.alias("n")).filter(F.col("n") >= width)
    offered = rows.select("id", "t", "v", F.explode(F.array_distinct(F.array(*(first(i) for i in range(starts))))).alias("start")).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + width))
    spread = offered.groupBy("id", "start").agg(F.stddev_pop("v").alias("sd"))
    best = spread.groupBy("id").agg(F.max(F.struct(F.round("sd", 9).alias("r"), (-F.col("start")).alias("s"), "sd")).alias("b"))
    return best.select("id", (-F.col("b.s")).alias("start"), F.col("b.sd").alias("sd"))


def recurrence_blocks(series: DataFrame, blocks: int, lag: int = 1, quantile: float = 0.1) -> DataFrame:
    """(id, a, b, n): recurrent pairs of 3-point delay vectors (each with itself too) by blocks a <= b of time.

    Two vectors recur if their squared distance is within the quantile of `recurrence`. Each
    series is one array in an Arrow batch; its distances are one numpy matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("id"), batch.column("x").to_pylist()):
                if (got := _delay_distances(x, lag, quantile)) is None:
                    continue
                u, v = np.nonzero(np.triu(got[0] <= got[1]))
                m = len(got[0])
                size = max(1, -(-m // blocks))
                key, n = np.unique(u // size * (m + 1) + v // size, return_counts=True)
                yield pa.RecordBatch.from_pydict({"id": pa.array([i.as_py()] * len(n), batch.column("id").type), "a": pa.array(key // (m + 1)), "b": pa.array(key % (m + 1)), "n": pa.array(n.astype(np.int64))})

    kind = series.schema["id"].dataType.simpleString()
    return to_arrays(series).select("id", "x").mapInArrow(run, f"id {kind}, a long, b long, n long")


def decimate(series: DataFrame, k: int, order: int = 8) -> DataFrame:
    """(id, t, v): every k-th sample after a low-pass at 0.4 / k of the sampling rate, applied to the spectrum and so without phase shift."""
    from tideloom.generators.kit import butterworth

    low = butterworth(order, None, 0.4 / k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("id"), batch.column("x").to_pylist()):
                y = low(np.asarray(x, float))[::k]
                yield pa.RecordBatch.from_pydict({"id": pa.array([i.as_py()] * len(y), batch.column("id").type), "t": pa.array(np.arange(len(y))), "v": pa.array(y)})

    kind = series.schema["id"].dataType.simpleString()
    return to_arrays(series).select("id", "x").mapInArrow(run, f"id {kind}, t long, v double")
