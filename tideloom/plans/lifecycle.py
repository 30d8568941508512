"""Build, refresh, verify, subset and export of a corpus of generated series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions.columns import uniform
from tideloom.generators import registry, tables
from tideloom.operators import corpus
from tideloom.sources import files


def build(spark: SparkSession, path: str, profile: str = "full", classes: Sequence[str] | None = None, families: Sequence[str] | None = None, length: int = 1000, refresh: str | None = None, flags: DataFrame | None = None, force: bool = False, keep_going: bool = False) -> DataFrame:
    """Generates the chosen series to Parquet at path/series, partitioned by class, and returns them.

    With `refresh`, series of an older corpus are taken over where the generator's source and
    quota are unchanged and no flag asks for a retry; series of class M are always made again,
    for their bases lie in other families. flags: id and action (retry draws again under a new
    name, drop leaves out). A series that fails raises unless keep_going.
    """
    profile = registry.canonical(profile)
    chosen = tables.selection(spark, profile, classes, families)
    sources = tables.families(spark).filter(F.col("profile") == profile).select("cls", "family", "source", F.col("n").alias("quota"))
    chosen = chosen.join(F.broadcast(sources), ["cls", "family"])
    named = chosen.withColumn("id", F.format_string("TL_%s_%s_%03d", "cls", "family", "index"))
    if flags is not None:
        marks = flags.groupBy("id").agg(F.max((F.col("action") == "drop").cast("int")).alias("dropped"), F.sum((F.col("action") == "retry").cast("int")).alias("retries"))
        named = named.join(F.broadcast(marks), "id", "left").filter("coalesce(dropped, 0) = 0").withColumn("manual", F.coalesce("retries", F.lit(0)).cast("int")).drop("dropped", "retries")
    kept = None
    if refresh and not force:
        old = spark.read.parquet(f"{refresh}/series").drop("cls", "family", "index", "manual")
        both = named.join(old.withColumnsRenamed({"source": "old_source", "quota": "old_quota"}), "id")
        kept = both.filter("source = old_source AND quota = old_quota AND cls <> 'M' AND manual = 0 AND error IS NULL").drop("old_source", "old_quota")
        named = named.join(kept.select("id"), "id", "left_anti")
    made = tables.generate(named, length, profile).join(F.broadcast(sources), ["cls", "family"])
    out = made if kept is None else made.unionByName(kept.select(made.columns))
    out.write.mode("overwrite").partitionBy("cls").parquet(f"{path}/series")
    done = spark.read.parquet(f"{path}/series")
    failed = done.filter("error IS NOT NULL")
    if not keep_going and (first := failed.select("error").first()):
        raise RuntimeError(first[0])
    manifest(done.filter("error IS NULL")).write.mode("overwrite").parquet(f"{path}/manifest")
    return done


def manifest(series: DataFrame) -> DataFrame:
    """(id, cls, family, sha256, source, quota)."""
    return series.select("id", "cls", "family", "sha256", "source", "quota")


def verify(spark: SparkSession, path: str, fraction: float = 0.05, seed: str = "verify", profile: str = "full", length: int = 1000) -> DataFrame:
    """(id, expected, got) of sampled series that come out differently when made again; at least one is sampled."""
    held = spark.read.parquet(f"{path}/series").filter("error IS NULL").select("id", "cls", "family", "index", "manual", "sha256")
    some = held.filter(uniform(F.lit(seed), F.col("id")) < fraction)
    if some.isEmpty():
        some = held.orderBy(uniform(F.lit(seed), F.col("id"))).limit(1)
    again = tables.generate(some, length, profile).select("id", F.col("sha256").alias("got"))
    return some.join(again, "id", "left").filter(~F.col("sha256").eqNullSafe(F.col("got"))).select("id", F.col("sha256").alias("expected"), "got")


def subset(spark: SparkSession, source: str, out: str, where: Mapping[str, Sequence[str]]) -> DataFrame:
    """Writes the series that match all conditions, with their part of the manifest."""
    chosen = corpus.subset(spark.read.parquet(f"{source}/series"), where)
    chosen.write.mode("overwrite").partitionBy("cls").parquet(f"{out}/series")
    done = spark.read.parquet(f"{out}/series")
    manifest(done).write.mode("overwrite").parquet(f"{out}/manifest")
    return done


def export_csv(series: DataFrame, path: str) -> None:
    """Values with ten significant digits, one series a line; and name, keywords, length."""
    values = F.array_join(F.transform("x", lambda v: F.format_string("%.10g", v)), ",")
    series.select(F.concat_ws(",", "id", values).alias("line")).write.mode("overwrite").text(f"{path}/data")
    series.select(F.col("id").alias("Name"), F.col("keywords").alias("Keywords"), F.size("x").alias("Length")).write.mode("overwrite").option("header", True).csv(f"{path}/info")


def export_all(series: DataFrame, path: str) -> None:
    """Everything a reader may want below path: values and names as CSV, array files, metadata as CSV, records by class, the catalogue."""
    export_csv(series, f"{path}/csv")
    files.write_npz(series.filter("x IS NOT NULL").select("id", "x"), f"{path}/npz")
    plain = [c for c, kind in series.dtypes if not kind.startswith("array")]
    series.select(plain).write.mode("overwrite").option("header", True).csv(f"{path}/metadata")
    files.write_json_by_class(series.select(plain), f"{path}/records")
    catalogue(series).write.mode("overwrite").json(f"{path}/catalogue")


def quotas(spark: SparkSession, profile: str) -> DataFrame:
    """(cls, registered, declared, gap) of a profile's classes."""
    name = registry.canonical(profile)
    have = tables.families(spark).filter(F.col("profile") == name).select("cls", F.col("n").cast("long").alias("n"))
    return corpus.quota_report(have, registry.DECLARED[name])


def catalogue(series: DataFrame) -> DataFrame:
    """(cls, families): each class's families with their number of series."""
    counts = series.groupBy("cls", "family").agg(F.count("*").alias("n"))
    return counts.groupBy("cls").agg(F.array_join(F.sort_array(F.collect_list(F.format_string("%s (%d)", "family", "n"))), "; ").alias("families"))
