"""Series, features and metadata taken from the star-schema, event and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, v): each user's event values in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.row_number().over(order) - 1).cast("long").alias("t"), F.col("value").alias("v"))


def series_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, v): daily revenue, one long series for each return flag."""
    daily = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("id"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("v"))
    order = Window.partitionBy("id").orderBy("day")
    return daily.select("id", (F.row_number().over(order) - 1).cast("long").alias("t"), "v")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, f): the embeddings as feature vectors."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").cast("array<double>").alias("f"))


def series_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cls, family, event_like, bursty, deterministic, discrete, periodic): tags of the user series."""
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")).select(
        "id",
        F.element_at(F.array(*map(F.lit, "FGHLABCD")), (F.pmod("id", F.lit(8)) + 1).cast("int")).alias("cls"),
        F.concat(F.lit("fam"), F.pmod("id", F.lit(20)).cast("string")).alias("family"),
        F.when(F.pmod("id", F.lit(5)) == 0, "yes").otherwise("no").alias("event_like"),
        F.when(F.pmod("id", F.lit(7)) == 0, "yes").otherwise("no").alias("bursty"),
        F.when(F.pmod("id", F.lit(3)) == 0, "yes").when(F.pmod("id", F.lit(3)) == 1, "partly").otherwise("no").alias("deterministic"),
        F.when(F.pmod("id", F.lit(11)) == 0, "yes").otherwise("no").alias("discrete"),
        F.when(F.pmod("id", F.lit(4)) == 0, "yes").otherwise("no").alias("periodic"),
    )
