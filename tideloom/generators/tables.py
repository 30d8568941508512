"""Generators as table functions: family dimension, selection, and series made in Arrow batches."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.generators import registry

SERIES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "cls", "family")]
    + [T.StructField("index", T.IntegerType()), T.StructField("seed_name", T.StringType()), T.StructField("seed", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("manual", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in registry.TAGS]
    + [T.StructField(n, T.DoubleType()) for n in registry.NUMERICS]
    + [T.StructField("params", T.StringType()), T.StructField("keywords", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("tvp", T.ArrayType(T.DoubleType())), T.StructField("sha256", T.StringType()), T.StructField("error", T.StringType())]
)


def source_hash(name: str) -> str:
    """Digest of a generator's source, by which a refresh sees changes."""
    return hashlib.sha256(inspect.getsource(registry.load()[name].gen).encode()).hexdigest()


def families(spark: SparkSession) -> DataFrame:
    """One row for each generator and profile: cls, family, ord, profile, n, source."""
    rows = [(g.cls, g.key, g.order, p, g.quota[p], source_hash(g.name)) for g in registry.load().values() for p in registry.PROFILES]
    return spark.createDataFrame(rows, "cls string, family string, ord int, profile string, n int, source string")


def selection(spark: SparkSession, profile: str, classes: Sequence[str] | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """(cls, family, index, manual) of all series of a profile, restricted to classes and families."""
    profile = registry.canonical(profile)
    chosen = families(spark).filter((F.col("profile") == profile) & (F.col("n") > 0))
    if classes is not None:
        chosen = chosen.filter(F.col("cls").isin(list(classes)))
    if keys is not None:
        chosen = chosen.filter(F.col("family").isin(list(keys)))
    return chosen.select("cls", "family", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("index"), F.lit(0).alias("manual"))


def keywords(cls: str, family: str, tags: dict[str, str]) -> str:
    """Class, family, domain, the tags that hold and the kind of nonstationarity, joined by commas."""
    kind = tags["nonstationary_kind"]
    return ",".join([f"class-{cls}", family, tags["domain"], *(t for t in registry.TAGS if tags[t] == "yes"), *([f"nonstat-{kind}"] if kind != "none" else [])])


def _row(cls: str, family: str, index: int, manual: int, length: int, profile: str) -> dict:
    base = {"id": f"TL_{cls}_{family}_{index:03d}", "cls": cls, "family": family, "index": index, "manual": manual}
    try:
        made = registry.generate(f"{cls}.{family}", index, length, profile, manual)
    except RuntimeError as error:
        return base | {"error": str(error)}
    from tideloom.generators.kit import seed_of

    vectors = made["vectors"]
    params = {k: (v if not isinstance(v, list) or len(v) <= 64 else f"<array {len(v)}>") for k, v in made["params"].items()}
    return base | made["tags"] | made["numerics"] | {
        "seed_name": made["seed_name"], "seed": str(seed_of(*made["seed_name"].split("/"))), "attempt": made["attempt"],
        "params": json.dumps(params, sort_keys=True, default=str), "keywords": keywords(cls, family, made["tags"]),
        "x": made["x"].tolist(), "tvp": vectors["tvp"].tolist() if "tvp" in vectors else None, "sha256": hashlib.sha256(made["x"].tobytes()).hexdigest(),
    }


def generate(chosen: DataFrame, length: int = 1000, profile: str = "full") -> DataFrame:
    """The series of (cls, family, index, manual) rows; `error` is set where all attempts failed.

    Costs differ much between families, so the rows are spread one by one before they run.
    """

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in SERIES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_row(r["cls"], r["family"], r["index"], r["manual"], length, profile)], schema)

    spread = chosen.repartition(4 * chosen.sparkSession.sparkContext.defaultParallelism, "cls", "family", "index")
    return spread.select("cls", "family", "index", "manual").mapInArrow(run, SERIES)
