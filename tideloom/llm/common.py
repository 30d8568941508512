"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session (tests, one machine) may leave it unset and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tideloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Narrow rows that one file of a stored table holds at most, where the number of rows has a known bound.
ROWS_A_FILE = 100_000


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors.

    `rows` is an upper bound of their number, where it is known: small tables then make few files.
    """
    path = shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(2, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote, once nothing that is still to be computed reads it."""
    for df in tables:
        remove(df.sparkSession, df._stored)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that very long texts fit a Python worker.

    Also lets the workers of a local session import this package from where the driver did.
    """
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, root]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
