"""Reading and writing series in array files, CSV and JSON."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_npz(spark: SparkSession, path: str, values: str = "X", ids: str = "ids") -> DataFrame:
    """(id, x) of array files below a path, one file a task: `values` is a matrix whose rows are named by `ids`."""

    def rows(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as file:
                    if len(names := [str(i) for i in file[ids]]):
                        yield pa.RecordBatch.from_pydict({"id": pa.array(names), "x": pa.array([r.tolist() for r in np.asarray(file[values], float)], pa.list_(pa.float64()))})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id string, x array<double>")


def npz_bytes(series: DataFrame) -> DataFrame:
    """(part, content): the series of each partition, all of one length, as one array file's bytes."""

    def pack(batches):
        names, x = [], []
        for batch in batches:
            names += batch.column("id").to_pylist()
            x += batch.column("x").to_pylist()
        if names:
            out = io.BytesIO()
            np.savez_compressed(out, X=np.array(x, float), ids=np.array(names, dtype=str))
            yield pa.RecordBatch.from_pydict({"content": pa.array([out.getvalue()], pa.binary())})

    return series.select("id", "x").mapInArrow(pack, "content binary").withColumn("part", F.spark_partition_id())


def write_npz(series: DataFrame, path: str) -> None:
    """One array file a partition of (id, x) below path, in whatever store it lies; the driver holds one file at a time."""
    spark = series.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in npz_bytes(series).toLocalIterator():
        out = store.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"series-{row.part:05d}.npz"), True)
        out.write(bytearray(row.content))
        out.close()


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """(key, fields) of YAML files that map keys to records: the fields as text by name, nested ones as JSON."""

    def rows(batches):
        import json

        import pandas as pd

        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading cards needs PyYAML") from error
        for batch in batches:
            out = [(str(k), json.dumps({str(f): v if isinstance(v, str) else json.dumps(v, sort_keys=True) for f, v in (card or {}).items()})) for content in batch["content"] for k, card in (yaml.safe_load(content) or {}).items()]
            yield pd.DataFrame(out, columns=["key", "fields"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "key string, fields string").withColumn("fields", F.from_json("fields", "map<string,string>"))


def append_json(records: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Appends records as JSON lines but for those whose key is there already; returns all that is then there."""
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        records = pending(records, spark.read.schema(records.schema).json(path), key)
    records.write.mode("append").json(path)
    return spark.read.schema(records.schema).json(path)


def read_long_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, t, v) with an explicit schema, never inferred."""
    return spark.read.schema("id string, t long, v double").option("header", True).csv(path)


def write_series_csv(series: DataFrame, path: str) -> None:
    """t,v lines, a folder for each series, as downloads need them; a corpus is better written whole, see lifecycle.export_csv."""
    series.select("id", "t", "v").repartition("id").sortWithinPartitions("id", "t").write.mode("overwrite").partitionBy("id").option("header", True).csv(path)


def write_json_by_class(records: DataFrame, path: str) -> None:
    """Records as JSON lines, one folder a class, so that readers fetch the classes that they need."""
    records.write.mode("overwrite").partitionBy("cls").json(path)


def pending(jobs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Jobs without a finished record: a resumed run does only these."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")
