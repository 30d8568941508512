"""Byte-balanced sharding by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideloom.llm.common import discard, small_batches, stored, table

#: Groups that a task differences at once; the runs' partial partitions are differenced on the driver.
RUN = 100_000


def differencing(items: list[list[int]], ways: int) -> list[list[int]]:
    """Multi-way largest differencing: the set of each item's parts.

    An item is the sums of its parts (missing parts are 0). The two partial partitions
    with the largest spread are combined again and again, the largest part of one with the
    smallest of the other. Returns, for each item, the final set of its 1st, 2nd, ... part.
    """
    follow: dict[tuple[int, int], tuple[int, int]] = {}
    heap = []
    for i, sums in enumerate(items):
        slots = sorted(((s, (i, p), (i, p)) for p, s in enumerate([*sums, *[0] * (ways - len(sums))])), key=lambda x: (-x[0], x[1]))
        heap.append((slots[-1][0] - slots[0][0], i, slots))
    heapq.heapify(heap)
    count = len(items)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        slots = []
        for (s, head, tail), (t, head2, tail2) in zip(one, reversed(two)):
            follow[tail] = head2
            slots.append((s + t, head, tail2))
        slots.sort(key=lambda x: (-x[0], x[1]))
        heapq.heappush(heap, (slots[-1][0] - slots[0][0], count, slots))
        count += 1
    out = [[0] * ways for _ in items]
    for shard, (_, at, _) in enumerate(heap[0][2] if heap else []):
        while at:
            out[at[0]][at[1]] = shard
            at = follow.get(at)
    return out


def _local(groups: DataFrame, ways: int, run_size: int) -> DataFrame:
    """(digest, bytes, part, subset): each run of a task's groups differenced into `ways` subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            got = pa.Table.from_batches(held).sort_by([("bytes", "descending"), ("digest", "ascending")])
            held.clear()
            for lo in range(0, len(got), run_size):
                some = got.slice(lo, run_size)
                subset = [x[0] for x in differencing([[b] for b in some.column("bytes").to_pylist()], ways)]
                yield from some.append_column("part", pa.array(np.full(len(some), base + number))).append_column("subset", pa.array(subset, pa.int32())).to_batches()
                number += 1

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= run_size:
                yield from close()
        if held:
            yield from close()

    return groups.select("digest", "bytes").mapInArrow(run, "digest binary, bytes long, part long, subset int")


def shard_by_bytes(docs: DataFrame, shards: int = 8, run_size: int = RUN) -> DataFrame:
    """Deals all rows into shards of near equal bytes; rows with equal texts stay together.

    docs: doc_id and text (others are ignored). A row's size is its UTF-8 bytes plus one.
    Groups of equal texts are indivisible. Every task differences the groups dealt to it by
    text hash in runs of `run_size`; the runs' partitions, a row of sums each, are then
    differenced on the driver, so shards differ by no more than the largest group.
    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard) and
    grown_shard (null under this law). Null texts are empty; repeated rows get slots of
    their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = stored(_local(groups.repartition(width, "digest"), shards, run_size))
    sums: dict[int, list[int]] = {}
    for part, subset, total in local.groupBy("part", "subset").agg(F.sum("bytes")).collect():
        sums.setdefault(part, [0] * shards)[subset] = total
    order = sorted(sums)
    final = differencing([sums[p] for p in order], shards)
    place = spark.createDataFrame([(p, s, final[i][s]) for i, p in enumerate(order) for s in range(shards)], "part long, subset int, shard int")
    owner = local.join(place.hint("merge"), ["part", "subset"]).select("digest", "shard")
    # rows are dealt one by one, so that a doc_id with many rows fills no bucket; stored, so that the deal stands
    bucket = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(width)).cast("int")
    dealt = stored(rows.join(owner.hint("merge"), "digest").select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")))
    discard(local)
    offset, before = [], dict.fromkeys(range(shards), 0)
    for shard, b, n in sorted(dealt.groupBy("shard", "bucket").count().collect()):
        offset.append((shard, b, before[shard]))
        before[shard] += n
    offsets = spark.createDataFrame(offset, "shard int, bucket int, base long")
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    out = dealt.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"))
