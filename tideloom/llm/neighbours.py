"""Approximate nearest neighbours on robust-pruned directed graphs, one graph a shard."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideloom.llm.common import small_batches, stored, table

#: Points of a shard, out-degree, beam while building and searching, slack of the pruning.
SHARD_POINTS, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 2500, 24, 40, 64, 1.2
#: Queries that search a shard together.
QUERY_BLOCK = 2048
_STEP = 4  # beam entries expanded at once


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] to each b[i, j]."""
    return np.maximum((a * a).sum(1)[:, None] + np.einsum("ijk,ijk->ij", b, b) - 2 * np.einsum("ik,ijk->ij", a, b), 0)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries at once: the `beam` nearest points met, nearest first, and their squared distances.

    Missing entries are point -1 at infinity.
    """
    m, n = len(queries), len(x)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # stands for missing edges
    ids = np.full((m, beam), -1)
    dist = np.full((m, beam), np.inf, np.float32)
    ids[:, 0], seen[:, start] = start, True
    dist[:, 0] = ((queries - x[start]) ** 2).sum(1)
    done = np.ones((m, beam), bool)
    done[:, 0] = False
    active = np.arange(m)
    while len(active):
        rank = np.where(done[active], np.inf, dist[active])
        pick = np.argsort(rank, axis=1, kind="stable")[:, :_STEP]
        row = np.arange(len(active))[:, None]
        valid = np.isfinite(rank[row, pick])
        go = valid[:, 0]
        active, pick, valid = active[go], pick[go], valid[go]
        if not len(active):
            break
        row = active[:, None]
        done[row, pick] = True
        near = np.where(valid[:, :, None], graph[ids[row, pick]], -1).reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[row, near]] = n
        seen[row, near] = True
        d = _squared(queries[active], x[np.minimum(near, n - 1)]).astype(np.float32)
        d[near == n] = np.inf
        all_ids, all_dist = np.hstack([ids[active], near]), np.hstack([dist[active], d])
        all_done = np.hstack([done[active], near == n])
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        k = np.arange(len(active))[:, None]
        ids[active], dist[active], done[active] = all_ids[k, best], all_dist[k, best], all_done[k, best]
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to `degree` diverse neighbours of each point from its row of candidates (-1: none).

    Nearest first, a candidate stays unless a chosen neighbour is `alpha` times nearer to it than the point is.
    """
    c = np.sort(np.where(candidates == points[:, None], -1, candidates), axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    vec = x[np.maximum(c, 0)]
    d = np.where(c < 0, np.inf, _squared(x[points], vec))
    norms = (vec * vec).sum(2)
    between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * vec @ vec.transpose(0, 2, 1), 0)
    out = np.full((len(points), degree), -1)
    alive, row = d < np.inf, np.arange(len(points))
    for r in range(degree):
        left = np.where(alive, d, np.inf)
        best = left.argmin(1)
        ok = np.isfinite(left[row, best])
        if not ok.any():
            break
        out[ok, r] = c[row, best][ok]
        alive &= ~((alpha * alpha * between[row, best] <= d) & ok[:, None])
        alive[row[ok], best[ok]] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(graph, start): out-neighbours of each point, -1 where fewer, and the point nearest the mean."""
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(seed))
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1)
    if n > 1:
        some = min(degree // 2, n - 1)
        graph[:, :some] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, some))) % n
    order = rng.permutation(n)
    for lo in range(0, n, 250):
        batch = order[lo : lo + 250]
        found, _ = beam_search(x, graph, start, x[batch], beam)
        graph[batch] = robust_prune(x, batch, np.hstack([found, graph[batch]]), degree, alpha)
        source = np.repeat(batch, degree)
        target = graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        while len(nodes):  # long lists go in parts
            take = np.minimum(many, 2 * degree)
            width = int(take.max())
            new = np.full((len(nodes), width), -1)
            inside = np.arange(width) < take[:, None]
            new[inside] = source[(first[:, None] + np.arange(width))[inside]]
            graph[nodes] = robust_prune(x, nodes, np.hstack([graph[nodes], new]), degree, alpha)
            more = many > take
            nodes, first, many = nodes[more], first[more] + take[more], many[more] - take[more]
    return graph, start


def usable(column: str = "embedding"):
    """Vectors that take part: not null, empty or zero, all components finite."""
    v = F.col(column)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def build_index(vectors: DataFrame, k: int, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(dim, shard, index): a graph over the distinct vectors of each shard, stored.

    vectors: vec_id, embedding (array of double). Equal vectors are one point with its k + 1
    smallest vec_ids, which is all that a search for k neighbours can return of it. The
    vectors must take part (see usable); no vectors give an empty index.
    """
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = vectors.distinct().withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    points = stored(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, math.ceil(points.count() / shard_points))
    points = points.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), "embedding", "ids")

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        x = np.array(group.column("embedding").to_pylist(), np.float64)[order]
        graph, start = build_graph(x.astype(np.float32))
        index = pickle.dumps((x, [ids[i] for i in order], graph.astype(np.int32), start))
        return pa.table({"dim": group.column("dim")[:1], "shard": group.column("shard")[:1], "index": pa.array([index], pa.large_binary()).cast(pa.binary())})

    return stored(points.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, index binary"))


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """The k nearest points found for each query in all shards: query_id, rank, vec_id, score.

    queries: vec_id, embedding, of vectors that take part (see usable). Every shard of a
    dimension gets each block of queries once; the join is by shard, so no key grows with
    the number of shards. A vec_id with several vectors is found at the nearest of them. An
    empty index or no queries give no rows.
    """
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    packed = queries.groupBy(F.size("embedding").alias("dim"), block.alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))  # two whole numbers for each length that vectors have
    packed = packed.join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")

    def search(group: pa.Table) -> pa.Table:
        x, ids, graph, start = pickle.loads(group.column("index")[0].as_py())
        asked = group.column("queries")[0].as_py()
        own = np.array([q["vec_id"] for q in asked])
        vec = np.array([q["embedding"] for q in asked], np.float64)
        out: list[tuple[int, int, float]] = []
        for lo in range(0, len(own), 256):
            part = vec[lo : lo + 256]
            found, _ = beam_search(x.astype(np.float32), graph, start, part.astype(np.float32), beam)
            found = found[:, : 2 * k + 2]
            exact = np.sqrt(((part[:, None, :] - x[np.maximum(found, 0)]) ** 2).sum(2))
            for i, query in enumerate(own[lo : lo + 256].tolist()):
                nearest_of: dict[int, float] = {}
                for score, v in sorted((float(s), v) for s, p in zip(exact[i], found[i].tolist()) if p >= 0 for v in ids[p] if v != query):
                    nearest_of.setdefault(v, score)
                out += [(query, v, score) for v, score in list(nearest_of.items())[:k]]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    met = index.join(packed.hint("merge"), ["dim", "shard"]).select("dim", "shard", "block", "index", "queries")
    hits = met.groupBy("dim", "shard", "block").applyInArrow(search, "query_id long, vec_id long, score double")
    hits = hits.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows found for each query, nearest first, ties to the smaller vec_id.

    vectors, queries: vec_id and embedding (others are ignored). A query's own vec_id is no
    candidate of it. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without vec_id, take no part; vectors meet only those of their
    length; repeated rows count once (of queries with one vec_id the smallest vector);
    fewer candidates than k give fewer rows; empty tables give no rows. score is the
    Euclidean distance in double precision on the original vectors.
    """
    small_batches(vectors.sparkSession)
    clean = lambda df: df.filter(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = stored(clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    return search_index(build_index(clean(vectors), k), asked, k)


def op3_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows found for every row whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))
