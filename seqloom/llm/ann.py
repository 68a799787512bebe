"""Nearest neighbours by vantage-point trees, one per shard.

Vectors fall into shards by a hash of id and components. Each shard builds a tree whose inner nodes split by the median
distance to a vantage point; a query skips a leaf if the triangle inequality, its bound multiplied by `relax`,
puts the leaf beyond the query's k-th best so far. relax = 1 is exact search; larger factors skip more. Queries go to
every shard in blocks of bounded size, and the shards' k best are merged by a top-k per query. A shard's vectors come
to one task, which builds its tree once and streams all blocks through it.

Vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no part.
Scores are double precision, summed in component order. Ties go to the smaller id. A vec_id that repeats is several
candidates, none of them for a query of that id; a repeated query is answered once, for its least vector in the order
of arrays. Null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import cut, released, with_columns_of

#: Vectors in a shard and queries in a block, on average; a task holds one shard and one block.
SHARD_ROWS, BLOCK_QUERIES, LEAF = 8_192, 1_024, 64


class VantageTree:
    """Leaves of about LEAF vectors, and for each the vantage points on its way with the distances it spans."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.x = x
        self.points: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float]]] = []
        rng = np.random.Generator(np.random.PCG64(seed))
        todo = [(np.arange(len(x)), [])]
        while todo:
            rows, path = todo.pop()
            if len(rows) <= leaf:
                if len(rows):
                    self._leaf(rows, path)
                continue
            point = x[rows[rng.integers(len(rows))]]
            d = distances(x[rows], point[None, :])[:, 0]
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            if d[order[0]] == d[order[-1]]:  # equally far: nothing to split by
                self._leaf(rows, path)
                continue
            number = len(self.points)
            self.points.append(point)
            for part in (order[:half], order[half:]):
                todo.append((rows[part], [*path, (number, float(d[part].min()), float(d[part].max()))]))

    def _leaf(self, rows, path) -> None:
        self.leaves.append(rows)
        self.paths.append(path)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries x leaves: no vector of the leaf is nearer than this."""
        low = np.zeros((len(queries), len(self.leaves)))
        if not self.points:
            return low
        # sums of squared differences, whose error is relative to the distance however far off the origin vectors are
        d = distances(queries, np.stack(self.points))
        for j, path in enumerate(self.paths):
            for number, near, far in path:
                # rounding must not cost a neighbour
                slack = 1e-12 * (d[:, number] + far)
                gap = np.maximum(near - d[:, number], d[:, number] - far) - slack
                np.maximum(low[:, j], gap, out=low[:, j])
        return low

    def search(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Row numbers and distances of each query's k best (-1 where there are fewer), and distances computed.

        All queries take their nearest leaf first, then their second nearest, and so on; those that visit the same
        leaf at the same time are compared at once.
        """
        n = len(queries)
        rows, best = np.full((n, k), -1), np.full((n, k), np.inf)
        low = self.bounds(queries) * relax
        order = np.argsort(low, axis=1, kind="stable")
        alive, computed = np.arange(n), 0
        for turn in range(len(self.leaves)):
            leaf = order[alive, turn]
            open_ = low[alive, leaf] <= best[alive, -1]
            alive, leaf = alive[open_], leaf[open_]  # later leaves are no nearer
            if not len(alive):
                break
            by = np.argsort(leaf, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                qs, members = alive[group], self.leaves[leaf[group[0]]]
                for a in range(0, len(members), 4 * LEAF):
                    some = members[a : a + 4 * LEAF]
                    d = distances(queries[qs], self.x[some])
                    computed += d.size
                    d[query_ids[qs][:, None] == ids[some][None, :]] = np.inf
                    all_d = np.concatenate([best[qs], d], axis=1)
                    all_r = np.concatenate([rows[qs], np.broadcast_to(some, d.shape)], axis=1)
                    all_i = np.where(np.isinf(all_d), np.iinfo(np.int64).max, ids[all_r])
                    top = np.lexsort((all_i, all_d), axis=1)[:, :k]
                    best[qs], rows[qs] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_r, top, 1)
        rows[np.isinf(best)] = -1
        return rows, best, computed


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, component by component in order, so that any engine summing so gives the same bits."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out)


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _packed_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", ignore_index=True)
    return pd.DataFrame({"block": rows.block[:1], "ids": [rows.vec_id.to_numpy(np.int64).tobytes()], "data": [np.stack(rows.embedding.to_numpy()).astype(np.float64).tobytes()]})


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, relax: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest. vectors: vec_id, embedding."""
    rows = with_columns_of(vectors, {"vec_id": T.LongType(), "embedding": T.ArrayType(T.DoubleType())})
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    counts = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if counts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == counts.d)
    shards = max(1, -(-counts["count"] // shard_rows))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = cut(queries)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    # a shard's rows first, then the blocks of queries, each one row of packed bytes
    d, spark = counts.d, vectors.sparkSession
    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(_packed_block, "block int, ids binary, data binary")
    packed = cut(packed)
    ours = rows.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("block"), "vec_id", "embedding", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("data"))
    asked = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"), "ids", "data")

    def search(batches):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        shard, ids, x, tree, again = None, [], [], None, 0
        for batch in batches:
            of, block = batch.column("shard").to_pylist(), batch.column("block").to_pylist()
            for i in range(batch.num_rows):
                if of[i] != shard:
                    shard, ids, x, tree, again = of[i], [], [], None, 0
                if block[i] < 0:
                    name, vector = batch.column("vec_id")[i].as_py(), batch.column("embedding")[i].values.to_numpy()
                    # of equal rows, more than k can't be among the k nearest
                    again = again + 1 if ids and ids[-1] == name and (x[-1] == vector).all() else 0
                    if again < k:
                        ids.append(name)
                        x.append(vector.copy())
                elif ids:
                    if tree is None:
                        names = np.array(ids)
                        tree, x = VantageTree(np.stack(x), seed=shard), []
                    asked_ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                    asked = np.frombuffer(batch.column("data")[i].as_py(), np.float64).reshape(-1, d)
                    found, score, _ = tree.search(asked, asked_ids, names, k, relax)
                    there = found >= 0
                    columns = [np.broadcast_to(asked_ids[:, None], found.shape)[there], names[found[there]], score[there]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")) * 8)
    found = ours.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", "block", "vec_id", "embedding")
    found = found.mapInArrow(released(search), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
