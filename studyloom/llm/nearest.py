"""Approximate nearest neighbours: a vantage-point tree per shard, searched for blocks of queries.

Vectors belong to the nearest of a few pivots (as many vectors as there are shards of the usual size, but
at most ``PIVOTS``: those with the smallest hashes of their ids), and the vectors of a pivot are dealt to shards by a hash of the id. Of each
pivot the least and greatest distance of its vectors are known. A query is searched among its own
pivot's vectors first; its k-th best there is a bound, and by the triangle inequality only pivots
whose range comes within it are asked at all: rows for other pairs of query and shard are never made.

Each task builds the tree of its shard and sends a whole block of queries through it. A node keeps
a vantage point and the range of distances of each half, which bounds what a half can hold. Pivots
and halves are skipped where bound * relax > distance of the k-th best so far: relax 1 (the
default) is an exact search, more skips more. The shards' best are merged by query.

Vectors that are null, zero, or hold null or non-finite components take no part, rows
without an id neither. Only vectors of a query's length are candidates. Rows repeating
an id count once. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.llm._store import keep, rows_of

K = 10
SHARD_ROWS = 8192
PIVOTS = 32
BLOCK_QUERIES = 4096
LEAF = 64
RELAX = 1.0


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, component after component in double precision."""
    total = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        total += np.square(q[:, j, None] - x[None, :, j])
    return np.sqrt(total)


class VantagePointTree:
    """leaf: (ids, vectors); inner node: vantage point and, by half, least and greatest distance and the half itself."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.root = self._build(ids, vectors)

    def _build(self, ids: np.ndarray, x: np.ndarray):
        if len(ids) <= LEAF:
            return ids, x
        far = int(np.argmax(np.square(x - x.mean(0)).sum(1)))
        d = distances(x[far : far + 1], x)[0]
        order = np.argsort(d, kind="stable")
        halves = order[: len(order) // 2], order[len(order) // 2 :]
        return x[far : far + 1], [(d[h[0]], d[h[-1]], self._build(ids[h], x[h])) for h in halves]

    def search(self, own: np.ndarray, q: np.ndarray, k: int, relax: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest by query, -1 and inf where there are fewer; own: ids to leave out; limit: distances beyond which nothing is asked for."""
        limit = np.full(len(q), np.inf) if limit is None else limit
        ids = np.full((len(q), k), -1, np.int64)
        best = np.full((len(q), k), np.inf)

        def leaf(node, at: np.ndarray) -> None:
            d = distances(q[at], node[1])
            d[node[0][None, :] == own[at, None]] = np.inf
            d = np.concatenate([best[at], d], 1)
            i = np.concatenate([ids[at], np.broadcast_to(node[0], (len(at), len(node[0])))], 1)
            by_id = np.argsort(i, 1, kind="stable")
            nearest = np.argsort(np.take_along_axis(d, by_id, 1), 1, kind="stable")[:, :k]
            nearest = np.take_along_axis(by_id, nearest, 1)
            best[at], found = np.take_along_axis(d, nearest, 1), np.take_along_axis(i, nearest, 1)
            ids[at] = np.where(np.isfinite(best[at]), found, -1)

        def visit(node, at: np.ndarray) -> None:
            if isinstance(node[1], np.ndarray):
                leaf(node, at)
                return
            d = distances(q[at], node[0])[:, 0]
            bounds = [np.maximum(0, np.maximum(lo - d, d - hi)) * (1 - 1e-12) for lo, hi, _ in node[1]]
            near_first = bounds[0] <= bounds[1]
            for h, mine in ((0, near_first), (1, np.ones(len(at), bool)), (0, ~near_first)):
                on = mine & (bounds[h] * relax <= np.minimum(best[at, -1], limit[at]))
                if on.any():
                    visit(node[1][h][2], at[on])

        if len(q):
            visit(self.root, np.arange(len(q)))
        return ids, best


def usable(vectors: DataFrame) -> DataFrame:
    """id, vector and its length, of the vectors that take part."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("id").isNotNull() & v.isNotNull()).withColumn("vector", v.cast("array<double>")).where(sound)
    return rows.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = table.column("vector").combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
    ids = table.column("id").to_numpy()
    return ids, flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _to_pivots(rows: DataFrame, pivots: dict[int, np.ndarray], nearest_only: bool) -> DataFrame:
    """Adds each vector's pivot (cell) and its distance (far), or the distances of all pivots (to). Lengths without a pivot are cell 0, at no known distance."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, flat = batch.column("dim").to_numpy(), batch.column("vector")
            cell, far, to = np.zeros(len(dims), np.int64), np.full(len(dims), np.nan), [[]] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) in pivots:
                    d = distances(flat.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1), pivots[int(dim)])
                    cell[at], far[at] = d.argmin(1), d.min(1)
                    for i, row in zip(at, d, strict=True):
                        to[i] = row
            more = [pa.array(cell), pa.array(far, from_pandas=True)] + ([] if nearest_only else [pa.array(to, pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "far", "to"][: len(batch.columns) + len(more)])

    return rows.select("id", "vector", "dim").mapInArrow(measure, "id long, vector array<double>, dim int, cell long, far double" + ("" if nearest_only else ", to array<double>"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, relax: float = RELAX, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors and queries: id long, vector array. query_id, rank, id, score; a query's own id is no candidate."""
    base, asked = usable(vectors), usable(queries)
    pivots: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-vectors.count() // shard_rows))).collect():
        pivots.setdefault(r.dim, []).append(r.vector)
    fixed = {d: np.array(v) for d, v in pivots.items()}
    base, asked = keep(_to_pivots(base, fixed, True)), keep(_to_pivots(asked, fixed, False))
    cells = keep(base.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"), F.min("far").alias("lo"), F.max("far").alias("hi")))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    shard = base.join(cells.select("dim", "cell", "shards"), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    shard = shard.select("id", "vector", "dim", "cell", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    key = ["dim", "cell", "shard", "block"]
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        own, q = _matrix(right)
        limit = right.column("limit").to_numpy()
        ids, score = VantagePointTree(*_matrix(left)).search(own, q, k, relax, np.where(np.isnan(limit), np.inf, limit))
        on = ids >= 0
        return pa.table([pa.array(np.repeat(own, on.sum(1))), pa.array(ids[on]), pa.array(score[on])], schema=schema)

    def sent(to: DataFrame) -> DataFrame:
        """to: a query's id, vector and limit, with a cell that it goes to."""
        rows = to.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return shard.groupBy(*key).cogroup(rows.select("id", "vector", "limit", *key).groupBy(*key)).applyInArrow(search, "query_id long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    none = F.lit(None).cast("double").alias("limit")
    first = keep(best(sent(asked.join(cells, ["dim", "cell"]).select("id", "vector", "dim", "cell", "shards", none))))
    limits = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    other = asked.withColumnRenamed("cell", "home").join(cells, "dim").where(~F.col("cell").eqNullSafe(F.col("home"))).join(limits, "id", "left")
    to = F.get("to", F.col("cell").cast("int"))
    bound = F.greatest(F.lit(0.0), F.col("lo") - to, to - F.col("hi")) * (1 - 1e-12)
    near = other.where(F.col("limit").isNull() | bound.isNull() | (bound * relax <= F.col("limit")))
    rest = sent(near.select("id", "vector", "dim", "cell", "shards", "limit"))
    return best(first.select("query_id", "id", "score").unionByName(rest)).select("query_id", "rank", "id", "score")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows, rows.where(F.col("id") % 100 == 0)).withColumnRenamed("id", "vec_id")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
  sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, x: a + x, 0.0::double)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 10
"""
QUERIES: dict[str, Callable] = {"op8_nearest_vectors": op8_nearest_vectors}
ORACLES = {"op8_nearest_vectors": SQL}
