"""Hard-negative mining: integer inner products searched by length and by coordinate (LEMP).

A component x becomes floor(256 * x). An anchor's positives are its ``positives`` highest scored
other rows of the same label; for each positive, the hard negatives are the ``negatives`` highest
scored rows of other labels with low * positive <= 100 * score <= high * positive. Ties go to
the smaller id. The search is exact.

Rows are cut into classes by length (by label too, where positives are sought), and a class into
shards by a hash of the id, so that no common label, length or vector gathers in one task. An
anchor goes to a shard only where its length times the longest of the class can reach what it
asks for. A shard is sorted by length into buckets, each with a sorted list of every coordinate
of its unit vectors. For an anchor and a bucket, the least score wanted gives the greatest angle
between the two; with the angle between the anchor and the axis of a focus coordinate (one of
its largest) that bounds the coordinate's value. The ranges of the focus coordinates are
intersected, and what is left is scored exactly. Where even the narrowest range holds half a
bucket, all of it is scored. The least score rises to the k-th best found so far.

Rows without an id or label take no part, nor do those whose vector is null or holds null or
non-finite components. Rows that repeat an id count once, with the smallest label and vector.
Only vectors of an anchor's length are candidates; a positive below 0 has no negatives. A hundred
times a score must fit 63 bits, else the job fails. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.llm._store import keep, rows_of

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
SHARD_ROWS, BLOCK_ANCHORS, BUCKET_ROWS = 16384, 4096, 1024
CLASSES = 16
FOCUS = 4
SLACK = 1e-9


class Bucket:
    """Rows of about one length, and by coordinate their order and sorted values."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, length: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.longest = float(length.max())
        unit = x / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(unit, 0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(unit, self.order, 0).T)

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose focus coordinates allow that cosine; None for all."""
        if cosine <= 0 or not len(focus):
            return None
        reach = np.arccos(min(1.0, cosine))
        axis = np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, axis + reach)) - SLACK, np.cos(np.maximum(0, axis - reach)) + SLACK
        spans = [(int(np.searchsorted(self.sorted[f], a, "left")), int(np.searchsorted(self.sorted[f], b, "right"))) for f, a, b in zip(focus, low, high, strict=True)]
        if 2 * min(b - a for a, b in spans) >= len(self.ids):
            return None
        hits = np.zeros(len(self.ids), np.int8)
        for f, (a, b) in zip(focus, spans, strict=True):
            hits[self.order[a:b, f]] += 1
        return np.flatnonzero(hits == len(focus))


class Shard:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        length = np.sqrt(np.square(x.astype(float)).sum(1))
        order = np.lexsort((ids, -length))
        cuts = [order[i : i + BUCKET_ROWS] for i in range(0, len(order), BUCKET_ROWS)]
        self.buckets = [Bucket(ids[c], labels[c], x[c].astype(float), length[c]) for c in cuts]
        self.x, self.order, self.most = x, order, int(np.abs(x).max(initial=0))

    def scores(self, nth: int, at: np.ndarray | slice, q: np.ndarray) -> np.ndarray:
        bound = self.most * int(np.abs(q).max(initial=0)) * max(1, len(q))
        if bound < 1 << 53:
            return (self.buckets[nth].x[at] @ q.astype(float)).astype(np.int64)
        if bound >= 1 << 63:
            raise ValueError("scores must fit 63 bits")
        return self.x[self.order[nth * BUCKET_ROWS : (nth + 1) * BUCKET_ROWS]][at] @ q

    def search(self, own: int, label: int, q: np.ndarray, wanted: list[tuple[int | None, int | None]], k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (least, most) the ids and scores of the k best rows of the same label, or of others."""
        length = float(np.sqrt(np.square(q.astype(float)).sum()))
        unit = q / (length or 1.0)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in wanted]
        least = [a for a, _ in wanted]
        for nth, b in enumerate(self.buckets):
            floor = None if None in least else min(least)
            product = length * b.longest
            if floor is not None and floor > product * (1 + SLACK):
                break  # the buckets to come are shorter still
            cosine = 0.0 if floor is None or product == 0 else floor / (product * (1 + SLACK))
            at = b.candidates(unit, focus, cosine)
            at = slice(None) if at is None else at
            s, ids = self.scores(nth, at, q), b.ids[at]
            fits = ((b.labels[at] == label) == same) & (ids != own)
            for i, (_, most) in enumerate(wanted):
                ok = fits if least[i] is None else fits & (s >= least[i])
                ok = np.flatnonzero(ok if most is None else ok & (s <= most))
                if len(ok):
                    ids2, s2 = np.concatenate([found[i][0], ids[ok]]), np.concatenate([found[i][1], s[ok]])
                    best = np.lexsort((ids2, -s2))[:k]
                    found[i] = ids2[best], s2[best]
                    if len(best) == k:
                        least[i] = int(s2[best[-1]])
        return found


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """id, label, vector as whole numbers, its length and dimension, of the rows that take part."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(sound)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("long")))
    square = F.aggregate("vector", F.lit(0.0), lambda n, x: n + x.cast("double") * x)
    return rows.withColumn("length", F.sqrt(square)).withColumn("dim", F.size("vector"))


def once(rows: DataFrame) -> DataFrame:
    """One row an id, that with the smallest label and vector; only rows of repeated ids are shuffled."""
    many = keep(rows.groupBy("id").count().where("count > 1").select("id"))
    if many.isEmpty():
        return rows
    rest = [c for c in rows.columns if c != "id"]
    again = rows.join(many, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*rest)).alias("x")).select("id", "x.*")
    return rows.join(many, "id", "left_anti").select("id", *rest).unionByName(again)


def _classes(rows: DataFrame, keys: list[str], cuts: list[float]) -> tuple[DataFrame, DataFrame]:
    """Rows with their class and shard, and by class its shards and greatest length."""
    rank = sum((F.when(F.col("length") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = rows.withColumn("class", rank)
    table = keep(rows.groupBy(*keys, "class").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"), F.max("length").alias("longest")))
    return rows.join(table.drop("longest"), [*keys, "class"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).drop("shards"), table


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = table.column("vector").combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    return ids, labels, x


def _search(rows: DataFrame, anchors: DataFrame, keys: list[str], cuts: list[float], blocks: int, asked: Column | None, k: int) -> DataFrame:
    """anchors: id, label, vector, length, wanted (array of id, score, least, most). Per anchor and wanted, each shard's best.

    asked: the least score an anchor asks for at all, None for any.
    """
    rows, table = _classes(rows, keys, cuts)
    can = F.lit(True) if asked is None else asked <= F.col("length") * F.col("longest") * (1 + SLACK)
    sent = anchors.join(table, keys).where(can).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    sent = sent.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).drop("shards", "longest", "length")
    rows = rows.drop("length").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    group, same = [*keys, "class", "shard", "block"], "label" in keys
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "id", "score")])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        shard, out = Shard(*_arrays(left)), [[] for _ in schema]
        ids, labels = right.column("id").to_pylist(), right.column("label").to_pylist()
        for own, label, q, wanted in zip(ids, labels, right.column("vector"), right.column("wanted").to_pylist(), strict=True):
            q = q.values.to_numpy(zero_copy_only=False)
            for w, (i, s) in zip(wanted, shard.search(own, label, q, [(w["least"], w["most"]) for w in wanted], k, same), strict=True):
                for column, values in zip(out, (np.full(len(i), own), np.full(len(i), w["id"]), np.full(len(i), w["score"]), i, s), strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for c in out], schema=schema)

    return rows.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(search, "anchor_id long, positive_id long, positive_score long, id long, score long")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """vectors, anchors: id, label, vector array. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows, asked = once(usable(vectors, scale)), keep(once(usable(anchors, scale)))
    blocks = max(1, -(-asked.count() // BLOCK_ANCHORS))
    cuts = rows.agg(F.percentile_approx("length", [i / CLASSES for i in range(1, CLASSES)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    anything = F.expr("array(named_struct('id', -1L, 'score', 0L, 'least', cast(null as long), 'most', cast(null as long)))")
    near = _search(rows, asked.withColumn("wanted", anything), ["dim", "label"], cuts, blocks, None, positives)
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    near = near.withColumn("rank", best).where(F.col("rank") <= positives).where("score >= 0")
    least = F.expr(f"(score * {low} + 99) div 100")
    most = F.expr(f"score * {high} div 100")
    wanted = F.struct("id", "score", least.alias("least"), most.alias("most"))  # scores of 0 or more
    near = keep(near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(wanted)).alias("wanted")))
    sent = asked.join(near.withColumnRenamed("anchor_id", "id"), "id")
    found = _search(rows, sent, ["dim"], cuts, blocks, F.array_min(F.transform("wanted", lambda w: w["least"])), negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows_of(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, rows.where(F.col("id") % 100 == 0))


SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
QUERIES: dict[str, Callable] = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": SQL}
