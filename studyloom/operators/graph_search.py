"""Search in the concept graph: hits hop by hop with their provenance, and the part of the graph that answers a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.operators.graph import edges_of, shortest_paths, traverse
from studyloom.sources.store import keep

# Edges of a seed, notes of a concept, chunks of a note, nodes down, up and around, and hops.
EDGES, NOTES, CHUNKS, DOWN, UP, AROUND, HOPS = 4, 2, 2, 12, 6, 6, 2
# What a hit scores, by kind and way: of the seed, of the edge or concept, and at least.
SEED_BONUS, EDGE_PART, NODE_PART = 0.12, 0.25, 0.18
NOTE_BY_EDGE, CHUNK_BY_EDGE, NOTE_BY_NODE = (0.52, 0.28, 0.24), (0.42, 0.22, 0.2), (0.42, 0.22, 0.2)
# Fixed values of a context: neighbours each way, hops up and down, edges of a concept, concepts that paths are sought between, and their greatest length.
CONTEXT_NEAR, CONTEXT_HOPS, CONTEXT_EDGES, PATH_ENDS, PATH_MOST = 8, 3, 32, 8, 5


def _first(df: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the row that comes first in its query."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), "place").alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def _nearest(edges: DataFrame, ids: DataFrame, direction: str, depth: int, most: int) -> DataFrame:
    """seed, node, nth of the nodes within so many hops, nearest first, then by id."""
    found = traverse(edges, ids, direction, depth).where("distance > 0")
    nth = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).select("seed", "node", "nth")


def graph_retrieve(seeds: DataFrame, concepts: DataFrame, edges: DataFrame, notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """seeds: query_id, nth, concept_id, rank (a score). concepts: concept_id, confidence. notes: concept_id, note_id, nth. chunks: note_id, chunk_id, nth.

    query_id, place, kind, id, score, via (the edge), path (seed, concept, note, chunk as far as the hit goes). A seed's
    strongest edges lead to concepts, their first notes and those's first chunks; then come concepts below, above and
    around it, with notes. A query visits a concept, note or chunk once, where it comes first; what hangs on a concept
    or note that was visited before isn't followed.
    """
    seeds = keep(seeds.select("query_id", F.col("nth").alias("seed_nth"), F.col("concept_id").alias("seed"), F.col("rank").alias("seed_rank")))
    ids = seeds.select(F.col("seed").alias("concept_id")).distinct()
    place = lambda stage, nth: F.struct("seed_nth", F.lit(stage).alias("stage"), F.col(nth).alias("nth"))
    known = concepts.select(F.col("concept_id").alias("node"), F.col("confidence").alias("node_confidence"))
    by_edge = edges_of(edges, ids, EDGES).select(F.col("node").alias("seed"), F.col("other").alias("node"), F.col("rank").alias("nth"), F.col("edge_id").alias("via"), F.col("confidence").alias("strength"))
    one = seeds.join(by_edge.where("node <> seed"), "seed").withColumn("place", place(1, "nth"))
    ways = [_nearest(edges, ids, d, n, most).withColumn("nth", F.col("nth") + 1000 * i) for i, (d, n, most) in enumerate((("out", HOPS, DOWN), ("in", HOPS, UP), ("both", 1, AROUND)))]
    two = seeds.join(ways[0].unionByName(ways[1]).unionByName(ways[2]), "seed").withColumn("via", F.lit(None).cast(edges.schema["edge_id"].dataType)).withColumn("strength", F.lit(None).cast("double")).withColumn("place", place(2, "nth"))
    own = seeds.select("query_id", F.col("seed").alias("node"), "seed", "seed_rank", F.struct("seed_nth", F.lit(0).alias("stage"), F.lit(0).alias("nth")).alias("place"), F.lit(None).cast(edges.schema["edge_id"].dataType).alias("via"), F.lit(None).cast("double").alias("strength"))
    columns = own.columns
    met = one.select(*columns).unionByName(two.select(*columns)).join(known, "node")
    reached = keep(_first(met.select(*columns, "node_confidence").unionByName(own.withColumn("node_confidence", F.col("seed_rank"))), ["query_id", "node"]).where("place.stage > 0"))
    hit = lambda df, kind, key, score, path: df.select("query_id", "place", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), score.alias("score"), "via", F.array(*[F.col(c).cast("string") for c in path]).alias("path"))
    edge = F.col("place.stage") == 1
    mixed = lambda a: F.greatest(F.lit(a[2]), F.col("seed_rank") * a[0] + F.coalesce("strength", "node_confidence") * a[1])
    plus = F.when(edge, F.col("strength") * EDGE_PART).otherwise(F.col("node_confidence") * NODE_PART)
    inside = lambda sub: F.struct("place.seed_nth", "place.stage", "place.nth", F.col(sub).alias("sub"))
    few = lambda df, n: df.withColumn("sub", F.row_number().over(Window.partitionBy(df.columns[0]).orderBy("nth", df.columns[1]))).where(F.col("sub") <= n).drop("nth")
    with_notes = reached.join(few(notes.select(F.col("concept_id").alias("node"), "note_id", "nth"), NOTES), "node").withColumn("at", inside("sub")).drop("place", "sub").withColumnRenamed("at", "place")
    with_notes = keep(_first(with_notes, ["query_id", "note_id"]))
    with_chunks = with_notes.where(edge).join(few(chunks.select("note_id", "chunk_id", "nth"), CHUNKS), "note_id")
    with_chunks = _first(with_chunks.withColumn("at", F.struct("place.seed_nth", "place.stage", "place.nth", (F.col("place.sub") * 10 + F.col("sub")).alias("sub"))).drop("place", "sub").withColumnRenamed("at", "place"), ["query_id", "chunk_id"])
    rows = [
        hit(own, "concept", "node", F.col("seed_rank") + SEED_BONUS, ["seed"]),
        hit(reached, "concept", "node", F.col("node_confidence") + plus, ["seed", "node"]),
        hit(with_notes, "note", "note_id", F.when(edge, mixed(NOTE_BY_EDGE)).otherwise(mixed(NOTE_BY_NODE)), ["seed", "node", "note_id"]),
        hit(with_chunks, "chunk", "chunk_id", mixed(CHUNK_BY_EDGE), ["seed", "node", "note_id", "chunk_id"]),
    ]
    sub = (F.lit(0), F.lit(0), F.col("place.sub") * 10, None)
    flat = [r.withColumn("place", F.struct("place.seed_nth", "place.stage", "place.nth", (F.col("place.sub") if s is None else s).cast("int").alias("sub"))) for r, s in zip(rows, sub, strict=True)]
    out = flat[0]
    for r in flat[1:]:
        out = out.unionByName(r)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "kind", "id")))


def graph_context(seeds: DataFrame, concepts: DataFrame, edges: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """seeds: query_id, nth, concept_id. concepts: concept_id, name. Of each query its concepts, edges and paths, each once.

    Concepts (query_id, rank, concept_id) are the seeds and those around, above and below them and at the other end of
    their edges, by name; edges (query_id, edge_id) are the strongest of its seeds and concepts, and those of paths; paths
    (query_id, source, target, path, edges) join any two of its first concepts. A pair that several queries ask for is sought once.
    """
    seeds = keep(seeds.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("nth", "concept_id"))).where(F.col("n") <= most).select("query_id", F.col("concept_id").alias("seed")))
    ids = seeds.select(F.col("seed").alias("concept_id")).distinct()
    near = None
    for i, (direction, depth) in enumerate((("both", 1), ("in", CONTEXT_HOPS), ("out", CONTEXT_HOPS))):
        part = _nearest(edges, ids, direction, depth, CONTEXT_NEAR).withColumn("nth", F.col("nth") + 1000 * i)
        near = part if near is None else near.unionByName(part)
    near = near.groupBy("seed", "node").agg(F.min("nth").alias("nth"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("nth"))).where(F.col("n") <= most).select("seed", "node")
    own = keep(edges_of(edges, ids, CONTEXT_EDGES).select(F.col("node").alias("seed"), F.col("other").alias("node"), "edge_id"))
    around = near.unionByName(own.select("seed", "node")).unionByName(ids.select(F.col("concept_id").alias("seed"), F.col("concept_id").alias("node"))).distinct()
    named = seeds.join(around, "seed").select("query_id", F.col("node").alias("concept_id")).distinct().join(concepts.select("concept_id", "name"), "concept_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.lower("name"), "concept_id"))
    chosen = keep(named.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "concept_id"))
    ends = chosen.where(F.col("rank") <= PATH_ENDS).select("query_id", "concept_id")
    pairs = keep(ends.withColumnRenamed("concept_id", "source").join(ends.withColumnRenamed("concept_id", "target"), "query_id").where("source < target"))
    paths = keep(pairs.join(shortest_paths(edges, pairs.select("source", "target").distinct(), PATH_MOST), ["source", "target"]).select("query_id", "source", "target", "path", "edges"))
    strong = edges_of(edges, chosen.select("concept_id").distinct(), CONTEXT_EDGES).select(F.col("node").alias("concept_id"), "edge_id")
    used = seeds.join(own.select("seed", "edge_id"), "seed").select("query_id", "edge_id")
    used = used.unionByName(chosen.join(strong, "concept_id").select("query_id", "edge_id")).unionByName(paths.select("query_id", F.explode("edges").alias("edge_id"))).distinct()
    return chosen, used, paths
