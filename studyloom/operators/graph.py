"""The concept graph: edges (edge_id, source_id, target_id, relation, confidence), concepts (concept_id, name).

Traversals start from a table of seeds at once and go level by level; each level is
written to the shared folder, and visited nodes leave by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.sources.store import keep

DEPTH_MOST = 8
#: Levels of a chain between two looks for cycles.
CHECK_LEVELS = 16


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, edge_id, relation, confidence, in both directions."""
    rest = ["edge_id", "relation", "confidence"]
    return edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), *rest).unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), *rest))


def edges_of(edges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The k most confident edges that touch each concept, as a union of two equi-joins."""
    touching = both_ways(edges).join(ids.select(F.col("concept_id").alias("node")).distinct(), "node")
    once = touching.dropDuplicates(["node", "edge_id"])
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "edge_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out, back = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")), edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("next"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def traverse(edges: DataFrame, seeds: DataFrame, direction: str = "out", depth: int = DEPTH_MOST) -> DataFrame:
    """seed, node, distance of the first visit; the seed itself at 0."""
    steps = keep(_steps(edges, direction))
    front = seeds.select(F.col("concept_id").alias("seed"), F.col("concept_id").alias("node"), F.lit(0).alias("distance")).distinct()
    seen = front
    for level in range(1, min(depth, DEPTH_MOST) + 1):
        nxt = front.join(steps, "node").select("seed", F.col("next").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
        front = keep(nxt.withColumn("distance", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _ball(steps: DataFrame, ends: DataFrame, radius: int, away: bool) -> DataFrame:
    """end, node, path of all nodes within a radius of each end: the smallest of the shortest lists of nodes, from the end or (not away) to it."""
    front = ends.select("end", F.col("end").alias("node"), F.array("end").alias("path"))
    every = front
    for _ in range(radius):
        longer = F.concat("path", F.array("next")) if away else F.concat(F.array("next"), "path")
        nxt = front.join(steps, "node").select("end", F.col("next").alias("node"), longer.alias("path")).groupBy("end", "node").agg(F.min("path").alias("path"))
        front = keep(nxt.join(every.select("end", "node"), ["end", "node"], "left_anti").select("end", "node", "path"))
        every = every.unionByName(front)
    return every


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 4) -> DataFrame:
    """pairs: source, target. source, target, path, edges, length of an undirected shortest path with up to depth edges.

    Of equally short ones the smallest list of nodes; of parallel edges the smallest id. A pair of equal ends is a path of one node.
    A search goes half the way from each end, so that it meets few of the nodes that are so far away as the path is long.
    """
    steps = keep(_steps(edges, "both"))
    wanted = pairs.select("source", "target").where("source is not null and target is not null").distinct()
    same = wanted.where("source = target").select("source", "target", F.array("source").alias("path"))
    wanted = keep(wanted.where("source <> target"))
    # one search an end, whatever the number of its pairs; the two parts of a smallest path are smallest themselves
    near = _ball(steps, wanted.select(F.col("source").alias("end")).distinct(), (depth + 1) // 2, True)
    far = _ball(steps, wanted.select(F.col("target").alias("end")).distinct(), depth // 2, False)
    met = wanted.join(far.select(F.col("end").alias("target"), "node", F.slice("path", F.lit(2), F.size("path")).alias("rest")), "target")
    met = met.join(near.select(F.col("end").alias("source"), "node", "path"), ["source", "node"]).select("source", "target", F.concat("path", "rest").alias("path"))
    best = met.groupBy("source", "target").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("b"))
    found = same.unionByName(best.select("source", "target", "b.path"))
    found = keep(found.select("source", "target", "path"))
    ends = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))
    hop = found.select("source", "target", F.posexplode(ends).alias("nth", "s")).select("source", "target", "nth", F.least("s.a", "s.b").alias("lo"), F.greatest("s.a", "s.b").alias("hi"))
    one = edges.groupBy(F.least("source_id", "target_id").alias("lo"), F.greatest("source_id", "target_id").alias("hi")).agg(F.min("edge_id").alias("edge_id"))
    used = hop.join(one, ["lo", "hi"]).groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "edge_id"))), lambda x: x["edge_id"]).alias("edges"))
    none = F.array().cast(used.schema["edges"].dataType)
    return found.join(used, ["source", "target"], "left").select("source", "target", "path", F.coalesce("edges", none).alias("edges"), (F.size("path") - 1).alias("length"))


def prerequisite_edges(edges: DataFrame) -> DataFrame:
    kind = F.lower("relation")
    return edges.where(kind.contains("require") | kind.contains("depend") | kind.contains("prereq"))


def prerequisite_chain(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, node, distance, place: what to learn before a target, farthest first.

    The distance is that of the longest way. No way without a cycle has more edges than the
    target has nodes, so longer ones aren't followed; that ends cycles and nothing else.
    """
    steps = keep(prerequisite_edges(edges).select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct())
    front = targets.select(F.col("concept_id").alias("target"), F.col("concept_id").alias("node")).distinct()
    every, level = None, 0
    while True:
        level += 1
        front = keep(front.join(steps, "node").select("target", F.col("next").alias("node")).where("node <> target").distinct())
        if front.isEmpty():
            break
        here = front.withColumn("distance", F.lit(level))
        every = here if every is None else every.unionByName(here)
        if level % CHECK_LEVELS == 0:
            # each level up to the last new node has one, so whoever has more levels than nodes has met all its nodes
            n = every.groupBy("target").agg(F.countDistinct("node").alias("n"))
            every = keep(every.join(n, "target").where("distance <= n").groupBy("target", "node").agg(F.max("distance").alias("distance")))
            front = keep(front.join(n.where(F.col("n") >= level), "target", "left_semi"))
    if every is None:
        every = front.withColumn("distance", F.lit(0))
    last = every.groupBy("target", "node").agg(F.max("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("distance"), F.col("node").cast("string")))
    return last.withColumn("place", place)


def explain_concepts(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per concept: its prerequisites, dependents and neighbours by other relations (sorted ids), counts of edges in and out."""
    pre = prerequisite_edges(edges)
    needs = pre.groupBy(F.col("source_id").alias("concept_id")).agg(F.array_sort(F.collect_set("target_id")).alias("prerequisites"))
    wanted = pre.groupBy(F.col("target_id").alias("concept_id")).agg(F.array_sort(F.collect_set("source_id")).alias("dependents"))
    near = both_ways(edges).join(pre.select("edge_id").distinct(), "edge_id", "left_anti").where("node <> other")
    related = near.groupBy(F.col("node").alias("concept_id")).agg(F.array_sort(F.collect_set("other")).alias("related"))
    out = edges.groupBy(F.col("source_id").alias("concept_id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("target_id").alias("concept_id")).agg(F.count("*").alias("n_in"))
    df = concepts.select("concept_id")
    for other in (needs, wanted, related, out, into):
        df = df.join(other, "concept_id", "left")
    none = F.expr("cast(array() as array<bigint>)")
    return df.select("concept_id", *[F.coalesce(c, none).alias(c) for c in ("prerequisites", "dependents", "related")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_out", "n_in")])


def subgraph(edges: DataFrame, roots: DataFrame, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within a radius of each root (seed, node, distance), and all edges between them (seed, edge_id)."""
    nodes = traverse(edges, roots, "both", min(radius, 5))
    left = nodes.select("seed", F.col("node").alias("source_id"))
    right = nodes.select("seed", F.col("node").alias("target_id"))
    return nodes, edges.join(left, "source_id").join(right, ["seed", "target_id"]).select("seed", "edge_id")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable), by least labels of neighbours and pointer jumping."""
    pairs = both_ways(edges).select("node", "other").where("node <> other").distinct()
    pairs = keep(pairs)
    labels = keep(pairs.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = pairs.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        heads = labels.select(F.col("node").alias("label"), F.col("label").alias("head"))
        moved = keep(nearer.join(heads, "label").select("node", F.least("label", "head").alias("label"), "old"))
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def graph_stats(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components (single nodes too), mean degree over distinct neighbours."""
    ids = concepts.select("concept_id").distinct()
    inside = edges.join(ids.select(F.col("concept_id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("concept_id").alias("target_id")), "target_id", "left_semi")
    degree = both_ways(inside).select("node", "other").distinct().agg(F.count("*").alias("ends"))
    labels = components(inside)
    n = labels.agg(F.countDistinct("label").alias("joined"), F.count("*").alias("linked"))
    counts = ids.agg(F.count("*").alias("n_concepts"))
    rows = edges.agg(F.countDistinct("edge_id").alias("n_edges"))
    one = counts.crossJoin(rows).crossJoin(n).crossJoin(degree)  # single rows
    return one.select("n_concepts", "n_edges", (F.col("joined") + F.col("n_concepts") - F.col("linked")).alias("n_components"), (F.col("ends") / F.greatest(F.col("n_concepts"), F.lit(1))).alias("average_degree"))


def bottlenecks(concepts: DataFrame, edges: DataFrame, k: int, depth: int = DEPTH_MOST) -> DataFrame:
    """The k concepts with most edges, then most reachable ones, then name."""
    degree = both_ways(edges).dropDuplicates(["node", "edge_id"]).groupBy(F.col("node").alias("concept_id")).agg(F.count("*").alias("centrality"))
    down = traverse(edges, concepts, "out", depth).where("distance > 0").groupBy(F.col("seed").alias("concept_id")).agg(F.count("*").alias("n_downstream"))
    df = concepts.select("concept_id").join(degree, "concept_id", "left").join(down, "concept_id", "left").fillna(0, ["centrality", "n_downstream"])
    return df.orderBy(F.desc("centrality"), F.desc("n_downstream"), F.col("concept_id").cast("string")).limit(k)
