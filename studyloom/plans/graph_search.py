"""Queries of the search in the concept graph; every twenty parts ask for their largest ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import graph_search as op
from studyloom.plans._tables import EDGES, concepts, edges, table

_SEEDS = 3


def _seeds(spark, d):
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("query_id"), F.col("p_partkey").alias("concept_id"), (F.col("p_size") / 50.0).alias("rank"))
    best = p.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", F.negative("concept_id").alias("c"))), False), 1, _SEEDS).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("nth", "x")).select("query_id", "nth", F.negative("x.c").alias("concept_id"), "x.rank")


def f9_graph_retrieval(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), (F.col("p_size") / 60.0).alias("confidence"))
    note = lambda by, plus, nth: c.select("concept_id", (F.floor(F.col("concept_id") / by) + plus).alias("note_id"), F.lit(nth).alias("nth"))
    notes = note(3, 0, 0).unionByName(note(5, 100_000, 1)).unionByName(note(7, 200_000, 2))
    chunks = notes.select("note_id").distinct().select("note_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("nth")).withColumn("chunk_id", F.col("note_id") * 10 + 9 - F.col("nth"))
    df = op.graph_retrieve(_seeds(spark, d), c, edges(spark, d), notes, chunks)
    return df.select("query_id", "place", "kind", "id", F.round("score", 9).alias("score"), "via", F.array_join("path", ">").alias("path"))


def e11_graph_context(spark, d):
    chosen, used, paths = op.graph_context(_seeds(spark, d), concepts(spark, d), edges(spark, d))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    rows = chosen.select("query_id", F.lit("concept").alias("kind"), F.col("rank").cast("string").alias("a"), F.col("concept_id").cast("string").alias("b"))
    rows = rows.unionByName(used.select("query_id", F.lit("edge").alias("kind"), F.col("edge_id").cast("string").alias("a"), F.lit("").alias("b")))
    return rows.unionByName(paths.select("query_id", F.lit("path").alias("kind"), joined("path").alias("a"), joined("edges").alias("b")))


QUERIES = {f.__name__: f for f in (f9_graph_retrieval, e11_graph_context)}

_SEED = f"seeds AS MATERIALIZED (SELECT p_partkey // 20 AS query_id, (row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_size DESC, p_partkey) - 1)::int AS seed_nth, p_partkey AS seed, p_size / 50::double AS seed_rank FROM part QUALIFY seed_nth < {_SEEDS})"
_TWO = "two AS MATERIALIZED (SELECT source_id AS node, target_id AS other, edge_id, confidence FROM edges UNION ALL SELECT target_id, source_id, edge_id, confidence FROM edges)"
_TOP = "SELECT node, other, edge_id, confidence, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, edge_id) AS nth FROM (SELECT DISTINCT ON (node, edge_id) * FROM two)"


def _walk(name: str, a: str, b: str, source: str, depth: int, most: int) -> str:
    """Nodes within so many hops of each seed, nearest first."""
    hops = f"{name}0 AS (SELECT DISTINCT seed, seed AS node, 0 AS distance FROM seeds)"
    for i in range(1, depth + 1):
        hops += f", {name}{i} AS MATERIALIZED (SELECT * FROM {name}{i - 1} UNION ALL SELECT DISTINCT r.seed, e.{b}, {i} FROM {name}{i - 1} r JOIN {source} e ON e.{a} = r.node WHERE r.distance = {i - 1} AND (r.seed, e.{b}) NOT IN (SELECT (seed, node) FROM {name}{i - 1}))"
    return f"{hops}, {name} AS (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS nth FROM {name}{depth} WHERE distance > 0 QUALIFY nth <= {most})"


ORACLES = {
    "f9_graph_retrieval": f"""WITH {EDGES}, {_SEED}, {_TWO}, top AS ({_TOP}), {_walk("dn", "source_id", "target_id", "edges", op.HOPS, op.DOWN)}, {_walk("up", "target_id", "source_id", "edges", op.HOPS, op.UP)}, {_walk("ar", "node", "other", "two", 1, op.AROUND)},
w AS (SELECT seed, node, nth FROM dn UNION ALL SELECT seed, node, nth + 1000 FROM up UNION ALL SELECT seed, node, nth + 2000 FROM ar),
met AS (SELECT query_id, seed_nth, 0 AS stage, 0 AS nth, seed, seed_rank, seed AS node, NULL AS via, NULL::double AS strength FROM seeds
 UNION ALL SELECT query_id, seed_nth, 1, t.nth, seed, seed_rank, t.other, t.edge_id, t.confidence FROM seeds JOIN top t ON t.node = seed WHERE t.nth <= {op.EDGES} AND t.other <> seed
 UNION ALL SELECT query_id, seed_nth, 2, w.nth, seed, seed_rank, w.node, NULL, NULL FROM seeds JOIN w USING (seed)),
c AS (SELECT p_partkey AS node, p_size / 60::double AS nc FROM part), re AS (SELECT met.*, nc, row_number() OVER (PARTITION BY query_id, node ORDER BY seed_nth, stage, nth) AS k FROM met JOIN c USING (node)), r AS (SELECT * FROM re WHERE k = 1 AND stage > 0),
cn AS (SELECT node, node // 3 AS note_id, 1 AS sub FROM c UNION ALL SELECT node, node // 5 + 100000, 2 FROM c), n0 AS (SELECT r.*, note_id, sub, row_number() OVER (PARTITION BY query_id, note_id ORDER BY seed_nth, stage, nth, sub) AS k2 FROM r JOIN cn USING (node)), n AS (SELECT * FROM n0 WHERE k2 = 1),
h AS (SELECT query_id, seed_nth, stage, nth, sub * 10 + i AS sub, note_id * 10 + 10 - i AS chunk_id, n.* EXCLUDE (query_id, seed_nth, stage, nth, sub) FROM n, (SELECT unnest([1, 2]) AS i) WHERE stage = 1),
a AS (SELECT query_id, seed_nth, 0 AS stage, 0 AS nth, 0 AS sub, 'concept' AS kind, seed AS id, seed_rank + {op.SEED_BONUS}::double AS score, NULL AS via, seed::varchar AS path FROM seeds
 UNION ALL SELECT query_id, seed_nth, stage, nth, 0, 'concept', node, nc + CASE WHEN stage = 1 THEN strength * {op.EDGE_PART}::double ELSE nc * {op.NODE_PART}::double END, via, seed || '>' || node FROM r
 UNION ALL SELECT query_id, seed_nth, stage, nth, sub * 10, 'note', note_id, CASE WHEN stage = 1 THEN greatest(0.24::double, seed_rank * 0.52::double + strength * 0.28::double) ELSE greatest(0.2::double, seed_rank * 0.42::double + nc * 0.22::double) END, via, seed || '>' || node || '>' || note_id FROM n
 UNION ALL SELECT query_id, seed_nth, stage, nth, sub, 'chunk', chunk_id, greatest(0.2::double, seed_rank * 0.42::double + strength * 0.22::double), via, seed || '>' || node || '>' || note_id || '>' || chunk_id FROM h)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY seed_nth, stage, nth, sub, kind, id::varchar))::int AS place, kind, id::varchar AS id, round(score, 9) AS score, via, path FROM a""",
    "e11_graph_context": f"""WITH RECURSIVE {EDGES}, {_SEED}, {_TWO}, top AS MATERIALIZED ({_TOP} QUALIFY nth <= {op.CONTEXT_EDGES}), {_walk("ar", "node", "other", "two", 1, op.CONTEXT_NEAR)}, {_walk("up", "target_id", "source_id", "edges", op.CONTEXT_HOPS, op.CONTEXT_NEAR)}, {_walk("dn", "source_id", "target_id", "edges", op.CONTEXT_HOPS, op.CONTEXT_NEAR)},
w AS (SELECT seed, node, min(nth) AS nth FROM (SELECT seed, node, nth FROM ar UNION ALL SELECT seed, node, nth + 1000 FROM up UNION ALL SELECT seed, node, nth + 2000 FROM dn) GROUP BY ALL), nr AS (SELECT seed, node FROM w QUALIFY row_number() OVER (PARTITION BY seed ORDER BY nth) <= 20),
nm AS (SELECT DISTINCT query_id, node FROM (SELECT query_id, nr.node FROM seeds JOIN nr USING (seed) UNION ALL SELECT query_id, other FROM seeds JOIN top ON node = seed UNION ALL SELECT query_id, seed FROM seeds)),
ch AS MATERIALIZED (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY lower(p_name), node) AS rank FROM nm JOIN part ON p_partkey = node QUALIFY rank <= 20),
pr AS MATERIALIZED (SELECT a.query_id, a.node AS source, b.node AS target FROM ch a JOIN ch b ON a.query_id = b.query_id AND a.node < b.node WHERE a.rank <= {op.PATH_ENDS} AND b.rank <= {op.PATH_ENDS}), st AS MATERIALIZED (SELECT node, other, min(edge_id) AS edge_id FROM two GROUP BY ALL),
so AS (SELECT DISTINCT source FROM pr), f0 AS (SELECT source, source AS node, 0 AS d, [source] AS path, CAST([] AS BIGINT[]) AS es FROM so),
{", ".join(f"f{i} AS MATERIALIZED (SELECT * FROM f{i - 1} UNION ALL SELECT source, other, {i}, b[1], b[2] FROM (SELECT f.source, t.other, min((list_append(f.path, t.other), list_append(f.es, t.edge_id))) AS b FROM f{i - 1} f JOIN st t ON t.node = f.node WHERE f.d = {i - 1} AND (f.source, t.other) NOT IN (SELECT (source, node) FROM f{i - 1}) GROUP BY ALL))" for i in range(1, op.PATH_MOST + 1))},
pt AS MATERIALIZED (SELECT pr.query_id, path, es FROM pr JOIN f{op.PATH_MOST} f ON f.source = pr.source AND f.node = pr.target)
SELECT query_id, 'concept' AS kind, rank::varchar AS a, node::varchar AS b FROM ch UNION ALL SELECT query_id, 'path', array_to_string(path, ','), array_to_string(es, ',') FROM pt
UNION ALL SELECT DISTINCT query_id, 'edge', edge_id::varchar, '' FROM (SELECT query_id, edge_id FROM seeds JOIN top ON node = seed UNION ALL SELECT query_id, edge_id FROM ch JOIN top ON top.node = ch.node UNION ALL SELECT query_id, unnest(es) FROM pt)""",
}
