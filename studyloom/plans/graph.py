"""Queries of the graph, planning, signal, evaluation and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import evaluate, graph, planning, signals
from studyloom.plans._tables import EDGES, MASTERY, concepts, edges, mastery, table
from studyloom.streaming import events as streaming


def e1_edges_of(spark, d):
    return graph.edges_of(edges(spark, d), concepts(spark, d), 3).select("node", "rank", "edge_id")


def e2_traverse(spark, d):
    return graph.traverse(edges(spark, d), concepts(spark, d), "out", 8)


def e3_ancestors(spark, d):
    return graph.traverse(edges(spark, d), concepts(spark, d), "in", 2).where("distance > 0")


def e4_shortest_paths(spark, d):
    p = table(spark, d, "part").where("p_partkey >= 6").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 6).alias("target"))
    p = p.unionByName(p.select("source", F.col("source").alias("target")))
    df = graph.shortest_paths(edges(spark, d), p, 3)
    return df.select("source", "target", "length", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("path", "edges")])


def e5_prerequisite_edges(spark, d):
    return graph.prerequisite_edges(edges(spark, d)).select("edge_id")


def e6_prerequisite_chain(spark, d):
    return graph.prerequisite_chain(edges(spark, d), concepts(spark, d)).select("target", "node", "distance", "place")


def e7_explain_concepts(spark, d):
    df = graph.explain_concepts(concepts(spark, d), edges(spark, d))
    return df.select("concept_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("prerequisites", "dependents", "related")], "n_out", "n_in")


def e8_subgraph(spark, d):
    nodes, inside = graph.subgraph(edges(spark, d), concepts(spark, d), 1)
    return nodes.groupBy("seed").agg(F.count("*").alias("n_nodes")).join(inside.groupBy("seed").agg(F.count("*").alias("n_edges")), "seed", "left")


def e12_graph_stats(spark, d):
    return graph.graph_stats(concepts(spark, d), edges(spark, d)).select("n_concepts", "n_edges", "n_components", F.round("average_degree", 9).alias("average_degree"))


def e13_bottlenecks(spark, d):
    return graph.bottlenecks(concepts(spark, d), edges(spark, d), 20)


def i1_detect_gaps(spark, d):
    return planning.detect_gaps(concepts(spark, d), edges(spark, d), mastery(spark, d)).select("concept_id", "reason", F.round("severity", 9).alias("severity"))


def i6_prerequisite_plan(spark, d):
    return planning.prerequisite_plan(edges(spark, d), concepts(spark, d), mastery(spark, d)).select("target", "place", "node", "reason")


def i7_learning_path(spark, d):
    plan = planning.prerequisite_plan(edges(spark, d), concepts(spark, d), mastery(spark, d))
    return planning.learning_path(plan).groupBy("target", "stage").agg(F.count("*").alias("n"))


def i15_unstarted(spark, d):
    return planning.unstarted(concepts(spark, d), mastery(spark, d).where("mastery > 0.2")).select("concept_id")


def _tasks(spark, d):
    m = mastery(spark, d)
    name = F.col("concept_id").cast("string").alias("concept")
    weak = m.where("mastery < 0.5").select(name, (0.9 - F.col("mastery") / 10).alias("priority"), F.lit("weakConcept").alias("reason"), F.lit(2).alias("depth"))
    due = m.where("mistake_count > 1").select(name, (0.7 + F.col("mistake_count") / 8.0).alias("priority"), F.lit("reviewDue").alias("reason"), F.lit(-1).alias("depth"))
    return weak.unionByName(due)


def i9_merge_tasks(spark, d):
    return planning.merge_tasks(_tasks(spark, d)).select("concept", "reason", F.round("priority", 9).alias("priority"), "place")


def i13_pack_days(spark, d):
    return planning.pack_days(planning.merge_tasks(_tasks(spark, d)), 14, 45).select("concept", "day")


def i14_plan_totals(spark, d):
    return planning.plan_totals(planning.pack_days(planning.merge_tasks(_tasks(spark, d)), 14, 45))


def _signals(spark, d):
    kind = F.col("event_type")
    t = F.when(kind == "click", "accepted").when(kind == "error", "markedStillConfused").when(kind == "purchase", "markedHelpful").when(kind == "signup", "lightlyEdited").otherwise("requestedAgain")
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("proposal_id"), t.alias("signal_type"), F.array(F.col("user_id"), F.col("user_id") + 1).alias("concept_ids"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def l1_dedupe_signals(spark, d):
    return signals.dedupe_signals(_signals(spark, d)).select("proposal_id", "signal_type", "event_id")


def l2_profiles(spark, d):
    return signals.profiles(_signals(spark, d)).select("concept_id", "helpful", "accept", "lightly_edited", "confused", "requested_again")


def l3_profile_mastery(spark, d):
    df = signals.profile_mastery(signals.profiles(_signals(spark, d)))
    return df.select("concept_id", *[F.round(c, 9).alias(c) for c in ("helpful_ratio", "confusion_ratio", "mastery")])


def l4_history_flags(spark, d):
    return signals.history_flags(signals.profiles(_signals(spark, d)))


def l6_event_statistics(spark, d):
    return signals.event_statistics(table(spark, d, "events"), ["click", "error", "purchase", "signup", "view"])


def l9_respect_opt_out(spark, d):
    e = table(spark, d, "events")
    return signals.respect_opt_out(e, e.where("event_type = 'error' and value > 60").select("user_id").distinct()).groupBy("user_id").agg(F.count("*").alias("n"))


def _records(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("run"), F.col("l_orderkey").alias("note_id"), F.col("l_linestatus").alias("category"), (F.col("l_discount") * 10).alias("score"), F.col("l_quantity").cast("double").alias("latency"), (F.col("l_tax") < 0.07).alias("parsed"))


def m9_run_summary(spark, d):
    return evaluate.run_summary(_records(spark, d)).select("run", "n", F.round("score", 6).alias("score"), F.round("latency", 6).alias("latency"))


def m10_compare_runs(spark, d):
    r = _records(spark, d).groupBy("run", "note_id").agg(F.round(F.max("score"), 6).alias("score"))
    return evaluate.compare_runs(r.where("run = 'A'"), r.where("run = 'N'")).select("note_id", F.round("delta", 6).alias("delta"), "changed")


def m11_regressions(spark, d):
    s = evaluate.run_summary(_records(spark, d))
    df = evaluate.regressions(s.where("run = 'A'"), s.where("run = 'N'"), ["score", "latency"])
    return df.select("metric", *[F.round(c, 6).alias(c) for c in ("baseline", "comparison", "delta")])


def m12_rank_runs(spark, d):
    return evaluate.rank_runs(evaluate.run_summary(_records(spark, d))).select("run", "rank")


def m13_weaknesses(spark, d):
    return evaluate.weaknesses(_records(spark, d), {"low_score": F.col("score") < 0.2, "slow": F.col("latency") > 45, "never": F.col("latency") > 1000})


def m17_model_comparison(spark, d):
    df = evaluate.model_comparison(_records(spark, d))
    return df.select("category", "run", F.round("parse_rate", 9).alias("parse_rate"), F.round("latency", 6).alias("latency"), "failures")


def m18_recommend_model(spark, d):
    return evaluate.recommend_model(_records(spark, d), "F").select("run", F.round("score", 9).alias("score"))


def m19_throughput(spark, d):
    return _records(spark, d).groupBy("run").agg(F.round(F.avg(evaluate.throughput(F.col("score") * 100, F.col("latency"))), 6).alias("tokens_per_second"))


def _stream(spark, d):
    return streaming.read_events(spark, d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def p3_distinct_signals(spark, d):
    s = _stream(spark, d).select(F.floor(F.col("event_id") / 2).alias("proposal_id"), F.col("event_type").alias("signal_type"), "ts")
    return streaming.drain(streaming.distinct_signals(s, "60 days"), "append").select("proposal_id", "signal_type")


def p4_windowed_counts(spark, d):
    df = streaming.drain(streaming.windowed_counts(_stream(spark, d)))
    return df.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


def p6_study_sessions(spark, d):
    df = streaming.drain(streaming.study_sessions(_stream(spark, d), "6 hours"))
    return df.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"), F.round(F.sum("minutes"), 3).alias("minutes"))


QUERIES = {f.__name__: f for f in (e1_edges_of, e2_traverse, e3_ancestors, e4_shortest_paths, e5_prerequisite_edges, e6_prerequisite_chain, e7_explain_concepts, e8_subgraph, e12_graph_stats, e13_bottlenecks, i1_detect_gaps, i6_prerequisite_plan, i7_learning_path, i9_merge_tasks, i13_pack_days, i14_plan_totals, i15_unstarted, l1_dedupe_signals, l2_profiles, l3_profile_mastery, l4_history_flags, l6_event_statistics, l9_respect_opt_out, m9_run_summary, m10_compare_runs, m11_regressions, m12_rank_runs, m13_weaknesses, m17_model_comparison, m18_recommend_model, m19_throughput, p3_distinct_signals, p4_windowed_counts, p6_study_sessions)}

_E = f"WITH RECURSIVE {EDGES}"
_BOTH = "two AS (SELECT source_id AS node, target_id AS other, edge_id, confidence FROM edges UNION ALL SELECT target_id, source_id, edge_id, confidence FROM edges)"
_OUT = "r AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS distance FROM part UNION SELECT r.seed, e.target_id, r.distance + 1 FROM r JOIN edges e ON e.source_id = r.node WHERE r.distance < 8), reach AS (SELECT seed, node, min(distance) AS distance FROM r GROUP BY ALL)"
_PRE = "c AS (SELECT p_partkey AS target, p_partkey AS node, 0 AS distance FROM part UNION SELECT c.target, e.target_id, c.distance + 1 FROM c JOIN edges e ON e.source_id = c.node AND e.relation = 'REQUIRES' WHERE c.distance < 64), chain AS (SELECT target, node, max(distance) AS distance FROM c WHERE distance > 0 GROUP BY ALL), pre AS (SELECT *, (row_number() OVER (PARTITION BY target ORDER BY distance DESC, node::varchar))::int AS place FROM chain)"
_TASKS = f"""{MASTERY}, t AS (SELECT concept_id::varchar AS concept, 0.9::double - mastery / 10 AS priority, 'weakConcept' AS reason, 2 AS depth, 4 AS dup, 4 AS ord FROM mastery WHERE mastery < 0.5 UNION ALL SELECT concept_id::varchar, 0.7::double + mistake_count / 8.0::double, 'reviewDue', -1, 1, 3 FROM mastery WHERE mistake_count > 1),
h AS (SELECT *, (reason = 'reviewDue' AND priority >= 1)::int AS high FROM t), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY high DESC, dup DESC, priority DESC, depth DESC) AS k FROM h) WHERE k = 1),
plan AS (SELECT concept, reason, priority, row_number() OVER (ORDER BY CASE WHEN high = 1 THEN 6 ELSE ord END DESC, depth, priority DESC, reason, concept) AS place FROM b)"""
_SIG = "s AS (SELECT event_id // 2 AS proposal_id, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'markedStillConfused' WHEN 'purchase' THEN 'markedHelpful' WHEN 'signup' THEN 'lightlyEdited' ELSE 'requestedAgain' END AS signal_type, user_id, ts, event_id FROM events)"
_PROF = f"{_SIG}, x AS (SELECT user_id AS concept_id, signal_type FROM s UNION ALL SELECT user_id + 1, signal_type FROM s), prof AS (SELECT concept_id, count(*) FILTER (signal_type = 'markedHelpful') AS helpful, count(*) FILTER (signal_type = 'accepted') AS accept, count(*) FILTER (signal_type = 'lightlyEdited') AS lightly_edited, count(*) FILTER (signal_type = 'markedStillConfused') AS confused, count(*) FILTER (signal_type = 'requestedAgain') AS requested_again, count(*) AS n FROM x GROUP BY ALL)"
_REC = "rec AS (SELECT l_returnflag AS run, l_orderkey AS note_id, l_linestatus AS category, l_discount * 10 AS score, l_quantity::double AS latency, l_tax < 0.07 AS parsed FROM lineitem)"
_SUM = f"{_REC}, g AS (SELECT run, count(*) AS n, avg(score) AS score, avg(latency) AS latency FROM rec GROUP BY run)"
ORACLES = {
    "e1_edges_of": f"{_E}, {_BOTH}, o AS (SELECT DISTINCT node, edge_id, confidence FROM two JOIN part ON p_partkey = node), k AS (SELECT node, (row_number() OVER (PARTITION BY node ORDER BY confidence DESC, edge_id))::int AS rank, edge_id FROM o) SELECT * FROM k WHERE rank <= 3",
    "e2_traverse": f"{_E}, {_OUT} SELECT * FROM reach",
    "e3_ancestors": f"{_E}, r AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS distance FROM part UNION SELECT r.seed, e.source_id, r.distance + 1 FROM r JOIN edges e ON e.target_id = r.node WHERE r.distance < 2), g AS (SELECT seed, node, min(distance) AS distance FROM r GROUP BY ALL) SELECT * FROM g WHERE distance > 0",
    "e4_shortest_paths": f"""{_E}, {_BOTH}, st AS (SELECT node, other, min(edge_id) AS edge_id FROM two GROUP BY ALL), r AS (SELECT p_partkey AS source, p_partkey // 6 AS target, p_partkey AS node, 0 AS length, [p_partkey] AS path, CAST([] AS BIGINT[]) AS es FROM part WHERE p_partkey >= 6
  UNION ALL SELECT r.source, r.target, t.other, r.length + 1, list_append(r.path, t.other), list_append(r.es, t.edge_id) FROM r JOIN st t ON t.node = r.node WHERE r.length < 3 AND NOT list_contains(r.path, t.other)),
h AS (SELECT source, target, min((length, path, es)) AS b FROM r WHERE node = target GROUP BY ALL) SELECT source, target, b[1] AS length, array_to_string(b[2], ',') AS path, array_to_string(b[3], ',') AS edges FROM h UNION ALL SELECT p_partkey, p_partkey, 0, p_partkey::varchar, '' FROM part WHERE p_partkey >= 6""",
    "e5_prerequisite_edges": f"{_E} SELECT edge_id FROM edges WHERE relation = 'REQUIRES'",
    "e6_prerequisite_chain": f"{_E}, {_PRE} SELECT * FROM pre",
    "e7_explain_concepts": f"{_E} SELECT p_partkey AS concept_id, coalesce((SELECT string_agg(DISTINCT target_id::varchar, ',') FROM edges WHERE source_id = p_partkey AND relation = 'REQUIRES'), '') AS prerequisites, coalesce((SELECT array_to_string(list_sort(list(DISTINCT source_id)), ',') FROM edges WHERE target_id = p_partkey AND relation = 'REQUIRES'), '') AS dependents, coalesce((SELECT array_to_string(list_sort(list(DISTINCT CASE WHEN source_id = p_partkey THEN target_id ELSE source_id END)), ',') FROM edges WHERE (source_id = p_partkey OR target_id = p_partkey) AND source_id <> target_id AND relation <> 'REQUIRES'), '') AS related, (SELECT count(*) FROM edges WHERE source_id = p_partkey) AS n_out, (SELECT count(*) FROM edges WHERE target_id = p_partkey) AS n_in FROM part",
    "e8_subgraph": f"{_E}, {_BOTH}, n AS (SELECT DISTINCT node AS seed, other AS node FROM two JOIN part ON p_partkey = node UNION SELECT p_partkey, p_partkey FROM part), c AS (SELECT seed, count(*) AS n_nodes FROM n GROUP BY seed), i AS (SELECT a.seed, count(*) AS n_edges FROM edges e JOIN n a ON a.node = e.source_id JOIN n b ON b.node = e.target_id AND a.seed = b.seed GROUP BY a.seed) SELECT seed, n_nodes, n_edges FROM c LEFT JOIN i USING (seed)",
    "e12_graph_stats": f"{_E}, {_BOTH}, u AS (SELECT DISTINCT node, other FROM two), p AS (SELECT p_partkey AS id FROM part), inn AS (SELECT DISTINCT node, other FROM u WHERE node IN (SELECT id FROM p) AND other IN (SELECT id FROM p)), z AS (SELECT 1 AS node UNION SELECT inn.other FROM z JOIN inn ON inn.node = z.node) SELECT (SELECT count(*) FROM p) AS n_concepts, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM p WHERE id NOT IN (SELECT node FROM z)) + 1 AS n_components, round((SELECT count(*) FROM inn) / (SELECT count(*) FROM p)::double, 9) AS average_degree",
    "e13_bottlenecks": f"{_E}, {_OUT}, {_BOTH}, g AS (SELECT node, count(DISTINCT edge_id) AS centrality FROM two GROUP BY node), w AS (SELECT seed, count(*) AS n FROM reach WHERE distance > 0 GROUP BY seed) SELECT p_partkey AS concept_id, coalesce(centrality, 0) AS centrality, coalesce(n, 0) AS n_downstream FROM part LEFT JOIN g ON node = p_partkey LEFT JOIN w ON seed = p_partkey ORDER BY centrality DESC, n_downstream DESC, p_partkey::varchar LIMIT 20",
    "i1_detect_gaps": f"{_E}, {MASTERY}, g AS (SELECT concept_id, '{planning.LOW}' AS reason, 1 - mastery AS severity, 0 AS p FROM mastery WHERE mastery < 0.5 UNION ALL SELECT concept_id, '{planning.MISSED}', least(1::double, 0.45::double + mistake_count * 0.12::double), 0 FROM mastery WHERE mistake_count > 0 AND mastery < 0.65 UNION ALL SELECT b.concept_id, '{planning.WEAK_PREREQUISITE}', least(1::double, a.mastery - b.mastery), 1 FROM edges JOIN mastery a ON a.concept_id = source_id JOIN mastery b ON b.concept_id = target_id WHERE relation = 'REQUIRES' AND a.mastery >= 0.8 AND b.mastery < 0.5) SELECT concept_id, arg_max(reason, (p, severity, reason)) AS reason, round(max(severity), 9) AS severity FROM g GROUP BY concept_id",
    "i6_prerequisite_plan": f"{_E}, {MASTERY}, {_PRE} SELECT target, place, node, CASE WHEN coalesce(mastery, 0.5) < 0.65 THEN 'review' ELSE 'known' END AS reason FROM pre LEFT JOIN mastery ON concept_id = node",
    "i7_learning_path": f"{_E}, {_PRE}, x AS (SELECT target, CASE WHEN place <= greatest(1, count(*) OVER (PARTITION BY target) // 2) THEN 'beginner' ELSE 'intermediate' END AS stage FROM pre) SELECT target, stage, count(*) AS n FROM x GROUP BY ALL",
    "i9_merge_tasks": f"WITH {_TASKS} SELECT concept, reason, round(priority, 9) AS priority, place FROM plan",
    "i13_pack_days": f"WITH {_TASKS} SELECT concept, ((place - 1) // 3 + 1)::bigint AS day FROM plan WHERE place <= 42",
    "i14_plan_totals": f"WITH {_TASKS} SELECT ((place - 1) // 3 + 1)::bigint AS day, count(*) AS n_tasks, count(*) * 15 AS minutes FROM plan WHERE place <= 42 GROUP BY ROLLUP (1)",
    "i15_unstarted": f"WITH {MASTERY} SELECT concept_id FROM mastery WHERE mastery <= 0.2",
    "l1_dedupe_signals": f"WITH {_SIG} SELECT proposal_id, signal_type, arg_min(event_id, (ts, event_id)) AS event_id FROM s GROUP BY proposal_id, signal_type",
    "l2_profiles": f"WITH {_PROF} SELECT concept_id, helpful, accept, lightly_edited, confused, requested_again FROM prof",
    "l3_profile_mastery": f"WITH {_PROF} SELECT concept_id, round(helpful / n::double, 9) AS helpful_ratio, round(confused / n::double, 9) AS confusion_ratio, round(greatest(0::double, least(1::double, 0.5::double + helpful * 0.12::double + accept * 0.08::double + lightly_edited * 0.05::double - confused * 0.14::double - requested_again * 0.07::double)), 9) AS mastery FROM prof",
    "l4_history_flags": f"WITH {_PROF} SELECT concept_id, helpful > confused AS historically_helpful, (confused > 0 AND confused >= helpful) OR requested_again >= 2 AS historically_confusing, confused + requested_again AS n_confusing FROM prof",
    "l6_event_statistics": "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events",
    "l9_respect_opt_out": "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) GROUP BY user_id",
    "m9_run_summary": f"WITH {_SUM} SELECT run, n, round(score, 6) AS score, round(latency, 6) AS latency FROM g",
    "m10_compare_runs": f"WITH {_REC}, r AS (SELECT run, note_id, round(max(score), 6) AS score FROM rec GROUP BY ALL) SELECT a.note_id, round(b.score - a.score, 6) AS delta, b.score <> a.score AS changed FROM r a LEFT JOIN r b ON b.note_id = a.note_id AND b.run = 'N' WHERE a.run = 'A'",
    "m11_regressions": f"WITH {_SUM}, x AS (SELECT 'score' AS metric, (SELECT score FROM g WHERE run = 'A') AS a, (SELECT score FROM g WHERE run = 'N') AS b UNION ALL SELECT 'latency', (SELECT latency FROM g WHERE run = 'A'), (SELECT latency FROM g WHERE run = 'N')) SELECT metric, round(a, 6) AS baseline, round(b, 6) AS comparison, round(b - a, 6) AS delta FROM x",
    "m12_rank_runs": f"WITH {_SUM} SELECT run, (row_number() OVER (ORDER BY round(score, 9) DESC, latency, run))::int AS rank FROM g",
    "m13_weaknesses": f"WITH {_REC} SELECT 'low_score' AS feature, count(*) AS n FROM rec WHERE score < 0.2 UNION ALL SELECT 'slow', count(*) FROM rec WHERE latency > 45",
    "m17_model_comparison": f"WITH {_REC} SELECT category, run, round(avg(parsed::int), 9) AS parse_rate, round(avg(latency), 6) AS latency, count(*) FILTER (NOT parsed) AS failures FROM rec GROUP BY ALL",
    "m18_recommend_model": f"WITH {_REC}, s AS (SELECT run, avg(parsed::int) + CASE WHEN count(*) FILTER (category = 'F' AND parsed) > 0 THEN 0.1 ELSE 0 END::double AS score FROM rec GROUP BY run) SELECT arg_max(run, (round(score, 9), run)) AS run, round(max(score), 9) AS score FROM s",
    "m19_throughput": f"WITH {_REC} SELECT run, round(avg(CASE WHEN latency > 0 THEN score * 100 / 4 / latency ELSE 0 END), 6) AS tokens_per_second FROM rec GROUP BY run",
    "p3_distinct_signals": "SELECT DISTINCT event_id // 2 AS proposal_id, event_type AS signal_type FROM events",
    "p4_windowed_counts": "SELECT strftime(ts::date, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "p6_study_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6::double AS m FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest, round(sum(m), 3) AS minutes FROM c GROUP BY user_id",
}
