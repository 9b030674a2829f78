"""Queries of the recommendation, gap and plan operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.operators import graph, planning
from studyloom.plans._tables import AS_OF, EDGES, MASTERY, concepts, edges, mastery, table
from studyloom.plans.graph import _PRE


def _learners(spark, d):
    """Parts as concepts of learners, 25 each; the weakest first."""
    m = mastery(spark, d).withColumn("learner_id", F.floor(F.col("concept_id") / 25))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("learner_id").orderBy("mastery", "concept_id")))


def i2_recommend_reviews(spark, d):
    return planning.recommend_reviews(_learners(spark, d), concepts(spark, d).where("concept_id % 9 > 0"), 8)


def i3_review_dependencies(spark, d):
    plan = planning.prerequisite_plan(edges(spark, d), concepts(spark, d), mastery(spark, d))
    return planning.review_dependencies(plan).select("target", "place", "node")


def i4_next_topics(spark, d):
    m = _learners(spark, d)
    strong = m.where("place > 17").select("learner_id", "concept_id", (26 - F.col("place")).alias("place"))
    return planning.next_topics(strong, edges(spark, d))


def i5_learning_gaps(spark, d):
    df = planning.learning_gaps(mastery(spark, d).where("mastery < 0.3"), edges(spark, d))
    return df.select("concept_id", F.array_join(F.transform("blocked", lambda x: x.cast("string")), ",").alias("blocked"))


def i8_prioritized_tasks(spark, d):
    m = mastery(spark, d).withColumnRenamed("concept_id", "concept")
    due = m.withColumn("urgency", 1.0 - F.col("mastery"))
    chain = graph.prerequisite_chain(edges(spark, d), concepts(spark, d).select("concept_id"))
    narrow = table(spark, d, "part").select(F.col("p_partkey").alias("concept"), (F.col("p_size") % 13).alias("downstream"), (F.col("p_size") % 4).alias("prerequisites"))
    df = planning.prioritized_tasks(due.where("mistake_count = 3"), due.where("mistake_count = 2"), m.where("mastery < 0.3"), chain, m.where("mastery >= 0.3 and mastery < 0.6"), narrow, 450)
    return df.select("place", "concept", "reason", F.round("priority", 9).alias("priority"), "depth")


def i10_exam_tasks(spark, d):
    targets = concepts(spark, d)
    chain = graph.prerequisite_chain(edges(spark, d), targets)
    return planning.exam_tasks(chain, targets, mastery(spark, d), 5).select("target", "concept", F.round("priority", 6).alias("priority"), "reason", "depth")


def i11_review_plan(spark, d):
    r = mastery(spark, d).where("mistake_count > 0").select(F.col("concept_id").cast("string").alias("concept"), (1 - F.col("mastery")).alias("urgency"), (F.col("mistake_count") * 10).alias("place"))
    return planning.review_tasks(r).select("concept", F.round("priority", 9).alias("priority"))


def i12_study_next(spark, d):
    targets = concepts(spark, d)
    chain = graph.prerequisite_chain(edges(spark, d), targets)
    return planning.study_next(chain, edges(spark, d), targets).select("target", "rank", "node", "reason", F.round("priority", 9).alias("priority"))


def _gaps(spark, d):
    return table(spark, d, "part").select(F.floor(F.col("p_partkey") / 12).alias("note_id"), F.element_at(F.split("p_name", " "), 1).alias("title"), (F.col("p_size") / 10).alias("priority"), "p_partkey")


def i16_merge_gaps(spark, d):
    g = _gaps(spark, d)
    old = g.where("p_partkey % 3 > 0").select("note_id", F.upper("title").alias("title"), "priority", F.element_at(F.array(F.lit("active"), F.lit("ignored"), F.lit("resolved")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("status"), F.lit("2024-01-05").cast("timestamp").alias("detected_at"))
    df = planning.merge_gaps(old, g.where("p_partkey % 2 = 0").select("note_id", "title", "priority"), AS_OF)
    return df.select("note_id", "title", F.round("priority", 6).alias("priority"), "status", F.date_format("detected_at", "yyyy-MM-dd").alias("detected"))


def i17_corpus_gaps(spark, d):
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 6).alias("note_id"), F.explode(F.split("p_name", " ")).alias("term"))
    return planning.corpus_gaps(p, p).select("note_id", "rank", "term", "n_notes")


def i18_mapped_gaps(spark, d):
    """Words of documents as topics and needs: the fixed map's own words hardly occur in them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "text")
    return planning.mapped_gaps(docs, {**planning.TOPIC_NEEDS, "the": ("und", "les", "data"), "que": ("los", "the ")})


def i19_dedupe_gaps(spark, d):
    return planning.dedupe_gaps(_gaps(spark, d)).select("note_id", "key", F.round("priority", 6).alias("priority"))


def i20_practice_pick(spark, d):
    e = table(spark, d, "events")
    source = F.element_at(F.array(*map(F.lit, ("manual", "weak", "gap", "other", "confusing", "recommended", "lowMastery"))), (F.col("event_id") % 7 + 1).cast("int"))
    c = e.select(F.floor(F.col("event_id") / 3).alias("learner_id"), source.alias("source"), F.col("event_id").alias("concept_id"), F.round("value", 2).alias("score"))
    return planning.practice_pick(c)


def i21_practice_sessions(spark, d):
    e = table(spark, d, "events")
    a = e.select(F.floor(F.col("event_id") / 3).alias("session_id"), F.col("event_id").alias("nth"), F.when(F.col("event_type") == "purchase", "correct").otherwise("partial").alias("result")).where("nth % 4 <> 1")
    return planning.practice_sessions(a)


QUERIES = {f.__name__: f for f in (i2_recommend_reviews, i3_review_dependencies, i4_next_topics, i5_learning_gaps, i8_prioritized_tasks, i10_exam_tasks, i11_review_plan, i12_study_next, i16_merge_gaps, i17_corpus_gaps, i18_mapped_gaps, i19_dedupe_gaps, i20_practice_pick, i21_practice_sessions)}

_E = f"WITH RECURSIVE {EDGES}, {MASTERY}"
_L = "l AS (SELECT *, concept_id // 25 AS learner_id, row_number() OVER (PARTITION BY concept_id // 25 ORDER BY mastery, concept_id) AS place FROM mastery)"


def _up(depth: int) -> str:
    return f"u AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS distance FROM part UNION SELECT u.seed, e.source_id, u.distance + 1 FROM u JOIN edges e ON e.target_id = u.node WHERE u.distance < {depth}), up AS (SELECT seed, node, min(distance) AS distance FROM u GROUP BY ALL HAVING min(distance) > 0)"


_GAPS = "g AS (SELECT p_partkey // 12 AS note_id, split_part(p_name, ' ', 1) AS title, p_size / 10::double AS priority, p_partkey FROM part)"
_NEEDS = ", ".join(f"('{t}', '{n}')" for t, v in {**planning.TOPIC_NEEDS, "the": ("und", "les", "data"), "que": ("los", "the ")}.items() for n in v)
ORACLES = {
    "i2_recommend_reviews": f"{_E}, {_L}, n AS (SELECT learner_id, concept_id, p_name AS name, (row_number() OVER (PARTITION BY learner_id ORDER BY place))::int AS rank FROM l JOIN part ON p_partkey = concept_id WHERE concept_id % 9 > 0) SELECT * FROM n WHERE rank <= 8",
    "i3_review_dependencies": f"{_E}, {_PRE} SELECT target, place, node FROM pre LEFT JOIN mastery ON concept_id = node WHERE coalesce(mastery, 0.5) < 0.75",
    "i4_next_topics": f"{_E}, {_L}, {_up(2)}, f AS (SELECT learner_id, node, min((26 - place, distance)) AS a FROM l JOIN up ON seed = concept_id WHERE place > 17 GROUP BY ALL), r AS (SELECT learner_id, (row_number() OVER (PARTITION BY learner_id ORDER BY a, node))::int AS rank, node FROM f) SELECT * FROM r WHERE rank <= 8",
    "i5_learning_gaps": f"{_E}, {_up(4)}, r AS (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS rank FROM up) SELECT seed AS concept_id, string_agg(node::varchar, ',' ORDER BY rank) AS blocked FROM r JOIN mastery ON concept_id = seed WHERE rank <= 6 AND mastery < 0.3 GROUP BY seed",
    "i8_prioritized_tasks": f"{_E}, {_PRE}, m AS (SELECT concept_id AS id, mastery, mistake_count AS k, 1 - mastery AS u, p_size FROM mastery JOIN part ON p_partkey = concept_id), o AS (SELECT id, u, row_number() OVER (ORDER BY u DESC, id) - 1 AS n FROM m WHERE k = 3), d AS (SELECT id, u, row_number() OVER (ORDER BY u DESC, id) - 1 AS n FROM m WHERE k = 2), w AS (SELECT id FROM m WHERE mastery < 0.3 ORDER BY mastery, id LIMIT 8), v AS (SELECT id, row_number() OVER (ORDER BY mastery, id) - 1 AS n FROM m WHERE mastery >= 0.3 AND mastery < 0.6), b AS (SELECT id, p_size % 13 AS down, p_size % 4 AS pre FROM m ORDER BY down DESC, pre DESC, id LIMIT 6), t AS (SELECT id, 1.2::double + u - n * 0.01::double AS p, 'reviewDue' AS reason, -1 AS depth FROM o WHERE n < 8 UNION ALL SELECT id, 0.76::double + u * 0.05::double - n * 0.01::double, 'reviewDue', -1 FROM d WHERE n < 8 UNION ALL SELECT node, 0.95::double - (place - 1) * 0.01::double, 'missingPrerequisite', place - 1 FROM pre JOIN w ON id = target UNION ALL SELECT id, 0.9::double, 'weakConcept', (SELECT count(*) FROM pre WHERE target = id) FROM w UNION ALL SELECT id, 0.74::double - n * 0.02::double, 'reviewDue', 0 FROM v WHERE n < 8 UNION ALL SELECT id, 0.62::double + least(0.2::double, down * 0.02::double), 'highDependencyConcept', pre FROM b), h AS (SELECT *, reason = 'reviewDue' AND p >= 1 AS high, CASE reason WHEN 'missingPrerequisite' THEN 5 WHEN 'weakConcept' THEN 4 WHEN 'highDependencyConcept' THEN 2 ELSE 1 END AS dup, CASE reason WHEN 'missingPrerequisite' THEN 5 WHEN 'weakConcept' THEN 4 WHEN 'reviewDue' THEN 3 ELSE 1 END AS o FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY high DESC, dup DESC, p DESC, depth DESC) AS k FROM h), r AS (SELECT row_number() OVER (ORDER BY CASE WHEN high THEN 6 ELSE o END DESC, depth, p DESC, reason, id::varchar) AS place, id::varchar AS concept, reason, round(p, 9) AS priority, depth::int AS depth FROM q WHERE k = 1) SELECT * FROM r WHERE place <= 30",
    "i10_exam_tasks": f"{_E}, {_PRE}, n AS (SELECT target, count(*) AS n FROM pre GROUP BY target), s AS (SELECT target, node, place - 1 AS nth, false AS last FROM pre UNION ALL SELECT p_partkey, p_partkey, coalesce(n, 0), true FROM part LEFT JOIN n ON target = p_partkey) SELECT s.target, node::varchar AS concept, round(0.72::double + (1 - coalesce(mastery, 0.5)) * 0.22::double + (coalesce(n, 0) - nth) * 0.03::double + 0.08::double - nth * 0.01::double, 6) AS priority, CASE WHEN last THEN 'examPreparation' ELSE 'missingPrerequisite' END AS reason, nth::int AS depth FROM s LEFT JOIN n ON n.target = s.target LEFT JOIN mastery ON concept_id = node",
    "i11_review_plan": f"WITH {MASTERY} SELECT concept_id::varchar AS concept, round(0.95::double + 1 - mastery - (mistake_count * 10 - 1) * 0.01::double, 9) AS priority FROM mastery WHERE mistake_count > 0",
    "i12_study_next": f"{_E}, {_PRE}, {_up(2)}, a AS (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS nth FROM up), t AS (SELECT target, node, 0.88::double - (place - 1) * 0.03::double AS priority, 'missingPrerequisite' AS reason, place - 1 AS depth, 5 AS o FROM pre UNION ALL SELECT seed, node, 0.58::double - (nth - 1) * 0.03::double, 'highDependencyConcept', nth, 1 FROM a WHERE nth <= 4), b AS (SELECT *, row_number() OVER (PARTITION BY target, node ORDER BY o DESC) AS k FROM t), r AS (SELECT target, (row_number() OVER (PARTITION BY target ORDER BY o DESC, depth, round(priority, 9) DESC, node))::int AS rank, node, reason, round(priority, 9) AS priority FROM b WHERE k = 1) SELECT * FROM r WHERE rank <= 4",
    "i16_merge_gaps": f"WITH {_GAPS}, o AS (SELECT note_id, lower(title) AS k, arg_max((upper(title), priority, ['active', 'ignored', 'resolved'][p_partkey % 3 + 1]), (priority, upper(title), ['active', 'ignored', 'resolved'][p_partkey % 3 + 1])) AS o FROM g WHERE p_partkey % 3 > 0 GROUP BY ALL), e AS (SELECT note_id, lower(title) AS k, max(priority) AS priority, any_value(title) AS title FROM g WHERE p_partkey % 2 = 0 GROUP BY ALL) SELECT coalesce(o.note_id, e.note_id) AS note_id, coalesce(e.title, o.o[1]) AS title, round(coalesce(e.priority, o.o[2]), 6) AS priority, coalesce(o.o[3], 'active') AS status, CASE WHEN o.k IS NULL THEN '2024-02-01' ELSE '2024-01-05' END AS detected FROM o FULL JOIN e ON o.note_id = e.note_id AND o.k = e.k",
    "i17_corpus_gaps": "WITH p AS (SELECT DISTINCT p_partkey // 6 AS note_id, unnest(string_split(p_name, ' ')) AS term FROM part), c AS (SELECT term, count(*) AS n_notes FROM p GROUP BY term HAVING count(*) >= 2 ORDER BY n_notes DESC, term LIMIT 10), r AS (SELECT n.note_id, c.term, n_notes, (row_number() OVER (PARTITION BY n.note_id ORDER BY n_notes DESC, c.term))::int AS rank FROM (SELECT DISTINCT note_id FROM p) n CROSS JOIN c LEFT JOIN p ON p.note_id = n.note_id AND p.term = c.term WHERE p.term IS NULL) SELECT note_id, rank, term, n_notes FROM r WHERE rank <= 6",
    "i18_mapped_gaps": f"WITH m(topic, need) AS (VALUES {_NEEDS}), t AS (SELECT doc_id AS note_id, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT need, count(*) AS n_notes FROM (SELECT DISTINCT need FROM m) JOIN t ON contains(t, need) GROUP BY need) SELECT note_id, topic, m.need, n_notes FROM t JOIN m ON contains(t, topic) AND NOT contains(t, m.need) JOIN c ON c.need = m.need",
    "i19_dedupe_gaps": f"WITH {_GAPS} SELECT note_id, lower(title) AS key, round(max(priority), 6) AS priority FROM g GROUP BY ALL",
    "i20_practice_pick": f"WITH c AS (SELECT event_id // 3 AS learner_id, ['manual', 'weak', 'gap', 'other', 'confusing', 'recommended', 'lowMastery'][event_id % 7 + 1] AS source, event_id AS concept_id, round(value, 2) AS score FROM events), r AS (SELECT *, list_position({list(planning.PICK_ORDER)}, source) AS k FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY k, score DESC, concept_id) AS n FROM r WHERE k > 0) SELECT learner_id, source, concept_id FROM b WHERE n = 1",
    "i21_practice_sessions": "WITH a AS (SELECT event_id // 3 AS session_id, event_id AS nth, event_type = 'purchase' AS good, row_number() OVER (PARTITION BY event_id // 3 ORDER BY event_id) AS place FROM events WHERE event_id % 4 <> 1), s AS (SELECT session_id, least(min(nth) FILTER (good), min(nth) FILTER (place >= 2)) AS ends, count(*) AS n FROM a GROUP BY session_id) SELECT session_id, CASE WHEN ends IS NULL THEN 'followUp' ELSE 'complete' END AS state, ends, n FROM s",
}
