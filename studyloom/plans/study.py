"""Queries of the evaluation, signal, material and coverage operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import concepts as concept_rules
from studyloom.operators import evaluate, material, signals
from studyloom.plans._tables import table
from studyloom.plans.text import _KEY, _SENT, _WORDS


def _rounded(df, key):
    return df.select(key, *[F.round(c, 9).alias(c) for c in df.columns if c != key])


def _cards(spark, d):
    p = table(spark, d, "part")
    back = F.concat_ws(" ", "p_type", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("in"), F.col("p_size"), F.lit("pieces"))), "p_brand")
    return p.select(F.floor(F.col("p_partkey") / 8).alias("note_id"), F.col("p_partkey").alias("card_id"), F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1)).alias("front"), back.alias("back"))


def _keywords(spark, d):
    return table(spark, d, "part").select(F.floor((F.col("p_partkey") + 1) / 8).alias("note_id"), F.element_at(F.split("p_type", " "), 1).alias("keyword"))


def m3_summary_scores(spark, d):
    """M2 and M3: a document as the summary of itself, its language and source as keywords."""
    docs = table(spark, d, "documents").where("text is not null")
    df = docs.select(F.col("doc_id").alias("note_id"), F.col("text").alias("summary"), F.array("lang", F.substring("text", 1, 5), F.lit("the")).alias("keywords"), F.length("text").alias("n_raw"))
    return _rounded(evaluate.score_summaries(df), "note_id")


def m4_flashcard_scores(spark, d):
    return _rounded(evaluate.score_flashcards(_cards(spark, d), _keywords(spark, d)), "note_id")


def m5_quiz_scores(spark, d):
    c = _cards(spark, d)
    n = (F.col("card_id") % 7).cast("int")
    options = F.slice(F.split(F.concat_ws(" ", "back", "front", "back", "front", "back"), " "), 1, n)
    quiz = c.select("note_id", F.col("card_id").alias("question_id"), F.col("front").alias("prompt"), F.when(F.col("card_id") % 3 == 0, " ").otherwise(F.col("back")).alias("explanation"), F.when(F.col("card_id") % 5 == 0, "").otherwise(F.col("front")).alias("answer"), options.alias("options"))
    return _rounded(evaluate.score_quizzes(quiz, _keywords(spark, d)), "note_id")


def m6_map_scores(spark, d):
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 8).alias("note_id"), F.col("p_partkey").alias("node_id"), F.element_at(F.split("p_name", " "), 1).alias("title"))
    at = F.col("node_id") % 8
    nodes = p.withColumn("parent_id", F.when(at > 1, F.floor(F.col("node_id") / 8) * 8 + F.floor(at / 2)))
    expected = p.groupBy("note_id").agg(F.count_if(F.col("node_id") % 5 == 0).alias("n_relationships"), (F.count("*") + 2).alias("n_terms"))
    return _rounded(evaluate.score_maps(nodes, expected), "note_id")


def m7_insight_scores(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    df = docs.select(F.col("doc_id").alias("note_id"), "text", F.when(F.col("doc_id") % 4 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("lang", F.substring("text", -4, 4))).alias("keywords"), (F.col("doc_id") % 6).alias("n_gaps"))
    return _rounded(evaluate.score_insights(df), "note_id")


def m8_payload_scores(spark, d):
    p = table(spark, d, "part")
    parts = [f"part{k}" for k in range(9)]
    df = p.select(F.col("p_partkey").alias("note_id"), F.split("p_name", "a").alias("titles"), *[(F.col("p_size") % (k + 2)).alias(c) for k, c in enumerate(parts)])
    return _rounded(evaluate.score_payloads(df, parts), "note_id")


def m14_gold_scores(spark, d):
    p = table(spark, d, "part")
    gold = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("note_id"), F.col("p_type").alias("summary"), F.col("p_name").alias("quiz"))
    out = p.select(F.col("p_partkey").alias("note_id"), F.concat_ws(" ", F.element_at(F.split("p_type", " "), 1), "p_brand").alias("summary"), F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), "p_brand").alias("quiz"))
    return _rounded(evaluate.score_vs_gold(out, gold, ["summary", "quiz"]), "note_id")


def m15_combined(spark, d):
    p = table(spark, d, "part")
    df = p.select(F.col("p_partkey").alias("note_id"), (F.col("p_size") / 50).alias("heuristic"), F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 11) / 10.0).alias("gold"), (F.col("p_size") % 4).alias("seconds"), ((F.col("p_size") % 3) * 1000).alias("memory_mb"), (F.col("p_partkey") % 2).alias("hallucinations"))
    return evaluate.combined(df).select("note_id", F.round("overall", 6).alias("overall"), F.array_join("signals", ",").alias("signals"))


def m16_diff_snapshots(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("identifier"), F.col("p_name").alias("system_prompt"), F.col("p_type").alias("output_description"))
    other = p.where("identifier % 7 <> 0").select("identifier", F.when(F.col("identifier") % 3 == 0, F.upper("system_prompt")).otherwise(F.col("system_prompt")).alias("system_prompt"), F.when(F.col("identifier") % 5 == 0, "new").otherwise(F.col("output_description")).alias("output_description"))
    return evaluate.diff_snapshots(p, other)


def m20_extraction_counts(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "file")
    return evaluate.extraction_counts(o.select((F.col("o_orderkey") * 1).alias("file")), concepts=li.where("l_returnflag = 'A'"), relations=li.where("l_returnflag = 'R'"), facts=li.where("l_quantity > 30"))


def l5_accept_signals(spark, d):
    p = table(spark, d, "part")
    final = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_type"))
    return signals.accept_signals(p.select(F.col("p_partkey").alias("proposal_id"), F.col("p_name").alias("generated"), final.alias("final")))


def l7_answer_metrics(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    q = e.select(F.col("event_id").alias("question_id"), F.col("ts").alias("asked"))
    a = e.where("event_id > 0").select((F.col("event_id") - 1).alias("question_id"), F.col("ts").alias("answered"), F.col("event_type").alias("text"), F.concat("event_type", F.lit("ed")).alias("generated"))
    return signals.answer_metrics(q, a)


def l8_gap_events(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("proposal_id"), F.col("p_brand").alias("note_id"), F.split("p_name", " ").alias("gaps"))
    return signals.explode_gap_events(p).select("proposal_id", "nth", "concept")


def l10_stale_proposals(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), (F.col("n_chars") % 10).alias("version"))
    proposals = docs.select(F.col("note_id").alias("proposal_id"), (F.col("note_id") + F.col("note_id") % 2).alias("note_id"), "content_hash", "version")
    return signals.stale_proposals(proposals, docs)


def _items(spark, d):
    p = table(spark, d, "part")
    kinds = ["concept", "prerequisite", "misconception", "formula", "example", "concept", "concept"]
    category = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_size") % 7 + 1).cast("int"))
    return p.select(F.floor(F.col("p_partkey") / 20).alias("note_id"), F.col("p_partkey").alias("item_id"), category.alias("category"), F.col("p_name").alias("title"), (F.col("p_size") / 50).alias("importance"), ((F.col("p_partkey") * 7 % 13) / 13.0).alias("difficulty"))


def k7_item_gaps(spark, d):
    return material.item_gaps(_items(spark, d)).select("note_id", "rank", "item_id", F.round("priority", 9).alias("priority"))


def k8_exam_prep(spark, d):
    return material.exam_prep(_items(spark, d))


def k9_build_memory(spark, d):
    c = _items(spark, d).select("note_id", F.col("title").alias("concept"))
    known = _items(spark, d).where("item_id % 3 = 0").select("note_id", F.upper("title").alias("concept"), (F.col("item_id") % 4).cast("int").alias("mastered"), (F.col("item_id") % 5).cast("int").alias("missed"))
    return material.build_memory(c, known)


def k12_check_outputs(spark, d):
    i = _items(spark, d)
    o = i.select("note_id", F.col("item_id").alias("output_id"), F.element_at(F.split("title", " "), 1).alias("key"), F.col("difficulty").alias("confidence"), F.when(F.col("item_id") % 6 == 0, "  ").otherwise(F.col("title")).alias("front"), F.when(F.col("item_id") % 10 == 0, None).otherwise(F.col("category")).alias("back"))
    return material.check_outputs(o, ["front", "back"], 0.3)


def k16_latest_artifacts(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("note_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("generated_at"), F.col("event_id").alias("artifact_id"))
    return material.latest_artifacts(e).select("note_id", "kind", "artifact_id")


def j1_ingest_sources(spark, d):
    docs = table(spark, d, "documents")
    s = docs.select((F.col("doc_id") % 97).alias("lecture_id"), F.when(F.col("doc_id") % 3 == 0, "note").otherwise("lecture").alias("side"), F.col("doc_id").alias("source_id"), F.col("source").alias("kind"), "text", (F.col("doc_id") % 5 / 4).alias("weight"))
    out = material.ingest_sources(s.withColumn("lecture_id", F.floor(F.col("source_id") / 6)), {"web": 0.5})
    return out.select("lecture_id", "side", "n_sources", "n_words", F.round("weight", 6).alias("weight"), F.md5("text").alias("text_md5"))


def j5_best_match(spark, d):
    p = table(spark, d, "part").withColumn("lecture_id", F.floor(F.col("p_partkey") / 10))
    src = p.where("p_partkey % 2 = 0").select("lecture_id", F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("title"))
    notes = p.where("p_partkey % 2 = 1").select("lecture_id", F.col("p_partkey").alias("note_concept_id"), F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1), F.lit("x")).alias("title"))
    return material.best_match(src, notes).select("lecture_id", "concept_id", "note_concept_id", F.round("score", 9).alias("score"))


def _coverage_items(spark, d):
    p = table(spark, d, "part")
    state = concept_rules.coverage_state((F.col("p_partkey") % 11) / 10.0, (F.col("p_partkey") % 7) / 6.0)
    return p.select(F.floor(F.col("p_partkey") / 15).alias("lecture_id"), F.col("p_name").alias("title"), state.alias("state"), (F.col("p_size") / 50).alias("importance"), (F.col("p_partkey") % 9 == 0).alias("visual"))


def j8_review_priority(spark, d):
    return material.review_priority(_coverage_items(spark, d)).select("lecture_id", "rank", "state", F.round("priority", 6).alias("priority"))


def j10_coverage_report(spark, d):
    items = _coverage_items(spark, d)
    return material.coverage_report(items, concept_rules.completeness(items, "lecture_id"))


QUERIES = {f.__name__: f for f in (m3_summary_scores, m4_flashcard_scores, m5_quiz_scores, m6_map_scores, m7_insight_scores, m8_payload_scores, m14_gold_scores, m15_combined, m16_diff_snapshots, m20_extraction_counts, l5_accept_signals, l7_answer_metrics, l8_gap_events, l10_stale_proposals, k7_item_gaps, k8_exam_prep, k9_build_memory, k12_check_outputs, k16_latest_artifacts, j1_ingest_sources, j5_best_match, j8_review_priority, j10_coverage_report)}


def _in(text: str, keyword: str) -> str:
    return f"contains({_KEY.format(text)}, {_KEY.format(keyword)})"


_CARDS = "cards AS (SELECT p_partkey // 8 AS note_id, p_partkey AS card_id, split_part(p_name, ' ', 1) AS front, concat_ws(' ', p_type, CASE WHEN p_size % 2 = 0 THEN 'in' || p_size || 'pieces' END, p_brand) AS back FROM part), keywords AS (SELECT (p_partkey + 1) // 8 AS note_id, split_part(p_type, ' ', 1) AS keyword FROM part)"
_OVER = "CASE WHEN {0} = '' OR {1} = '' THEN 0 ELSE len(list_intersect(list_distinct(string_split({0}, ' ')), list_distinct(string_split({1}, ' '))))::double / greatest(len(list_distinct(string_split({0}, ' '))), len(list_distinct(string_split({1}, ' ')))) END"
_ITEMS = "items AS (SELECT p_partkey // 20 AS note_id, p_partkey AS item_id, ['concept', 'prerequisite', 'misconception', 'formula', 'example', 'concept', 'concept'][p_size % 7 + 1] AS category, p_name AS title, p_size / 50::double AS importance, (p_partkey * 7 % 13) / 13::double AS difficulty FROM part)"
_COV = "y AS (SELECT p_partkey // 15 AS lecture_id, p_name AS title, (p_partkey % 11) / 10::double AS s, (p_partkey % 7) / 6::double AS t, p_size / 50::double AS importance, p_partkey % 9 = 0 AS visual FROM part), items AS (SELECT *, CASE WHEN s <= 0 THEN 'missing' WHEN s >= 0.75 AND t >= 0.65 THEN 'covered' WHEN s >= 0.4 OR t >= 0.35 THEN 'partial' ELSE 'missing' END AS state FROM y)"
ORACLES = {
    "m3_summary_scores": f"""WITH s AS (SELECT doc_id AS note_id, text AS t, {_SENT.format('text')} AS s, string_split(text, chr(10)) AS l, [lang, substr(text, 1, 5), 'the'] AS k, greatest(80, least(360, length(text) // 3)) AS ideal FROM documents WHERE text IS NOT NULL),
x AS (SELECT note_id, len(list_filter(k, lambda w: {_in('t', 'w')}))::double / 3 AS coverage, CASE WHEN len(s) = 0 THEN 1 ELSE len(list_distinct(list_transform(s, lambda z: {_KEY.format('z')})))::double / len(s) END AS repetition,
CASE WHEN len(s) = 0 THEN 0.5 ELSE 1 - least(1::double, abs(list_sum(list_transform(s, lambda z: {_WORDS.format('z')}))::double / len(s) - 16) / 24) END AS readability, 1 - least(1::double, abs(length(t) - ideal)::double / ideal) AS length,
least(1::double, (len(list_filter(l, lambda z: regexp_matches(trim(z), '^[#*-]'))) + 1)::double / (len(l) + 1)) AS structure FROM s)
SELECT note_id, round(coverage, 9) AS coverage, round(repetition, 9) AS repetition, round(readability, 9) AS readability, round(length, 9) AS length, round(structure, 9) AS structure, round((coverage + repetition + readability + length + structure) / 5, 9) AS overall FROM x""",
    "m4_flashcard_scores": f"""WITH {_CARDS}, n AS (SELECT note_id, count(DISTINCT {_KEY.format('front')})::double / count(*) AS uniqueness, avg(greatest(0::double, least(1::double, 1 - abs(length(trim(back)) - 110) / 140::double))) AS answer_length, avg((regexp_matches(back, '\\p{{N}}')::int + (len(list_filter(string_split(back, ' '), lambda w: w <> '')) > 5)::int) / 2::double) AS specificity,
string_agg(front, ' ' ORDER BY card_id) || ' ' || string_agg(back, ' ' ORDER BY card_id) AS text FROM cards GROUP BY note_id), c AS (SELECT note_id, avg({_in('text', 'keyword')}::int) AS coverage FROM n JOIN keywords USING (note_id) GROUP BY note_id), x AS (SELECT note_id, uniqueness, answer_length, specificity, coalesce(coverage, 0) AS coverage FROM n LEFT JOIN c USING (note_id))
SELECT note_id, round(uniqueness, 9) AS uniqueness, round(answer_length, 9) AS answer_length, round(specificity, 9) AS specificity, round(coverage, 9) AS coverage, round((uniqueness + answer_length + coverage + specificity) / 4, 9) AS overall FROM x""",
    "m5_quiz_scores": f"""WITH {_CARDS}, q AS (SELECT note_id, card_id, front, CASE WHEN card_id % 3 = 0 THEN ' ' ELSE back END AS explanation, CASE WHEN card_id % 5 = 0 THEN '' ELSE front END AS answer, list_slice(string_split(concat_ws(' ', back, front, back, front, back), ' '), 1, card_id % 7) AS options FROM cards),
n AS (SELECT note_id, count(DISTINCT {_KEY.format('front')})::double / count(*) AS uniqueness, avg((trim(explanation) <> '')::int) AS explanations, avg(CASE WHEN len(options) = 4 THEN 1 WHEN len(options) IN (3, 5) THEN 0.8 WHEN len(options) IN (2, 6) THEN 0.6 ELSE 0.2 END) AS option_count, avg((trim(answer) <> '')::int) AS answers,
string_agg(front, ' ' ORDER BY card_id) || ' ' || string_agg(array_to_string(options, ' '), ' ' ORDER BY card_id) AS text FROM q GROUP BY note_id), c AS (SELECT note_id, avg({_in('text', 'keyword')}::int) AS coverage FROM n JOIN keywords USING (note_id) GROUP BY note_id), x AS (SELECT note_id, uniqueness, explanations, option_count, answers, coalesce(coverage, 0) AS coverage FROM n LEFT JOIN c USING (note_id))
SELECT note_id, round(uniqueness, 9) AS uniqueness, round(explanations, 9) AS explanations, round(option_count, 9) AS option_count, round(answers, 9) AS answers, round(coverage, 9) AS coverage, round((uniqueness + explanations + option_count + answers + coverage) / 5, 9) AS overall FROM x""",
    "m6_map_scores": f"""WITH p AS (SELECT p_partkey // 8 AS note_id, p_partkey AS node_id, {_KEY.format("split_part(p_name, ' ', 1)")} AS title, CASE WHEN p_partkey % 8 > 1 THEN p_partkey // 8 * 8 + (p_partkey % 8) // 2 END AS parent_id FROM part),
f AS (SELECT *, EXISTS (SELECT 1 FROM p c WHERE c.parent_id = p.node_id) AS inn, EXISTS (SELECT 1 FROM p r WHERE r.node_id = p.parent_id AND r.parent_id IS NULL) AS under FROM p),
n AS (SELECT note_id, count(*) AS n, count(DISTINCT title) AS titles, count(*) FILTER (NOT inn) AS leaves, count(*) FILTER (parent_id IS NULL) AS roots, count(*) FILTER (under) AS children, count(*) FILTER (node_id % 5 = 0) AS rel, count(*) + 2 AS terms FROM f GROUP BY note_id),
x AS (SELECT note_id, greatest(0::double, (leaves - rel)::double / greatest(1, leaves)) AS disconnected, CASE WHEN rel = 0 THEN 0.5 ELSE greatest(0::double, 1 - n::double / greatest(1, terms)) END AS missing, 1 - titles::double / n AS duplication, least(1::double, (children + roots)::double / (roots * 3)) AS hierarchy FROM n)
SELECT note_id, round(disconnected, 9) AS disconnected, round(missing, 9) AS missing, round(duplication, 9) AS duplication, round(hierarchy, 9) AS hierarchy, round((1 - disconnected + 1 - missing + 1 - duplication + hierarchy) / 4, 9) AS overall FROM x""",
    "m7_insight_scores": f"""WITH s AS (SELECT doc_id AS note_id, text AS t, {_SENT.format('text')} AS s, CASE WHEN doc_id % 4 = 0 THEN [] ELSE [lang, right(text, 4)] END AS k, doc_id % 6 AS g FROM documents WHERE text IS NOT NULL),
x AS (SELECT note_id, CASE WHEN len(k) = 0 THEN 0 ELSE 1 - len(list_filter(k, lambda w: {_in('t', 'w')}))::double / len(k) END AS missing, CASE WHEN len(s) = 0 THEN 1 ELSE len(list_distinct(list_transform(s, lambda z: {_KEY.format('z')})))::double / len(s) END AS repetition, CASE WHEN g = 0 THEN 0.35 ELSE least(1::double, g / 4::double) END AS actionability FROM s)
SELECT note_id, round(missing, 9) AS missing, round(repetition, 9) AS repetition, round(actionability, 9) AS actionability, round((1 - missing + repetition + actionability) / 3, 9) AS overall FROM x""",
    "m8_payload_scores": "WITH s AS (SELECT p_partkey AS note_id, string_split(p_name, 'a') AS t, " + " + ".join(f"(p_size % {k + 2} > 0)::int" for k in range(9)) + " AS f FROM part), x AS (SELECT note_id, (f > 0)::int::double AS parsed, CASE WHEN len(list_filter(t, lambda z: z = '')) = 0 THEN 1 ELSE 0 END::double AS valid, least(1::double, f / 6::double) AS completeness FROM s) SELECT note_id, parsed, valid, round(completeness, 9) AS completeness, round((parsed + valid + completeness) / 3, 9) AS overall FROM x",
    "m14_gold_scores": f"WITH p AS (SELECT p_partkey AS note_id, {_KEY.format('''split_part(p_type, ' ', 1) || ' ' || p_brand''')} AS a, {_KEY.format('p_type')} AS b, {_KEY.format('''list_last(string_split(p_name, ' ')) || ' ' || p_brand''')} AS c, {_KEY.format('p_name')} AS e FROM part WHERE p_partkey % 3 > 0), x AS (SELECT note_id, {_OVER.format('a', 'b')} AS summary, {_OVER.format('c', 'e')} AS quiz FROM p) SELECT note_id, round(summary, 9) AS summary, round(quiz, 9) AS quiz, round((summary + quiz) / 2, 9) AS overall FROM x",
    "m15_combined": "WITH p AS (SELECT p_partkey AS note_id, p_size / 50::double AS h, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 11) / 10::double END AS g, p_size % 4 AS s, (p_size % 3) * 1000 AS m, p_partkey % 2 AS n FROM part) SELECT note_id, round(h * 0.7::double + coalesce(g, h) * 0.3::double, 6) AS overall, concat_ws(',', CASE WHEN h >= 0.8 THEN 'strong_heuristic_performance' ELSE 'heuristic_coverage_needs_work' END, CASE WHEN coalesce(g, h) >= 0.8 THEN 'strong_gold_standard_alignment' ELSE 'gold_standard_alignment_gap' END, CASE WHEN s > 2 THEN 'slow_generation' WHEN s > 0 THEN 'fast_generation' END, CASE WHEN m > 1500 THEN 'high_memory_usage' WHEN m > 0 THEN 'moderate_memory_usage' END, CASE WHEN n > 0 THEN 'hallucinations_detected' END) AS signals FROM p",
    "m16_diff_snapshots": "WITH p AS (SELECT p_partkey AS identifier, p_name AS a, p_type AS b, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS c, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_type END AS e FROM part WHERE p_partkey % 7 <> 0) SELECT identifier, sha256(a || chr(10) || b) AS baseline_hash, sha256(c || chr(10) || e) AS comparison_hash, concat_ws(',', CASE WHEN a <> c THEN 'system_prompt' END, CASE WHEN b <> e THEN 'output_description' END) AS changed FROM p WHERE a <> c OR b <> e",
    "m20_extraction_counts": "WITH x AS (SELECT o_orderkey AS file, count(*) FILTER (l_returnflag = 'A') AS concepts, count(*) FILTER (l_returnflag = 'R') AS relations, count(*) FILTER (l_quantity > 30) AS facts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT *, concepts + relations + facts = 0 AS failed FROM x",
    "l5_accept_signals": "WITH p AS (SELECT p_partkey AS proposal_id, trim(p_name) AS a, trim(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' ELSE p_type END) AS b FROM part) SELECT proposal_id, CASE WHEN a = b THEN 'accepted' WHEN levenshtein(a, b)::double / greatest(length(a), length(b), 1) <= 0.25 THEN 'lightlyEdited' ELSE 'heavilyEdited' END AS signal_type, CASE WHEN a = b THEN 0.05 WHEN levenshtein(a, b)::double / greatest(length(a), length(b), 1) <= 0.25 THEN 0.02 ELSE -0.02 END::double AS confidence_delta FROM p",
    "l7_answer_metrics": "SELECT q.event_id AS question_id, greatest(0, round(epoch_us(a.ts) / 1000000::double - epoch_us(q.ts) / 1000000::double))::bigint AS seconds, length(a.event_type) + 2 AS n_generated, length(a.event_type) AS n_accepted, 2 AS distance FROM events q JOIN events a ON a.event_id = q.event_id + 1",
    "l8_gap_events": "SELECT p_partkey AS proposal_id, unnest(range(len(string_split(p_name, ' '))))::int AS nth, unnest(string_split(p_name, ' ')) AS concept FROM part",
    "l10_stale_proposals": "WITH x AS (SELECT doc_id AS note_id, sha256(coalesce(text, '')) AS h, n_chars % 10 AS v FROM documents) SELECT p.note_id AS proposal_id, NOT coalesce(p.h = n.h OR p.v = n.v, false) AS stale FROM x p LEFT JOIN x n ON n.note_id = p.note_id + p.note_id % 2",
    "k7_item_gaps": f"WITH {_ITEMS}, c AS (SELECT *, row_number() OVER (PARTITION BY note_id, category ORDER BY item_id) AS n FROM items), g AS (SELECT note_id, item_id, least(1::double, importance + CASE WHEN category = 'misconception' THEN 0.1 ELSE 0 END::double) AS priority FROM c WHERE category IN ('prerequisite', 'misconception') AND n <= 4), f AS (SELECT note_id, item_id, importance AS priority FROM c WHERE category = 'concept' AND n = 1 AND note_id NOT IN (SELECT note_id FROM g)), e AS (SELECT * FROM g UNION ALL SELECT * FROM f) SELECT note_id, (row_number() OVER (PARTITION BY note_id ORDER BY round(priority, 9) DESC, item_id))::int AS rank, item_id, round(priority, 9) AS priority FROM e",
    "k8_exam_prep": f"WITH {_ITEMS}, c AS (SELECT *, (row_number() OVER (PARTITION BY note_id ORDER BY difficulty DESC, item_id))::int AS rank FROM items WHERE category IN ('formula', 'misconception', 'prerequisite')) SELECT note_id, rank, item_id, title FROM c WHERE rank <= 6",
    "k9_build_memory": f"WITH {_ITEMS}, f AS (SELECT note_id, {_KEY.format('title')} AS k, min(title) AS concept FROM items GROUP BY ALL), e AS (SELECT note_id, {_KEY.format('title')} AS k, min((upper(title), (item_id % 4)::int, (item_id % 5)::int)) AS m FROM items WHERE item_id % 3 = 0 GROUP BY ALL) SELECT f.note_id, coalesce(m[1], concept) AS concept, coalesce(m[2], 0) AS mastered, coalesce(m[3], 0) AS missed FROM f LEFT JOIN e ON e.note_id = f.note_id AND e.k = f.k",
    "k12_check_outputs": f"WITH {_ITEMS}, o AS (SELECT note_id, item_id AS output_id, row_number() OVER (PARTITION BY note_id, {_KEY.format('''split_part(title, ' ', 1)''')} ORDER BY item_id) AS n, difficulty FROM items) SELECT note_id, output_id, 'low confidence' AS rule FROM o WHERE difficulty < 0.3 UNION ALL SELECT note_id, output_id, 'duplicate' FROM o WHERE n > 1 UNION ALL SELECT note_id, output_id, 'missing front' FROM o WHERE output_id % 6 = 0 UNION ALL SELECT note_id, output_id, 'missing back' FROM o WHERE output_id % 10 = 0",
    "k16_latest_artifacts": "SELECT user_id AS note_id, event_type AS kind, arg_max(event_id, (ts, event_id)) AS artifact_id FROM events GROUP BY ALL",
    "j1_ingest_sources": f"WITH s AS (SELECT doc_id // 6 AS lecture_id, CASE WHEN doc_id % 3 = 0 THEN 'note' ELSE 'lecture' END AS side, doc_id, text, greatest(0.1::double, doc_id % 5 / 4::double * CASE WHEN source = 'web' THEN 0.5 ELSE 1 END::double) AS w FROM documents WHERE trim(text) <> '') SELECT lecture_id, side, count(*) AS n_sources, sum({_WORDS.format('text')})::bigint AS n_words, round(sum(w), 6) AS weight, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5 FROM s GROUP BY ALL",
    "j5_best_match": f"""WITH p AS (SELECT p_partkey // 10 AS lecture_id, p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN {_KEY.format('p_name')} ELSE {_KEY.format("split_part(p_name, ' ', 1)")} || ' x' END AS k FROM part), w AS (SELECT *, list_distinct(string_split(k, ' ')) AS w FROM p),
x AS (SELECT a.lecture_id, a.id AS concept_id, b.id AS b, CASE WHEN a.k = b.k THEN 1 WHEN contains(a.k, b.k) OR contains(b.k, a.k) THEN greatest(0.82, len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) ELSE len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS s FROM w a JOIN w b ON a.lecture_id = b.lecture_id AND a.id % 2 = 0 AND b.id % 2 = 1 AND len(list_intersect(a.w, b.w)) > 0),
m AS (SELECT lecture_id, concept_id, arg_max(b, (round(s, 9), -b)) AS note_concept_id, round(max(s), 9) AS score FROM x GROUP BY ALL) SELECT w.lecture_id, id AS concept_id, note_concept_id, coalesce(score, 0) AS score FROM w LEFT JOIN m ON m.lecture_id = w.lecture_id AND concept_id = id WHERE id % 2 = 0""",
    "j8_review_priority": f"WITH {_COV}, r AS (SELECT lecture_id, title, CASE WHEN visual THEN 'missing' ELSE state END AS state, round((importance + CASE WHEN visual THEN 0.1 ELSE 0 END::double) * CASE WHEN visual OR state = 'missing' THEN 1.35 ELSE 1.05 END::double, 9) AS priority FROM items WHERE visual OR state <> 'covered') SELECT lecture_id, (row_number() OVER (PARTITION BY lecture_id ORDER BY priority DESC, lower(title), title, state))::int AS rank, state, round(priority, 6) AS priority FROM r",
    "j10_coverage_report": f"WITH {_COV}, c AS (SELECT lecture_id, count(*) FILTER (NOT visual) AS n, count(*) FILTER (NOT visual AND state = 'missing') AS missing, count(*) FILTER (NOT visual AND state = 'partial') AS partial, count(*) FILTER (NOT visual AND state = 'covered') AS covered, count(*) FILTER (visual) AS visual, sum(CASE WHEN visual THEN 0 ELSE greatest(importance, 0.1) END) AS t, sum(CASE WHEN visual THEN -0.12 * greatest(importance, 0.1) WHEN state = 'covered' THEN greatest(importance, 0.1) WHEN state = 'partial' THEN 0.55 * greatest(importance, 0.1) ELSE 0 END) AS g FROM items GROUP BY lecture_id) SELECT lecture_id, missing, partial, covered, visual, format('{{}}% completeness across {{}} lecture concepts, with {{}} missing, {{}} partial, {{}} covered, and {{}} missing visual cues.', round(round(greatest(0, least(1, g / t)) * 100, 9))::int, n, missing, partial, covered, visual) AS summary FROM c",
}
