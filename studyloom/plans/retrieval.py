"""Queries of the retrieval, graph view and structure operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import text as fn
from studyloom.operators import retrieval as op
from studyloom.operators import structure
from studyloom.plans._tables import EDGES, MASTERY, concepts, edges, mastery, table
from studyloom.plans.structure import _BLOCKS, _LINES
from studyloom.plans.text import _KEY, _SENT, _WORDS
from studyloom.sources.store import keep


def e9_expand(spark, d):
    seeds = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("node"))
    return op.expand(seeds, edges(spark, d), 2, 3, 10).select("query_id", "rank", "node", "distance")


def e10_query_terms(spark, d):
    return op.query_terms(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def _confident(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), (F.col("p_size") / 60).alias("confidence"))


def e14_node_attributes(spark, d):
    learner = mastery(spark, d).where("concept_id % 5 > 0").select("concept_id", "mastery", (F.col("mastery") * 0.9).alias("retention"))
    df = op.node_attributes(_confident(spark, d), edges(spark, d), learner)
    return df.select("concept_id", *[F.round(c, 9).alias(c) for c in ("importance", "difficulty", "mastery", "retention")], "risk", "n_edges")


def e15_filter_graph(spark, d):
    nodes, inside = op.filter_graph(mastery(spark, d), edges(spark, d), (F.col("mastery") < 0.6) & (F.col("mistake_count") > 0), 0.5)
    return nodes.select(F.lit("node").alias("kind"), F.col("concept_id").alias("id")).unionByName(inside.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


def e16_concept_tree(spark, d):
    return op.concept_tree(concepts(spark, d), edges(spark, d))


def e17_note_graph(spark, d):
    notes = _confident(spark, d).select(F.floor(F.log2(F.col("concept_id") + 1)).alias("note_id"), "concept_id", "confidence")
    more = notes.select((F.col("note_id") + 1).alias("note_id"), "concept_id", "confidence")
    return op.note_graph(notes.unionByName(more), edges(spark, d))


def _hits(spark, d):
    p = table(spark, d, "part")
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c % len(v) + 1).cast("int"))
    k = F.col("p_partkey")
    return p.select(
        F.floor(k / 12).alias("query_id"), k.alias("hit_id"), pick(k, "lexical", "graph", "vector", "lexical").alias("origin"), pick(k, "note", "chunk", "concept").alias("kind"), F.col("p_name").alias("title"), F.col("p_type").alias("content"),
        (k % 5).alias("n_sources"), F.when(k % 2 == 0, k).alias("relation_id"), k.alias("concept_id"), ((F.col("p_size") - 20) / 7).alias("relevance"), F.floor(k / 3).alias("note_id"), F.when(k % 4 > 0, F.col("p_size")).alias("updated_at"),
    )


def f10_rerank(spark, d):
    q = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 12).alias("query_id")).agg(F.min(F.element_at(F.split("p_name", " "), 1)).alias("query"))
    return op.rerank(_hits(spark, d), q, mastery(spark, d).where("concept_id % 3 = 0"), 8).select("query_id", "rank", "hit_id", F.round("score", 9).alias("score"))


def f12_final_order(spark, d):
    return op.final_order(_hits(spark, d).withColumn("score", F.col("relevance"))).select("query_id", "rank", "hit_id")


def f13_citations(spark, d):
    h = _hits(spark, d)
    one = F.struct(F.col("kind").alias("kind"), F.col("note_id").alias("id"), F.col("title").alias("source_title"), F.substring("content", 1, 9).alias("snippet"))
    none = F.expr("cast(array() as array<struct<kind: string, id: bigint, source_title: string, snippet: string>>)")
    return op.citations(h.select("query_id", "hit_id", F.when(F.col("n_sources") == 0, none).otherwise(F.array(one, one)).alias("sources")))


def k1_graph_rerank(spark, d):
    items = _confident(spark, d).select("concept_id", F.col("confidence").alias("importance"))
    return op.graph_rerank(items, edges(spark, d), mastery(spark, d)).select("concept_id", F.round("importance", 9).alias("importance"))


def g4_text_similarity(spark, d):
    """Each document's text and that of the next one. Buckets by md5, which SQL has as well."""
    made = keep(op.hashed_embedding(_docs(spark, d), hashed="md5"))
    df = op.embedding_similarity(made, made.withColumn("doc_id", F.col("doc_id") - 1))
    return df.select("doc_id", F.round("similarity", 5).alias("similarity"))


def g7_grade_answers(spark, d):
    p = table(spark, d, "part")
    answer = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).otherwise(F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1), "p_type"))
    keys = F.split(F.concat_ws(",", "p_name", F.element_at(F.split("p_type", " "), 1), F.element_at(F.split("p_name", " "), 1)), ",")
    return op.grade_answers(p.select(F.col("p_partkey").alias("answer_id"), answer.alias("answer"), F.col("p_name").alias("expected"), F.when(F.col("p_size") % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(keys).alias("keywords"), (F.col("p_size") / 50).alias("similarity"))).select("answer_id", "grade", "score", F.round("keyword_overlap", 9).alias("keyword_overlap"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def b1_normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(structure.normalize_text(F.col("text"))).alias("text_md5"))


def b6_section_tree(spark, d):
    return structure.section_tree(_docs(spark, d))


def b9_block_views(spark, d):
    return structure.block_views(_docs(spark, d))


def b12_section_complexity(spark, d):
    df = structure.section_complexity(structure.split_sections(structure.detect_blocks(_docs(spark, d))))
    return df.select("doc_id", "section_line", "n_words", "n_sentences", F.round("density", 9).alias("density"), "minutes")


def b16_paragraphs(spark, d):
    return structure.paragraphs(_docs(spark, d))


def b19_validate_structure(spark, d):
    """Blocks of each third document are moved so that they overlap or end before they begin, others lose their tokens."""
    b = structure.detect_blocks(_docs(spark, d))
    at = F.col("doc_id") % 6
    b = b.withColumn("end_line", F.when(at == 0, F.col("end_line") + 1).when(at == 3, F.col("start_line") - 1).otherwise(F.col("end_line"))).withColumn("tokens", F.when(at == 1, 0).otherwise(F.col("tokens")))
    b = b.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(at == 2, 2).otherwise(1)))).drop("copy")
    return structure.validate_structure(b, structure.section_tree(_docs(spark, d)))


def c3_fold_key(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(structure.fold_key(F.coalesce("text", F.lit("")))).alias("key_md5"))


def a1_notes_by_folder(spark, d):
    """Nations as notes in regions as folders, in order, and nested."""
    from studyloom.sources import notes

    folders = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"), (5 - F.col("r_regionkey")).alias("sort_order"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("folder_id"), F.col("n_name").alias("title"), (F.col("n_nationkey") * 7 % 25).alias("note_order"))
    df = notes.notes_by_folder(folders, n)
    return df.select("folder", "sort_order", F.array_join(F.transform("notes", lambda x: x["title"]), ",").alias("notes"))


QUERIES = {f.__name__: f for f in (e9_expand, e10_query_terms, e14_node_attributes, e15_filter_graph, e16_concept_tree, e17_note_graph, f10_rerank, f12_final_order, f13_citations, k1_graph_rerank, g4_text_similarity, g7_grade_answers, b1_normalize_text, b6_section_tree, b9_block_views, b12_section_complexity, b16_paragraphs, b19_validate_structure, c3_fold_key, a1_notes_by_folder)}

_E = f"WITH RECURSIVE {EDGES}"
_HITS = "h AS (SELECT p_partkey // 12 AS query_id, p_partkey AS hit_id, ['lexical', 'graph', 'vector', 'lexical'][p_partkey % 4 + 1] AS origin, ['note', 'chunk', 'concept'][p_partkey % 3 + 1] AS kind, p_name AS title, p_type AS content, p_partkey % 5 AS n_sources, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS relation_id, (p_size - 20) / 7::double AS relevance, p_partkey // 3 AS note_id, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS updated_at FROM part)"
_TITLE = r"trim(CASE WHEN starts_with(t, '#') THEN regexp_replace(t, '^[# ]+', '') WHEN regexp_matches(t, '^\d+(?:\.\d+)*[.)]?\s+') THEN regexp_replace(t, '^\d+(?:\.\d+)*[.)]?\s+', '') WHEN ends_with(t, ':') THEN regexp_replace(t, ':$', '') ELSE t END)"
_LEVEL = r"least(6, CASE WHEN starts_with(t, '#') THEN length(regexp_extract(t, '^#+')) WHEN regexp_extract(t, '^\d+(?:\.\d+)*[.)]?\s+') <> '' THEN greatest(1, len(list_filter(string_split(trim(regexp_extract(t, '^\d+(?:\.\d+)*[.)]?\s+')), '.'), lambda p: p <> ''))) ELSE 1 END)"
_TREE = f"{_LINES}, hd AS (SELECT k.doc_id, k.line_no AS line, {_LEVEL} AS level, {_TITLE} AS title FROM k JOIN tr ON tr.doc_id = k.doc_id AND tr.line_no = k.line_no WHERE kind = 'heading'), tree AS (SELECT doc_id, 'section-' || level || '-' || row_number() OVER (PARTITION BY doc_id ORDER BY line) || '-' || regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g') AS section_id, line, level, title, coalesce((SELECT max(b.line) FROM hd b WHERE b.doc_id = a.doc_id AND b.line < a.line AND b.level < a.level), -1) AS parent_line FROM hd a)"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_MARKS = r"""regexp_replace(regexp_replace(replace(translate(line, '“”„‘’—–•· ' || chr(9), '\"\"\"''''----  '), '…', '...'), '\s+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')""".replace('\\"', '"')
ORACLES = {
    "e9_expand": f"{_E}, x AS (SELECT source_id AS node, target_id AS nxt, confidence, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, edge_id) AS n FROM edges UNION ALL SELECT target_id, source_id, confidence, row_number() OVER (PARTITION BY target_id ORDER BY confidence DESC, edge_id) FROM edges), s AS (SELECT node, nxt, max(confidence) AS c FROM x WHERE n <= 3 GROUP BY ALL), a AS (SELECT p_partkey AS q, nxt AS node, c FROM part JOIN s ON node = p_partkey WHERE nxt <> p_partkey), b AS (SELECT a.q, s.nxt AS node, max(s.c) AS c FROM a JOIN s ON s.node = a.node WHERE s.nxt <> a.q AND (a.q, s.nxt) NOT IN (SELECT (q, node) FROM a) GROUP BY ALL), u AS (SELECT p_partkey AS query_id, p_partkey AS node, 0 AS distance, 1.0::double AS c FROM part UNION ALL SELECT q, node, 1, c FROM a UNION ALL SELECT q, node, 2, c FROM b), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, c DESC, node))::int AS rank, node, distance FROM u) SELECT * FROM r WHERE rank <= 10",
    "e10_query_terms": f"WITH q AS (SELECT item_id, list_filter(string_split({_KEY.format('text')}, ' '), lambda x: x <> '') AS w FROM benchmark) SELECT DISTINCT item_id AS query_id, unnest([array_to_string(w, ' ')] || w || list_transform(range(1, len(w)), lambda i: array_to_string(list_slice(w, i, i + 1), ' ')) || list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS term FROM q WHERE len(w) > 0",
    "e14_node_attributes": f"{_E}, {MASTERY}, g AS (SELECT id, count(*) AS n FROM (SELECT edge_id, source_id AS id FROM edges UNION SELECT edge_id, target_id FROM edges) GROUP BY id), x AS (SELECT p_partkey AS concept_id, p_size / 60::double AS c, coalesce(n, 0) AS n_edges, CASE WHEN p_partkey % 5 > 0 THEN mastery ELSE 0.5 END AS m, CASE WHEN p_partkey % 5 > 0 THEN mastery * 0.9::double ELSE 0.5 END AS r FROM part JOIN mastery ON concept_id = p_partkey LEFT JOIN g ON g.id = p_partkey) SELECT concept_id, round(least(1::double, greatest(0::double, c + least(0.3::double, n_edges * 0.04::double))), 9) AS importance, round(1 - m, 9) AS difficulty, round(m, 9) AS mastery, round(r, 9) AS retention, CASE WHEN r < 0.35 THEN 'High Risk' WHEN r < 0.65 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk, n_edges FROM x",
    "e15_filter_graph": f"{_E}, {MASTERY}, n AS (SELECT concept_id FROM mastery WHERE mastery < 0.6 AND mistake_count > 0) SELECT 'node' AS kind, concept_id AS id FROM n UNION ALL SELECT 'edge', edge_id FROM edges WHERE confidence >= 0.5::double AND source_id IN (SELECT concept_id FROM n) AND target_id IN (SELECT concept_id FROM n)",
    "e16_concept_tree": f"{_E}, ro AS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT target_id FROM edges WHERE source_id <> target_id) ORDER BY lower(p_name), p_name, p_partkey LIMIT 5), r AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS distance FROM ro UNION SELECT r.root, e.target_id, r.distance + 1 FROM r JOIN edges e ON e.source_id = r.node WHERE r.distance < 8) SELECT root, node, min(distance) AS distance FROM r GROUP BY ALL",
    "e17_note_graph": f"{_E}, c AS (SELECT floor(log2(p_partkey + 1))::bigint AS note_id, p_partkey AS id, p_size / 60::double AS c FROM part), n AS (SELECT * FROM c UNION ALL SELECT note_id + 1, id, c FROM c), u AS (SELECT note_id, 'concept' AS kind, id, c FROM n UNION ALL SELECT a.note_id, 'edge', edge_id, confidence FROM edges JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id AND b.note_id = a.note_id) SELECT note_id, kind, id, (row_number() OVER (PARTITION BY note_id, kind ORDER BY c DESC, id))::int AS rank FROM u",
    "f10_rerank": f"WITH {MASTERY}, {_HITS}, q AS (SELECT p_partkey // 12 AS query_id, min(split_part(p_name, ' ', 1)) AS q FROM part GROUP BY 1), x AS (SELECT h.*, relevance / (abs(relevance) + 1) + CASE origin WHEN 'lexical' THEN 1 WHEN 'graph' THEN 0.86 ELSE 0.5 END::double + least(0.12::double, n_sources * 0.04::double) + CASE WHEN relation_id IS NULL THEN 0 ELSE 0.08 END::double + CASE kind WHEN 'note' THEN 0.08 WHEN 'chunk' THEN 0.12 ELSE 0.16 END::double + CASE WHEN contains(lower(title) || ' ' || lower(content), q) THEN 0.08 ELSE 0 END::double + CASE WHEN kind = 'note' AND (contains(lower(title), q) OR contains(lower(content), q)) THEN 3 ELSE 0 END::double + CASE WHEN kind <> 'note' THEN (1 - CASE WHEN hit_id % 3 = 0 THEN mastery ELSE 0.5 END) * 0.1::double ELSE 0 END AS score FROM h JOIN q USING (query_id) JOIN mastery ON concept_id = hit_id), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, kind, lower(title), hit_id))::int AS rank, hit_id, round(score, 9) AS score FROM x) SELECT * FROM r WHERE rank <= 8",
    "f12_final_order": f"WITH {_HITS} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY (kind = 'note') DESC, round(relevance, 9) DESC, updated_at DESC NULLS LAST, hit_id))::int AS rank, hit_id FROM h",
    "f13_citations": f"WITH {_HITS} SELECT query_id, hit_id, kind, note_id AS id, title AS source_title, substr(content, 1, 9) AS snippet FROM h WHERE n_sources > 0",
    "k1_graph_rerank": f"{_E}, {MASTERY}, g AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id), w AS (SELECT DISTINCT source_id FROM edges LEFT JOIN mastery ON concept_id = target_id WHERE relation = 'REQUIRES' AND coalesce(mastery, 0.5) < 0.5), b AS (SELECT DISTINCT target_id FROM edges WHERE relation = 'REQUIRES') SELECT p_partkey AS concept_id, round(least(1::double, greatest(0::double, p_size / 60::double + least(0.18::double, coalesce(n, 0) * 0.03::double) + CASE WHEN p_partkey IN (SELECT target_id FROM b) AND mastery < 0.65 THEN 0.14 ELSE 0 END::double - CASE WHEN p_partkey IN (SELECT source_id FROM w) THEN 0.18 ELSE 0 END::double)), 9) AS importance FROM part JOIN mastery ON concept_id = p_partkey LEFT JOIN g ON g.id = p_partkey",
    "g4_text_similarity": f"""WITH w AS (SELECT doc_id, list_filter(string_split({_KEY.format("coalesce(text, '')")}, ' '), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS t, 1.0::double AS v FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), {op.PAIR_WEIGHT}::double FROM w),
e AS MATERIALIZED (SELECT doc_id, ('0x' || substr(md5(t), 1, 7))::bigint % {op.DIMENSION} AS b, sum(v) AS v FROM t GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM e GROUP BY doc_id),
c AS (SELECT x.doc_id, sum(x.v * y.v) AS s FROM e x JOIN e y ON y.doc_id = x.doc_id + 1 AND y.b = x.b GROUP BY x.doc_id)
SELECT a.doc_id, round(coalesce(s / (x.n * y.n), 0), 5) AS similarity FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 LEFT JOIN c ON c.doc_id = a.doc_id LEFT JOIN n x ON x.doc_id = a.doc_id LEFT JOIN n y ON y.doc_id = b.doc_id""",
    "g7_grade_answers": f"WITH p AS (SELECT p_partkey AS answer_id, {_KEY.format('''CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE split_part(p_name, ' ', 1) || ' ' || p_type END''')} AS a, {_KEY.format('p_name')} AS e, CASE WHEN p_size % 3 = 0 THEN [] ELSE [{_KEY.format('p_name')}, {_KEY.format('''split_part(p_type, ' ', 1)''')}, {_KEY.format('''split_part(p_name, ' ', 1)''')}] END AS k, p_size / 50::double AS s FROM part), o AS (SELECT *, CASE WHEN len(k) = 0 THEN 0 ELSE len(list_filter(k, lambda z: contains(a, z)))::double / len(k) END AS o FROM p), g AS (SELECT *, greatest(s, o) AS b FROM o) SELECT answer_id, CASE WHEN a = e OR b >= 0.9 THEN 'correct' WHEN b >= 0.75 THEN 'mostlyCorrect' WHEN b >= 0.6 OR o >= 0.5 THEN 'partialUnderstanding' ELSE 'incorrect' END AS grade, CASE WHEN a = e OR b >= 0.9 THEN 1 WHEN b >= 0.75 THEN 0.85 WHEN b >= 0.6 THEN 0.7 WHEN o >= 0.5 THEN 0.6 ELSE 0 END::double AS score, round(CASE WHEN a = e THEN 1 ELSE o END, 9)::double AS keyword_overlap FROM g",
    "b1_normalize_text": rf"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, starts_with({_TRIM.format('line')}, '```') AS fence, sum(starts_with({_TRIM.format('line')}, '```')::int) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS code FROM l),
k AS (SELECT doc_id, n, fence, CASE WHEN fence THEN {_TRIM.format('line')} WHEN code THEN {_TRIM.format("replace(line, chr(9), '    ')")} ELSE {_TRIM.format(_MARKS)} END AS t FROM f),
b AS (SELECT *, t = '' AND coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY n) = '', false) AS gone FROM k)
SELECT d.doc_id, md5(CASE WHEN d.text IS NOT NULL THEN regexp_replace(coalesce(t, ''), '^\n+|\n+$', '', 'g') END) AS text_md5 FROM documents d LEFT JOIN (SELECT doc_id, string_agg(t, chr(10) ORDER BY n) AS t FROM b WHERE NOT gone GROUP BY doc_id) x ON x.doc_id = d.doc_id""",
    "b6_section_tree": f"WITH {_TREE} SELECT doc_id, section_id, line::int AS line, level::int AS level, title, parent_line::int AS parent_line FROM tree",
    "b9_block_views": f"WITH {_LINES} SELECT k.doc_id, kind AS view, k.line_no::int AS line, t AS text FROM k JOIN tr ON tr.doc_id = k.doc_id AND tr.line_no = k.line_no WHERE kind NOT IN ('paragraph', 'blank') AND NOT starts_with(t, '```')",
    "b12_section_complexity": f"WITH {_BLOCKS}, ct AS (SELECT g.doc_id, block, any_value(g.kind) AS kind, min(g.line_no) AS a, string_agg(tr.line, chr(10) ORDER BY g.line_no) AS content FROM g JOIN tr ON tr.doc_id = g.doc_id AND tr.line_no = g.line_no WHERE g.kind <> 'blank' GROUP BY ALL), s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN a END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY a), -1) AS sec FROM ct), x AS (SELECT doc_id, sec::int AS section_line, sum({_WORDS.format('content')})::bigint AS n_words, sum(len({_SENT.format('content')}))::bigint AS n_sentences, count(*) FILTER (kind <> 'paragraph') AS n FROM s GROUP BY ALL) SELECT doc_id, section_line, n_words, n_sentences, round(least(1::double, n::double / greatest(1, n_sentences)), 9) AS density, greatest(1, ceil(n_words / 180::double))::bigint AS minutes FROM x",
    "b16_paragraphs": r"WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::int AS n, trim(unnest(string_split(text, chr(10)))) AS t FROM documents WHERE text IS NOT NULL), o AS (SELECT *, CASE WHEN t = '' OR (regexp_matches(t, '^\p{Lu}[^:]*:') AND length(t) < 80) OR lag(t) OVER w IS NULL OR lag(t) OVER w = '' THEN 1 ELSE 0 END AS o FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)), r AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM o) SELECT doc_id, min(n) AS first_line, max(n) AS last_line FROM r WHERE t <> '' GROUP BY doc_id, run",
    "b19_validate_structure": f"WITH {_BLOCKS}, b AS (SELECT doc_id, kind || '-' || a || '-' || b AS block_id, a, CASE doc_id % 6 WHEN 0 THEN b + 1 WHEN 3 THEN a - 1 ELSE b END AS b FROM bl), d AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE doc_id % 6 = 2), v AS (SELECT doc_id, 'repeated block' AS rule FROM d GROUP BY doc_id, block_id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'lines out of order' FROM d WHERE b < a UNION ALL SELECT doc_id, 'overlapping blocks' FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a, block_id) AS z FROM d) WHERE z >= a UNION ALL SELECT doc_id, 'no tokens' FROM d WHERE doc_id % 6 = 1) SELECT doc_id, rule, count(*) AS n FROM v GROUP BY ALL",
    "c3_fold_key": f"SELECT doc_id, md5({_KEY.format('strip_accents(lower(text))')}) AS key_md5 FROM documents",
    "a1_notes_by_folder": "SELECT r_name AS folder, 5 - r_regionkey AS sort_order, string_agg(n_name, ',' ORDER BY n_nationkey * 7 % 25, n_nationkey) AS notes FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL",
}
