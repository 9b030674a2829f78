"""Queries of the linking operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import text as fn
from studyloom.operators import concepts as names
from studyloom.operators import linking as op
from studyloom.operators import text
from studyloom.plans._tables import EDGES, edges, table
from studyloom.plans.concepts import _S, _STEM, _SUBSEQ
from studyloom.plans.text import _KEY


def f6_keyword_score(spark, d):
    p = table(spark, d, "part")
    query = F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), F.lit("ps")))
    terms = F.filter(F.split(F.lower(query), " "), lambda x: x != "")
    score = op.keyword_score(F.col("p_name"), F.col("p_type"), F.col("p_brand"), query, terms, F.col("p_size") * 43200)
    return p.select("p_partkey", F.round(score, 9).alias("score")).where("score is not null")


def f8_match_labels(spark, d):
    """All parts as labels; a brand's query is its least part name's first word."""
    p = table(spark, d, "part")
    asked = p.groupBy("p_brand").agg(F.element_at(F.split(F.min("p_name"), " "), 1).alias("query"))
    labels = p.join(asked, "p_brand").select("p_brand", F.col("p_partkey").alias("label_id"), "query", F.col("p_name").alias("title"), F.col("p_type").alias("subtitle"), F.col("p_brand").alias("keywords"))
    return op.match_labels(labels, "p_brand")


def _sentences(spark, d):
    return text.sentences(table(spark, d, "documents").select("doc_id", "text"))


def g8_grade_explanations(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("concept"))
    s = _sentences(spark, d).join(docs, "doc_id").withColumn("answer", F.when(F.col("pos") % 3 == 0, F.concat_ws(" ", "sentence", F.lit("because"), "concept")).otherwise(F.col("sentence")))
    return op.grade_explanations(s).select("doc_id", "pos", "label", F.round("confidence", 9).alias("confidence"))


def _found(spark, d):
    """Sentences that name the longer words of the benchmark; a word is a concept."""
    w = table(spark, d, "benchmark").select(F.explode(F.split(fn.norm_key(F.col("text")), " ")).alias("name")).where("length(name) > 7").distinct()
    s = _sentences(spark, d)
    return names.mentions(s, w.select(F.col("name").alias("concept_id"), "name")), s


def h19_link_items(spark, d):
    found, s = _found(spark, d)
    item = F.concat_ws("-", "doc_id", "pos")
    fallback = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a general topic"), F.lit("another"))).otherwise(F.array(F.lit("another")))
    linked = op.link_items(s.select(item.alias("item_id"), fallback.alias("fallback")), found.select(item.alias("item_id"), "concept_id"))
    return linked.select("item_id", F.array_join("concept_ids", ",").alias("concept_ids"))


def c30_star_relationships(spark, d):
    found, s = _found(spark, d)
    told = s.withColumn("sentence", F.when(F.col("pos") % 4 == 0, F.concat("sentence", F.lit(" Leads to"))).otherwise(F.col("sentence")))
    return op.star_relationships(found.withColumn("listed", F.length("concept_id")), told)


def c32_topic_tree(spark, d):
    c = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("note_id"), F.col("p_partkey").alias("concept_id"), F.col("p_size").alias("listed"))
    return op.topic_tree(c, edges(spark, d))


def j4_visual_cues(spark, d):
    """Documents as slides, PDFs and sound by turns; lines of an even length speak of a table."""
    kind = F.element_at(F.array(F.lit("slides"), F.lit("pdf"), F.lit("audio")), (F.col("doc_id") % 3 + 1).cast("int"))
    said = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) % 2 == 0, F.concat(F.lit("• Table: "), x)).otherwise(x)), "\n")
    df = op.visual_cues(table(spark, d, "documents").select("doc_id", kind.alias("kind"), said.alias("text")))
    return df.select("doc_id", F.col("line").alias("at_line"), F.md5("title").alias("title_md5"), "importance")


def j11_self_coverage(spark, d):
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("c"), F.countDistinct("p_type").alias("t"))
    return n.select("p_brand", F.round(op.self_coverage(F.col("c"), F.col("t")), 9).alias("coverage"))


def d6_all_aliases(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("concept_id"), "p_name", "p_type")
    df = op.all_aliases(p.select("concept_id", F.col("p_name").alias("alias")), p.select("concept_id", F.lower("p_type").alias("alias")).union(p.select("concept_id", "p_name")))
    return df.select("concept_id", F.array_join("aliases", "|").alias("aliases"))


def f16_learner_summary(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    none = F.expr("cast(array() as array<string>)")
    some = lambda n, *c: F.when(k % n == 0, F.array(*c)).otherwise(none)
    df = p.select(k.alias("learner_id"), some(2, "p_name", F.upper("p_name")).alias("weak"), some(3, "p_type", F.lit(" ")).alias("strong"), some(5, F.concat(F.lit(" "), "p_name"), "p_brand").alias("missing"), some(7, "p_brand", "p_type").alias("gaps"), (k % 11 % 5).alias("n_sources"))
    return op.learner_summary(df).select("learner_id", F.array_join("identified_gaps", "|").alias("gaps"), "level", F.round("confidence", 9).alias("confidence"))


def j13_set_coverage(spark, d):
    """A brand is a lecture: its parts are concepts with their types as related ones; the name or type of each 23rd part is in its notes."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    source = p.select(F.col("p_brand").alias("lecture_id"), k.alias("concept_id"), F.col("p_name").alias("title"), F.array("p_type").alias("related"))
    before = p.where(k % 4 == 0).select(F.col("p_brand").alias("lecture_id"), F.upper("p_name").alias("title"))
    notes = p.where(k % 23 == 0).select(F.col("p_brand").alias("lecture_id"), F.when(k % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("title"))
    return op.set_coverage(source, before, notes).select("lecture_id", "n", "covered", "partial", "missing", F.round("score", 9).alias("score"))


QUERIES = {f.__name__: f for f in (f6_keyword_score, f8_match_labels, g8_grade_explanations, h19_link_items, c30_star_relationships, c32_topic_tree, j4_visual_cues, j11_self_coverage, d6_all_aliases, f16_learner_summary, j13_set_coverage)}

_TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: length(w) > 2)"
_ANY = lambda c, cues: "(" + " OR ".join(f"contains({c}, '{x}')" for x in cues) + ")"
_FOUND = f"{_S}, c AS (SELECT DISTINCT name, regexp_replace(name, 's$', '') AS gram FROM (SELECT unnest(string_split({_KEY.format('text')}, ' ')) AS name FROM benchmark) WHERE length(name) > 7), w AS (SELECT DISTINCT doc_id, pos, unnest({_STEM.format(_KEY.format('sentence'))}) AS gram FROM s), m AS (SELECT DISTINCT doc_id, pos, name AS concept_id FROM w JOIN c USING (gram))"
_POINTS = "CASE WHEN contains(t, {0}) THEN 3 WHEN contains(b, {0}) THEN 4 WHEN contains(f, {0}) THEN 1.5 WHEN " + " OR ".join(_SUBSEQ.format("{0}", c) for c in "tbf") + " THEN 1.25 ELSE 0 END::double"
ORACLES = {
    "f6_keyword_score": f"WITH x AS (SELECT p_partkey, p_size, lower(p_name) AS t, lower(p_type) AS b, lower(p_brand) AS f, lower(list_last(string_split(p_name, ' '))) AS a FROM part), y AS (SELECT *, a || ' ps' AS q, {_POINTS.format('a')} + {_POINTS.format(chr(39) + 'ps' + chr(39))} AS n, 1 - least(1::double, p_size * 43200 / 1209600::double) AS r FROM x), z AS (SELECT *, n + CASE WHEN contains(t, q) THEN 4 ELSE 0 END + CASE WHEN contains(b, q) THEN 3 ELSE 0 END + CASE WHEN contains(f, q) THEN 1 ELSE 0 END AS m FROM y) SELECT p_partkey, round(CASE WHEN p_partkey % 7 = 0 THEN r ELSE m + r END, 9) AS score FROM z WHERE p_partkey % 7 = 0 OR m > 0",
    "f8_match_labels": f"WITH a AS (SELECT p_brand, lower(split_part(min(p_name), ' ', 1)) AS q FROM part GROUP BY p_brand), x AS (SELECT p_brand, p_partkey AS label_id, q, lower(p_name) AS t, lower(p_type) AS s, lower(p_brand) AS k FROM part JOIN a USING (p_brand)), y AS (SELECT *, t || ' ' || s || ' ' || k AS sp FROM x), z AS (SELECT *, (CASE WHEN contains(sp, q) THEN 40 ELSE 0 END + CASE WHEN starts_with(t, q) THEN 30 ELSE 0 END + CASE WHEN contains(t, q) THEN 18 WHEN contains(s, q) THEN 10 WHEN contains(k, q) THEN 12 WHEN {_SUBSEQ.format('q', 'sp')} THEN 6 ELSE 0 END)::int AS score FROM y) SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, t, label_id))::int AS rank, label_id, score FROM z WHERE score > 0",
    "g8_grade_explanations": f"WITH {_S}, a AS (SELECT doc_id, pos, {_TOKENS.format('''CASE WHEN pos % 3 = 0 THEN concat_ws(' ', sentence, 'because', source, lang) ELSE sentence END''')} AS w, {_TOKENS.format('''concat_ws(' ', source, lang)''')} AS own FROM s JOIN documents USING (doc_id)), b AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: list_contains(own, x))) AS o, len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in op.EXPLANATORY)}))) AS e FROM a), g AS (SELECT *, CASE WHEN n = 0 THEN 'incorrect' WHEN n >= 10 AND (o > 0 OR e >= 2 OR len(own) = 0) THEN 'correct' WHEN n >= 4 OR o > 0 OR e > 0 THEN 'partiallyCorrect' ELSE 'incorrect' END AS label FROM b) SELECT doc_id, pos, label, round(CASE label WHEN 'correct' THEN 0.82 WHEN 'partiallyCorrect' THEN 0.55 ELSE 0.25 END::double + least(n / 80::double, 0.08::double), 9) AS confidence FROM g",
    "h19_link_items": f"WITH {_FOUND}, f AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN ['a general topic', 'another'] ELSE ['another'] END AS f FROM s), g AS (SELECT doc_id, pos, list(concept_id) AS c FROM m GROUP BY ALL) SELECT doc_id || '-' || pos AS item_id, array_to_string(list_sort(CASE WHEN c IS NULL THEN f ELSE c || f[1:1] END), ',') AS concept_ids FROM f LEFT JOIN g USING (doc_id, pos)",
    "c30_star_relationships": f"WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY length(concept_id), concept_id) AS k FROM m), t AS (SELECT doc_id, pos, sentence || CASE WHEN pos % 4 = 0 THEN ' Leads to' ELSE '' END AS sentence FROM s), e AS (SELECT a.doc_id, a.pos, a.concept_id AS source_id, b.concept_id AS target_id, CASE {' '.join(f'WHEN {_ANY("lower(sentence)", cues)} THEN {k!r}' for k, cues in op.STAR_CUES.items())} ELSE 'relatedTo' END AS relation, CASE WHEN length(sentence) > 80 THEN 0.82 ELSE 0.68 END::double AS confidence FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.pos = a.pos AND a.k = 1 AND b.k BETWEEN 2 AND 4 JOIN t ON t.doc_id = a.doc_id AND t.pos = a.pos) SELECT doc_id, source_id, target_id, relation, arg_min(confidence, pos) AS confidence FROM e GROUP BY ALL",
    "c32_topic_tree": f"WITH {EDGES}, c AS (SELECT p_partkey // 20 AS note_id, p_partkey AS concept_id, (row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_size, p_partkey))::int AS place FROM part), n AS (SELECT concept_id, related_id, min(edge_id) AS e FROM (SELECT source_id AS concept_id, target_id AS related_id, edge_id FROM edges UNION ALL SELECT target_id, source_id, edge_id FROM edges) GROUP BY ALL), k AS (SELECT concept_id, related_id, (row_number() OVER (PARTITION BY concept_id ORDER BY e, related_id))::int AS related_place FROM n) SELECT note_id, place, c.concept_id, related_place, related_id FROM c LEFT JOIN k ON k.concept_id = c.concept_id AND related_place <= 3 WHERE place <= 6",
    "j4_visual_cues": rf"WITH l AS (SELECT doc_id, doc_id % 3 AS k, unnest(range(len(x)))::int AS line, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS raw FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda y: CASE WHEN length(y) % 2 = 0 THEN '• Table: ' || y ELSE y END) AS x FROM documents WHERE doc_id % 3 < 2)), v AS (SELECT *, regexp_replace(replace(raw, '•', ''), '^\s+|\s+$', '', 'g') AS b FROM l WHERE {_ANY(_KEY.format('raw'), op.VISUAL)}), t AS (SELECT doc_id, k, line, CASE WHEN length(b) <= 72 THEN b ELSE array_to_string(list_filter(string_split(b, ' '), lambda w: w <> '')[1:8], ' ') || '...' END AS title FROM v) SELECT doc_id, min(line) AS at_line, md5(arg_min(title, line)) AS title_md5, arg_min(CASE WHEN k = 0 THEN 1.4 ELSE 1.1 END::double, line) AS importance FROM t WHERE {_KEY.format('title')} <> '' GROUP BY doc_id, {_KEY.format('title')}",
    "j11_self_coverage": "SELECT p_brand, round(least(1::double, count(*) / greatest(1, count(*) + count(DISTINCT p_type))::double), 9) AS coverage FROM part GROUP BY p_brand",
    "d6_all_aliases": "SELECT concept_id, string_agg(alias, '|' ORDER BY alias) AS aliases FROM (SELECT p_partkey % 50 AS concept_id, p_name AS alias FROM part UNION SELECT p_partkey % 50, lower(p_type) FROM part) GROUP BY concept_id",
    "f16_learner_summary": "WITH x AS (SELECT p_partkey AS learner_id, p_partkey AS k, p_name, p_type, p_brand FROM part), y AS (SELECT *, list_distinct((CASE WHEN k % 2 = 0 THEN [lower(p_name)] ELSE [] END) || (CASE WHEN k % 7 = 0 THEN [lower(p_brand), lower(p_type)] ELSE [] END)) AS w, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS s, CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS m, CASE WHEN k % 5 = 0 THEN [p_name, p_brand] ELSE [] END || CASE WHEN k % 2 = 0 AND k % 5 > 0 THEN [p_name] ELSE [] END || CASE WHEN k % 7 = 0 THEN CASE WHEN k % 5 = 0 THEN [p_type] ELSE [p_brand, p_type] END ELSE [] END AS g FROM x), e AS (SELECT *, len(w) + s + m + least(3, k % 11 % 5) AS n FROM y) SELECT learner_id, array_to_string(g[1:3], '|') AS gaps, CASE WHEN m > 0 THEN 'Needs prerequisite support' WHEN len(w) > 0 THEN 'Developing understanding' WHEN s > 0 THEN 'Ready for deeper explanation' WHEN n > 0 THEN 'Context available' ELSE 'Unknown' END AS level, round(CASE WHEN n > 0 THEN least(0.85::double, 0.35::double + n * 0.1::double) ELSE 0 END, 9) AS confidence FROM e",
    "j13_set_coverage": f"WITH k AS (SELECT DISTINCT p_brand AS b, {_KEY.format('CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END')} AS key FROM part WHERE p_partkey % 23 = 0), x AS (SELECT p_brand AS b, (p_brand, {_KEY.format('p_name')}) IN (SELECT (b, key) FROM k) AS own, (p_brand, {_KEY.format('p_type')}) IN (SELECT (b, key) FROM k) AS near, p_partkey FROM part), g AS (SELECT b AS lecture_id, count(*) AS n, least(6, count(*) FILTER (own OR near)) AS covered, least(5, count(*) FILTER (near AND NOT own)) AS partial, least(5, count(*) FILTER (NOT own AND p_partkey % 4 = 0)) AS missing FROM x GROUP BY b) SELECT *, round(greatest(0::double, least(1::double, (covered + partial * 0.55::double + greatest(0, n - covered - partial - missing) * 0.18::double) / n)), 9) AS score FROM g",
}
