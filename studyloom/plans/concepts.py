"""Queries of the concept and coverage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import text as fn
from studyloom.operators import concepts as op
from studyloom.operators import text
from studyloom.plans._tables import table
from studyloom.plans.text import _KEY, _SENT, _STOP, _WORDS


def _sentences(spark, d):
    return text.sentences(table(spark, d, "documents").select("doc_id", "text"))


def _named(spark, d):
    """Concepts: the first two words of each benchmark item."""
    w = F.slice(F.filter(F.split(fn.norm_key(F.col("text")), " "), lambda x: x != ""), 1, 2)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("concept_id"), F.array_join(w, " ").alias("name"))


def c8_mentions(spark, d):
    return op.mentions(_sentences(spark, d), _named(spark, d)).select("doc_id", "pos", "concept_id", F.col("at").alias("place"))


def c15_relation_kind(spark, d):
    s = _sentences(spark, d).select("doc_id", "pos", F.concat(F.col("sentence"), F.when(F.col("pos") % 3 == 0, " leads to x").when(F.col("pos") % 3 == 1, " includes y").otherwise("")).alias("sentence"))
    kind = op.relation_kind(F.col("sentence"))
    c17 = op.relation_confidence(F.col("sentence"), kind, F.col("pos") % 2 == 0, F.col("pos") % 5 == 0)
    return s.groupBy(kind.alias("relation"), F.round(c17, 6).alias("c17_confidence")).agg(F.count("*").alias("n"))


def _words_named(spark, d):
    """Concepts: each word of a benchmark item by itself, so that sentences name several."""
    w = F.filter(F.split(fn.norm_key(F.col("text")), " "), lambda x: F.length(x) > 3)
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(w).alias("nth", "name"))
    return words.groupBy("name").agg(F.min(F.col("item_id") * 1000 + F.col("nth")).alias("concept_id")).select("concept_id", "name")


def c16_relationships(spark, d):
    s = _sentences(spark, d)
    return op.extract_relationships(op.mentions(s, _words_named(spark, d)), s)


def c9_concept_scores(spark, d):
    p = table(spark, d, "part")
    name, n = F.col("p_name"), F.col("p_size")
    return p.select(
        "p_partkey",
        F.round(op.concept_importance(n / 20.0, n % 3 == 0, n % 4 == 0), 9).alias("importance"),
        F.round(op.concept_difficulty(name, n % 5), 9).alias("c10_difficulty"),
        F.round(op.concept_confidence(n % 2 == 0, n % 3 == 0, n % 7), 9).alias("c13_confidence"),
    )


def c20_strategy(spark, d):
    s = op.strategy(fn.approx_tokens(F.col("text"), "quarter"))
    return table(spark, d, "documents").groupBy(s["tier"].alias("tier"), s["concept_limit"].alias("concept_limit")).agg(F.count("*").alias("n"))


def j6_completeness(spark, d):
    p = table(spark, d, "part")
    df = p.select("p_brand", op.coverage_state((F.col("p_partkey") % 11) / 10.0, (F.col("p_partkey") % 7) / 6.0).alias("state"), (F.col("p_size") / 50.0).alias("importance"), (F.col("p_partkey") % 9 == 0).alias("visual"))
    return op.completeness(df, "p_brand").select("p_brand", F.round("completeness", 9).alias("completeness"))


def j9_missing_detail(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").where("text is not null").select("doc_id", op.missing_detail(F.element_at(lines, 1), F.element_at(lines, -1)).alias("missing"))


def f7_label_score(spark, d):
    p = table(spark, d, "part")
    q = F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), F.lit("ps"))
    return p.select("p_partkey", op.label_score(q, F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("score"))


QUERIES = {f.__name__: f for f in (c8_mentions, c15_relation_kind, c16_relationships, c9_concept_scores, c20_strategy, j6_completeness, j9_missing_detail, f7_label_score)}

_S = f"s AS (SELECT doc_id, unnest(range(len(x)))::int AS pos, unnest(x) AS sentence FROM (SELECT doc_id, {_SENT.format('text')} AS x FROM documents))"
_STEM = "list_transform(string_split({0}, ' '), lambda w: regexp_replace(w, 's$', ''))"
_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(sentence, '{c}')" for c in cues) + f" THEN '{k}'" for k, cues in op.RELATION_CUES.items()) + " ELSE 'relatedTo' END"
_NAMED = f"c AS (SELECT item_id AS concept_id, list_slice(list_filter(string_split({_KEY.format('text')}, ' '), lambda w: w <> ''), 1, 2) AS n FROM benchmark), cn AS (SELECT concept_id, len(n) AS n, array_to_string(list_transform(n, lambda w: regexp_replace(w, 's$', '')), ' ') AS gram FROM c WHERE len(n) > 0)"
_SINGLE = f"bw AS (SELECT item_id, list_filter(string_split({_KEY.format('text')}, ' '), lambda x: length(x) > 3) AS x FROM benchmark), sw AS (SELECT item_id * 1000 + unnest(range(len(x))) AS id, unnest(x) AS name FROM bw), cn AS (SELECT min(id) AS concept_id, array_to_string({_STEM.format('name')}, ' ') AS gram, 1 AS n FROM sw GROUP BY name)"
_MEN = f"{_S}, {_NAMED}, w AS (SELECT doc_id, pos, {_STEM.format(_KEY.format('sentence'))} AS w FROM s), g AS (SELECT doc_id, pos, n, unnest(range(len(w) - n + 1))::int AS place, w FROM w, (SELECT DISTINCT n FROM cn) WHERE len(w) >= n), m AS (SELECT doc_id, pos, concept_id, min(place) AS place FROM g JOIN cn ON cn.n = g.n AND cn.gram = array_to_string(list_slice(w, place + 1, place + g.n), ' ') GROUP BY ALL)"
_SUBSEQ = "regexp_matches({1}, array_to_string(list_transform(string_split({0}, ''), lambda ch: regexp_escape(ch)), '.*'))"
ORACLES = {
    "c8_mentions": f"WITH {_MEN} SELECT * FROM m",
    "c15_relation_kind": f"WITH {_S}, t AS (SELECT pos, sentence || CASE pos % 3 WHEN 0 THEN ' leads to x' WHEN 1 THEN ' includes y' ELSE '' END AS sentence FROM s), k AS (SELECT *, {_KIND} AS relation FROM t) SELECT relation, round(least(1::double, greatest(0.25::double, 0.52::double + CASE WHEN contains(lower(sentence), lower(relation)) THEN 0.12 ELSE 0 END + CASE WHEN pos % 2 = 0 THEN 0.08 ELSE 0 END + CASE WHEN pos % 5 = 0 THEN 0.08 ELSE 0 END - CASE WHEN relation = 'relatedTo' THEN 0.08 ELSE 0 END)), 6) AS c17_confidence, count(*) AS n FROM k GROUP BY ALL",
    "c16_relationships": f"WITH {_MEN.replace(_NAMED, _SINGLE)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY place, concept_id) AS k FROM m), p AS (SELECT doc_id, pos, max(concept_id) FILTER (k = 1) AS source_id, max(concept_id) FILTER (k = 2) AS target_id FROM r GROUP BY ALL) SELECT doc_id, pos, source_id, target_id, {_KIND} AS relation FROM p JOIN s USING (doc_id, pos) WHERE target_id IS NOT NULL",
    "c9_concept_scores": f"SELECT p_partkey, round(least(1::double, 0.22::double + p_size / 20::double * 0.16::double + CASE WHEN p_size % 3 = 0 THEN 0.18 ELSE 0 END + CASE WHEN p_size % 4 = 0 THEN 0.12 ELSE 0 END), 9) AS importance, round(least(1::double, 0.2::double + least(0.35::double, len(list_filter(string_split({_KEY.format('p_name')}, ' '), lambda w: w <> '')) * 0.06::double) + CASE WHEN contains(p_name, '=') OR contains(p_name, '→') OR contains(p_name, '->') THEN 0.2 ELSE 0 END + CASE WHEN p_size % 5 <= 1 THEN 0.1 ELSE 0 END), 9) AS c10_difficulty, round(least(1::double, 0.38::double + CASE WHEN p_size % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.1 ELSE 0 END + least(0.3::double, (p_size % 7) * 0.08::double)), 9) AS c13_confidence FROM part",
    "c20_strategy": f"WITH t AS (SELECT greatest(1, {_WORDS.format('text')} // 4) AS n FROM documents) SELECT CASE WHEN n < 240 THEN 'singlePass' WHEN n < 900 THEN 'mapReduce' ELSE 'hierarchical' END AS tier, CASE WHEN n < 240 THEN 18 WHEN n < 900 THEN 28 ELSE 36 END AS concept_limit, count(*) AS n FROM t GROUP BY ALL",
    "j6_completeness": "WITH x AS (SELECT p_brand, (p_partkey % 11) / 10::double AS s, (p_partkey % 7) / 6::double AS d, greatest(p_size / 50::double, 0.1::double) AS w, p_partkey % 9 = 0 AS v FROM part), y AS (SELECT *, CASE WHEN s <= 0 THEN 'missing' WHEN s >= 0.75 AND d >= 0.65 THEN 'covered' WHEN s >= 0.4 OR d >= 0.35 THEN 'partial' ELSE 'missing' END AS state FROM x), g AS (SELECT p_brand, sum(CASE WHEN NOT v THEN w ELSE 0 END) AS total, sum(CASE WHEN v THEN -0.12::double * w WHEN state = 'covered' THEN w WHEN state = 'partial' THEN 0.55::double * w ELSE 0 END) AS got FROM y GROUP BY p_brand) SELECT p_brand, round(CASE WHEN total > 0 THEN greatest(0::double, least(1::double, got / total)) ELSE 0 END, 9) AS completeness FROM g",
    "j9_missing_detail": f"WITH x AS (SELECT doc_id, string_split({_KEY.format('split_part(text, chr(10), 1)')}, ' ') AS a, string_split({_KEY.format('split_part(text, chr(10), -1)')}, ' ') AS b FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, b, unnest(list_distinct(a)) AS w FROM x), k AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS r FROM u WHERE w <> '' AND NOT list_contains(b, w) AND w NOT IN {_STOP}), g AS (SELECT doc_id, string_agg(w, ' ' ORDER BY r) AS missing FROM k WHERE r <= 4 GROUP BY doc_id) SELECT doc_id, coalesce(missing, '') AS missing FROM x LEFT JOIN g USING (doc_id)",
    "f7_label_score": f"WITH x AS (SELECT p_partkey, lower(p_name) AS t, lower(p_type) AS s, lower(p_brand) AS k, lower(list_last(string_split(p_name, ' '))) AS a, lower(list_last(string_split(p_name, ' '))) || ' ps' AS q FROM part), y AS (SELECT *, t || ' ' || s || ' ' || k AS sp FROM x) SELECT p_partkey, (CASE WHEN contains(sp, q) THEN 40 ELSE 0 END + CASE WHEN starts_with(t, q) THEN 30 ELSE 0 END + CASE WHEN contains(t, a) THEN 18 WHEN contains(s, a) THEN 10 WHEN contains(k, a) THEN 12 WHEN {_SUBSEQ.format('a', 'sp')} THEN 6 ELSE 0 END + CASE WHEN contains(t, 'ps') THEN 18 WHEN contains(s, 'ps') THEN 10 WHEN contains(k, 'ps') THEN 12 WHEN regexp_matches(sp, 'p.*s') THEN 6 ELSE 0 END)::int AS score FROM y",
}
