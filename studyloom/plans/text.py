"""Queries of the text, search and vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import text as fn
from studyloom.operators import search, text
from studyloom.plans._tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


def _queries(spark, d):
    t = F.slice(F.array_distinct(F.filter(F.split(fn.norm_key(F.col("text")), " "), lambda w: w != "")), 1, 3)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(t, " ").alias("query"))


def b2_content_hash(spark, d):
    return _docs(spark, d).select("doc_id", fn.content_hash(F.element_at(F.split("text", "\n"), 1), F.col("text")).alias("hash"))


def b8_document_stats(spark, d):
    return text.document_stats(_docs(spark, d))


def b11_document_complexity(spark, d):
    s = text.document_stats(_docs(spark, d)).withColumn("n_signals", F.col("n_blank")).withColumn("n_blocks", F.col("n_lines"))
    df = text.document_complexity(s)
    return df.select("doc_id", "difficulty", *[F.round(c, 9).alias(c) for c in ("concept_density", "structural_density", "reading_score", "complexity")], "study_minutes")


def b13_token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", fn.token_estimate(F.col("text")).alias("tokens"), fn.approx_tokens(F.col("text")).alias("b18_words"), fn.approx_tokens(F.col("text"), "quarter").alias("b18_quarter"))


def b23_strip_marks(spark, d):
    return _docs(spark, d).select("doc_id", fn.fragment(fn.strip_marks(F.concat(F.col("text"), F.lit(" [12] x [3]")))).alias("fragment"))


def c1_sentences(spark, d):
    return text.sentences(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"), F.max("pos").alias("last_pos"))


def c2_norm_key(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(fn.norm_key(F.col("text"))).alias("key"))


def c7_term_frequency(spark, d):
    return text.term_frequency(_docs(spark, d))


def c25_top_keywords(spark, d):
    return text.top_keywords(_docs(spark, d), 12).select("doc_id", "rank", "term", "weight")


def c26_concept_doc_frequency(spark, d):
    return text.concept_doc_frequency(_docs(spark, d))


def c27_frequent_terms(spark, d):
    return text.frequent_terms(_docs(spark, d))


def f1_build_index(spark, d):
    return search.build_index(_docs(spark, d))


def f2_query_tokens(spark, d):
    return search.query_tokens(_queries(spark, d))


def f3_bm25(spark, d):
    df = search.bm25(_queries(spark, d), _docs(spark, d))
    return df.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def f4_recent(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return search.recent(e, "ts", "event_id", 50).select("event_id")


def f5_snippet(spark, d):
    return _docs(spark, d).select("doc_id", fn.snippet(F.col("text"), F.lit("that")).alias("snippet"))


def f11_fuse(spark, d):
    bm = search.bm25(_queries(spark, d), _docs(spark, d)).select("query_id", F.col("doc_id").alias("hit_id"), F.round("score", 6).alias("score"), F.lit("lexical").alias("source"))
    again = bm.where("hit_id % 2 = 0").select("query_id", "hit_id", F.round(F.col("score") / 2 + 3, 6).alias("score"), F.lit("graph").alias("source"))
    return search.fuse(bm.unionByName(again), 5)


def g2_cosine_top(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    df = search.cosine_top(v.where("vec_id < 10"), v)
    return df.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


def g2_cosine_top_hundredth(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    df = search.cosine_top(v.where("vec_id % 100 = 0"), v)
    return df.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


def g5_jaccard(spark, d):
    s = table(spark, d, "part").select("p_partkey", fn.norm_key(F.col("p_name")).alias("a"), fn.norm_key(F.col("p_type")).alias("b"))
    return s.select("p_partkey", F.round(fn.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), F.round(fn.max_overlap(F.col("a"), F.col("b")), 9).alias("g6_overlap"))


def g9_edit_class(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.edit_class(F.col("p_name"), F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "!").otherwise(F.col("p_type")))).alias("edit"), fn.common_prefix(F.col("p_name"), F.col("p_type")).alias("g10_prefix"))


def m1_text_quality(spark, d):
    df = text.text_quality(_docs(spark, d))
    return df.select("doc_id", *[F.round(c, 9).alias(c) for c in ("repeated", "readability", "length_score", "structure")])


QUERIES = {f.__name__: f for f in (b2_content_hash, b8_document_stats, b11_document_complexity, b13_token_estimate, b23_strip_marks, c1_sentences, c2_norm_key, c7_term_frequency, c25_top_keywords, c26_concept_doc_frequency, c27_frequent_terms, f1_build_index, f2_query_tokens, f3_bm25, f4_recent, f5_snippet, f11_fuse, g2_cosine_top, g2_cosine_top_hundredth, g5_jaccard, g9_edit_class, m1_text_quality)}

_KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_WORDS = r"len(regexp_extract_all({0}, '\S+'))"
_SENT = r"list_filter(list_transform(string_split_regex({0}, '[.!?\n]'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"
_T = f"t AS (SELECT doc_id, list_filter(string_split({_KEY.format('text')}, ' '), lambda w: w <> '') AS w FROM documents)"
_TF = f"{_T}, p AS (SELECT doc_id, unnest(w) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL)"
_STOP = "(" + ", ".join(f"'{w}'" for w in fn.STOP_WORDS) + ")"
_KW = f"""{_T}, u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), x AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM u),
e AS (SELECT doc_id, a AS term, 1 AS weight FROM x WHERE length(a) > 2 AND a NOT IN {_STOP} UNION ALL SELECT doc_id, a || ' ' || b, 2 FROM x WHERE b IS NOT NULL AND length(a) > 2 AND length(b) > 2 AND a NOT IN {_STOP} AND b NOT IN {_STOP}),
g AS (SELECT doc_id, term, sum(weight)::bigint AS weight FROM e GROUP BY ALL), kw AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term))::int AS rank, term, weight FROM g)"""
_Q = f"q AS (SELECT item_id AS query_id, array_to_string(list_slice(list_filter(l, lambda x: true), 1, 3), ' ') AS query FROM (SELECT item_id, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1]) AS l FROM (SELECT item_id, list_filter(string_split({_KEY.format('text')}, ' '), lambda w: w <> '') AS w FROM benchmark)))"
_QT = f"{_Q}, qt AS (SELECT query_id, unnest(string_split(query, ' ')) AS term, len(string_split(query, ' ')) AS n_terms FROM q WHERE query <> '')"
_BM = f"""{_TF}, {_QT}, dl AS (SELECT doc_id, len(w) AS dl FROM t), tot AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, n_terms, count(*) AS c, sum(greatest(1e-6::double, ln((n - df + 0.5::double) / (df + 0.5::double))) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / a))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL),
bm AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id))::int AS rank, doc_id, round(score, 6) AS score FROM s WHERE c = n_terms)"""
_FLAT = "trim(replace(text, chr(10), ' '))"
_P = f"p AS (SELECT p_partkey, {_KEY.format('p_name')} AS a, {_KEY.format('p_type')} AS b FROM part), s AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM p), z AS (SELECT *, len(list_intersect(x, y)) AS c FROM s)"
ORACLES = {
    "b2_content_hash": "SELECT doc_id, sha256(trim(split_part(coalesce(text, ''), chr(10), 1)) || '␞' || coalesce(text, '')) AS hash FROM documents",
    "b8_document_stats": f"SELECT doc_id, length(t)::int AS n_chars, {_WORDS.format('t')}::int AS n_words, len({_SENT.format('t')})::int AS n_sentences, len(string_split(t, chr(10)))::int AS n_lines, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) = ''))::int AS n_blank FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "b11_document_complexity": f"""WITH s AS (SELECT doc_id, {_WORDS.format('t')} AS w, len({_SENT.format('t')}) AS s, len(string_split(t, chr(10))) AS b, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) = '')) AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
m AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE w / s::double END AS mean, g / greatest(1, s)::double AS cd, g / greatest(1, b)::double AS sd FROM s), r AS (SELECT *, least(1::double, 0.2::double + mean / 30::double * 0.45::double + sd * 0.25::double + cd * 0.1::double) AS rs, mean / 18::double + sd * 1.75::double + least(0.45::double, w / 300::double) AS sc FROM m)
SELECT doc_id, CASE WHEN sc < 1 THEN 'easy' WHEN sc < 1.8 THEN 'moderate' WHEN sc < 2.6 THEN 'challenging' ELSE 'advanced' END AS difficulty, round(least(1::double, cd), 9) AS concept_density, round(least(1::double, sd), 9) AS structural_density, round(rs, 9) AS reading_score, round(least(1::double, 0.35::double * rs + 0.35::double * least(1::double, cd / 2) + 0.3::double * least(1::double, sd * 2.5::double)), 9) AS complexity, greatest(1, ceil(w / 180::double + g * 0.45::double))::bigint AS study_minutes FROM r""",
    "b13_token_estimate": f"SELECT doc_id, greatest(ceil(length(text) / 4::double), ceil({_WORDS.format('text')} * 1.25::double), 1)::bigint AS tokens, floor({_WORDS.format('text')} * 3 / 4::double)::bigint AS b18_words, greatest(1, floor({_WORDS.format('text')} / 4::double))::bigint AS b18_quarter FROM documents",
    "b23_strip_marks": r"SELECT doc_id, CASE WHEN length(f) > 120 THEN f[:120] || '...' ELSE f END AS fragment FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text || ' [12] x [3]', '\[\d+\]', '', 'g'), '\s+', ' ', 'g')) AS f FROM documents)",
    "c1_sentences": f"SELECT doc_id, len(s)::bigint AS n, list_sum(list_transform(s, lambda x: length(x)))::bigint AS chars, (len(s) - 1)::int AS last_pos FROM (SELECT doc_id, {_SENT.format('text')} AS s FROM documents) WHERE len(s) > 0",
    "c2_norm_key": f"SELECT doc_id, md5({_KEY.format('text')}) AS key FROM documents",
    "c7_term_frequency": f"WITH {_TF} SELECT doc_id, term, tf AS n FROM tf WHERE term NOT IN {_STOP}",
    "c25_top_keywords": f"WITH {_KW} SELECT * FROM kw WHERE rank <= 12",
    "c26_concept_doc_frequency": f"WITH {_KW} SELECT term, count(*) AS n_docs FROM kw WHERE rank <= 12 GROUP BY term",
    "c27_frequent_terms": f"WITH {_TF}, k AS (SELECT doc_id, term, tf AS n, (row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term))::int AS rank FROM tf WHERE term NOT IN {_STOP}) SELECT * FROM k WHERE rank <= 8",
    "f1_build_index": f"WITH {_TF} SELECT * FROM tf",
    "f2_query_tokens": f"WITH {_QT} SELECT query_id, term, n_terms::int AS n_terms FROM qt",
    "f3_bm25": f"WITH {_BM} SELECT * FROM bm WHERE rank <= 10",
    "f4_recent": "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "f5_snippet": f"SELECT doc_id, CASE WHEN f = '' THEN 'Empty result' WHEN h < 0 THEN f[:180] || CASE WHEN length(f) > 180 THEN '...' ELSE '' END ELSE CASE WHEN h > 48 THEN '...' ELSE '' END || substring(f, greatest(0, h - 48) + 1, least(length(f), h + 132) - greatest(0, h - 48)) || CASE WHEN h + 132 < length(f) THEN '...' ELSE '' END END AS snippet FROM (SELECT doc_id, {_FLAT} AS f, instr(lower({_FLAT}), 'that') - 1 AS h FROM documents)",
    "f11_fuse": f"WITH {_BM}, h AS (SELECT query_id, doc_id AS hit_id, score, 'lexical' AS source FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, round(score / 2 + 3, 6), 'graph' FROM bm WHERE rank <= 10 AND doc_id % 2 = 0), g AS (SELECT query_id, hit_id, max(score) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM h GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id))::int AS rank FROM g) SELECT * FROM r WHERE rank <= 5",
    "g2_cosine_top": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (q.norm * v.norm) AS score FROM n q JOIN n v ON q.vec_id <> v.vec_id WHERE q.vec_id < 10), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id))::int AS rank, vec_id, round(score, 9) AS score FROM s) SELECT * FROM r WHERE rank <= 10",
    "g2_cosine_top_hundredth": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (q.norm * v.norm) AS score FROM n q JOIN n v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id))::int AS rank, vec_id, round(score, 9) AS score FROM s) SELECT * FROM r WHERE rank <= 10",
    "g5_jaccard": f"WITH {_P} SELECT p_partkey, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN greatest(0.82::double, c / (len(x) + len(y) - c)::double) ELSE c / (len(x) + len(y) - c)::double END, 9) AS jaccard, round(CASE WHEN a = '' OR b = '' THEN 0 ELSE c / greatest(len(x), len(y))::double END, 9) AS g6_overlap FROM z",
    "g9_edit_class": "WITH p AS (SELECT p_partkey, p_name AS a, p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '!' ELSE p_type END AS b, p_type AS t FROM part) SELECT p_partkey, CASE WHEN trim(a) = trim(b) THEN NULL WHEN levenshtein(trim(a), trim(b)) / greatest(length(trim(a)), length(trim(b)), 1)::double <= 0.25 THEN 'lightlyEdited' ELSE 'heavilyEdited' END AS edit, coalesce(list_max(list_filter(range(1, least(length(a), length(t)) + 1), lambda i: a[:i] = t[:i])), 0)::int AS g10_prefix FROM p",
    "m1_text_quality": f"""WITH s AS (SELECT doc_id, t, {_SENT.format('t')} AS s, string_split(t, chr(10)) AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
x AS (SELECT *, list_distinct(list_transform(s, lambda v: {_KEY.format('v')})) AS k, list_sum(list_transform(s, lambda v: {_WORDS.format('v')})) / len(s)::double AS mean FROM s)
SELECT doc_id, round(CASE WHEN len(s) = 0 THEN 0 ELSE 1 - len(k) / len(s)::double END, 9) AS repeated, round(CASE WHEN len(s) = 0 THEN 0.5 ELSE 1 - least(1::double, abs(mean - 16) / 24::double) END, 9) AS readability, round(1 - least(1::double, abs(length(t) - 600) / 600::double), 9) AS length_score,
round(least(1::double, (len(list_filter(l, lambda v: regexp_matches(trim(v), '^[#*-]'))) + 1) / (len(l) + 1)::double), 9) AS structure FROM x""",
}
