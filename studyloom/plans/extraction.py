"""Queries of the extraction and canonicalisation operators over whole documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import text as fn
from studyloom.operators import canonical, text
from studyloom.operators import extraction as op
from studyloom.plans._tables import edges, table
from studyloom.plans.text import _KEY, _SENT
from studyloom.sources.store import keep

_PLAIN = ["doc_id", "text"]


def _docs(spark, d):
    return table(spark, d, "documents").select(*_PLAIN)


def _candidates(spark, d):
    return op.candidate_concepts(_docs(spark, d))


def c4_candidate_concepts(spark, d):
    return _candidates(spark, d)


def c5_meaningful_terms(spark, d):
    words = _docs(spark, d).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(op.is_meaningful(F.col("w"))).alias("n_meaningful"))


def c6_topics(spark, d):
    return op.topics(table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("title"), "text"))


def c11_definitions(spark, d):
    c, s = keep(_candidates(spark, d)), text.sentences(_docs(spark, d))
    return op.definitions(c, s, op.aliases(c, s))


def c12_aliases(spark, d):
    df = op.aliases(_candidates(spark, d), text.sentences(_docs(spark, d)))
    return df.select("doc_id", "key", F.array_join("aliases", "|").alias("aliases"))


def c14_evidence(spark, d):
    return op.evidence_in_texts(_docs(spark, d))


def _scored(spark, d):
    c = _candidates(spark, d)
    return c.withColumn("importance", 1.0 / F.col("rank")).withColumn("confidence", (F.length("key") % 10) / 10.0)


def c18_fallback_relationships(spark, d):
    c = keep(_scored(spark, d))
    said = op._named_in(c, text.sentences(_docs(spark, d)))
    at = F.instr(F.concat(F.lit(" "), F.col("sentence_key"), F.lit(" ")), F.concat(F.lit(" "), F.col("key"), F.lit(" ")))
    return op.fallback_relationships(c, c.where("doc_id % 5 = 0"), said.select("doc_id", "pos", "key", at.alias("at")))


def c19_sentence_classes(spark, d):
    return op.classify_sentences(text.sentences(_docs(spark, d)))


def c21_merge_extractions(spark, d):
    """Each sentence as a chunk whose extraction is what its words name."""
    s = text.sentences(_docs(spark, d))
    rows = s.select((F.floor(F.col("doc_id") / 3)).alias("doc_id"), F.col("pos").alias("chunk"), fn.norm_key(F.substring("sentence", 1, 6)).alias("key"), F.substring("sentence", 1, 6).alias("name"), F.col("sentence").alias("definition"), (F.length("sentence") % 10 / 10.0).alias("importance"), (F.col("pos") % 7 / 7.0).alias("confidence"), F.array(F.substring("sentence", 7, 2), F.substring("sentence", 9, 1)).alias("aliases"))
    df = op.merge_extractions(rows)
    return df.select("doc_id", "key", "name", F.md5("definition").alias("definition"), F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence"), F.array_join("aliases", "|").alias("aliases"), "n_chunks")


def c22_document_scores(spark, d):
    df = op.document_scores(_scored(spark, d), _docs(spark, d))
    return df.select("doc_id", F.round("confidence", 9).alias("confidence"), F.round("importance", 9).alias("importance"), "difficulty")


def c23_extraction_quality(spark, d):
    s = table(spark, d, "part")
    c = s.select(F.floor(F.col("p_partkey") / 30).alias("doc_id"), F.element_at(F.split("p_name", " "), 1).alias("key"), (F.col("p_size") / 50).alias("confidence"))
    e = edges(spark, d).select(F.floor(F.col("source_id") / 30).alias("doc_id"), "relation")
    df = op.extraction_quality(c, e)
    return df.select("doc_id", "n_concepts", "n_duplicates", "least", F.round("mean", 9).alias("mean"), "most", F.round("coverage", 9).alias("coverage"), "n_edges", "kinds")


def c24_noise_terms(spark, d):
    return op.noise_terms(_docs(spark, d))


def d1_resolve_concepts(spark, d):
    g = F.floor(F.col("p_partkey") / 40).cast("string")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.concat_ws(" ", "p_name", g).alias("name"), F.col("p_type").alias("definition"), (F.col("p_size") / 50).alias("confidence"), (F.col("p_size") % 7 / 7.0).alias("importance"), F.array(F.concat_ws(" ", F.col("p_brand"), g)).alias("aliases"))
    df = canonical.resolve_concepts(p)
    return df.select("canonical_id", "name", "definition", "confidence", F.round("importance", 9).alias("importance"), F.array_join("aliases", "|").alias("aliases"), "n_merged")


def d2_canonicalize(spark, d):
    """Known: every fourth part's name, and that with -3. New: names, the same in other spelling, with a number, and cut to one slug."""
    p = table(spark, d, "part")
    none = F.expr("cast(array() as array<string>)")
    known = p.where("p_partkey % 4 = 0").groupBy("p_name").agg(F.min_by("p_type", "p_partkey").alias("t"))
    one = known.select(canonical.slug(F.col("p_name")).alias("canonical_id"), F.concat(F.lit("known "), F.col("p_name")).alias("name"), F.array("t").alias("aliases"))
    two = known.select(F.concat(canonical.slug(F.col("p_name")), F.lit("-3")).alias("canonical_id"), F.concat(F.lit("third "), F.col("p_name")).alias("name"), none.alias("aliases"))
    at = F.col("p_partkey") % 7
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Known "), F.col("p_name"))).when(at == 0, F.concat("p_name", F.lit(" 2"))).when(at == 1, F.upper(F.concat("p_name", F.lit("!"))))
    name = name.when(at == 2, F.concat(F.repeat(F.concat("p_name", F.lit(" ")), F.lit(8)), F.col("p_size").cast("string"))).when(at == 3, "!!!").otherwise(F.concat("p_name", F.lit(" "), (F.col("p_size") % 4).cast("string")))
    new = p.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("concept_id"), name.alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.array("p_type")).otherwise(none).alias("aliases"))
    return canonical.canonicalize(new, one.unionByName(two))


_RELATIONS = ("Requires", "part_of", "foo", " causes", "versus", "related-to", "depends_on", "example of", "uses", "PREREQUISITE_OF")


def d7_map_relation(spark, d):
    r = F.element_at(F.array(*map(F.lit, _RELATIONS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", canonical.map_relation(r).alias("type"), canonical.map_relation(r, "kind").alias("kind"))


def _extracted(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.floor(F.col("p_partkey") / 10).alias("doc_id"), F.floor(F.col("p_partkey") / F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1)).cast("string").alias("key"), F.when(F.col("p_partkey") % 6 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_type")).alias("definition"), (F.col("p_size") / 45).alias("confidence"), (F.col("p_size") / 40 - 0.1).alias("importance"))
    r = F.element_at(F.array(*map(F.lit, _RELATIONS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    e = p.select(F.floor(F.col("p_partkey") / 10).alias("doc_id"), F.col("p_partkey").cast("string").alias("source"), (F.col("p_partkey") + F.col("p_size") % 3).cast("string").alias("target"), r.alias("relation"))
    return c, e.unionByName(e.where("source % 8 = 0"))


def d8_sanitize_rejects(spark, d):
    good, kept, rejects = canonical.sanitize_extraction(*_extracted(spark, d))
    left = kept.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("kept edges").alias("reason"), "n")
    return rejects.unionByName(left).unionByName(good.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("kept concepts").alias("reason"), "n"))


def d9_validate_extraction(spark, d):
    return canonical.validate_extraction(*_extracted(spark, d))


def d11_normalize_extraction(spark, d):
    c, _ = _extracted(spark, d)
    df = canonical.normalize_extraction(c.withColumn("name", F.concat(F.lit("  "), F.col("name"))), op.is_meaningful)
    return df.select("doc_id", "key", "name", "definition", F.round("importance", 9).alias("importance"), F.round("confidence", 9).alias("confidence"), "concept_id")


def d13_ids(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", canonical.fact_id(F.concat_ws(", ", "p_name", "p_type", "p_brand")).alias("fact_id"), canonical.relation_id(canonical.slug(F.col("p_name")), canonical.slug(F.col("p_brand")), F.col("p_type")).alias("relation_id"))


QUERIES = {f.__name__: f for f in (c4_candidate_concepts, c5_meaningful_terms, c6_topics, c11_definitions, c12_aliases, c14_evidence, c18_fallback_relationships, c19_sentence_classes, c21_merge_extractions, c22_document_scores, c23_extraction_quality, c24_noise_terms, d1_resolve_concepts, d2_canonicalize, d7_map_relation, d8_sanitize_rejects, d9_validate_extraction, d11_normalize_extraction, d13_ids)}


def _words(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + ")"


def _meaningful(x: str) -> str:
    t, k = f"trim({x})", _KEY.format(x)
    one = f"(length({k}) > 2 AND {k} NOT IN {_words(op.NOISE)} AND (({t} = upper({t}) AND length({t}) <= 6) OR regexp_matches({t}, '[\\p{{N}}+-]') OR (length({t}) >= 4 AND {k} NOT IN {_words(op.GENERIC)})))"
    many = f"(len(string_split({k}, ' ')) <= {op.LONGEST} AND len(list_filter(string_split({k}, ' '), lambda iw: iw NOT IN {_words(op.NOISE + op.GENERIC)} AND NOT regexp_matches(iw, '^\\p{{N}}+$'))) > 0)"
    return f"({k} <> '' AND {k} NOT IN {_words(op.NOISE)} AND CASE WHEN len(string_split({k}, ' ')) = 1 THEN {one} ELSE {many} END)"


def _any(x: str, cues) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, c.replace("'", "''")) for c in cues) + ")"


def _frag(x: str) -> str:
    return f"CASE WHEN length({x}) > 120 THEN substr({x}, 1, 120) || '...' ELSE {x} END"


_S = f"s AS (SELECT doc_id, unnest(range(len(x)))::int AS pos, unnest(x) AS sentence FROM (SELECT doc_id, {_SENT.format('text')} AS x FROM documents))"
_VERBS = "[" + ", ".join(f"' {v} '" for v in op.HEAD_VERBS) + "]"
_BARE = "list_transform(string_split(sentence, ' '), lambda w: regexp_replace(w, '^\\p{P}+|\\p{P}+$', '', 'g'))"
_RUNS = f"list_filter(list_transform(string_split(array_to_string(list_transform({_BARE}, lambda w: CASE WHEN regexp_matches(w, '^\\p{{Lu}}') OR contains(w, '-') OR contains(w, '+') THEN w ELSE chr(1) END), ' '), chr(1)), lambda r: trim(r)), lambda r: length(r) > 2 AND (contains(r, ' ') OR (r = upper(r) AND len(regexp_extract_all(r, '\\p{{L}}')) >= 2 AND length(r) <= 8)))"
_HEADS = f"list_filter(list_transform({_VERBS}, lambda v: CASE WHEN strpos(lower(sentence), v) > 1 THEN trim(substr(sentence, 1, strpos(lower(sentence), v) - 1)) END), lambda h: h IS NOT NULL AND h <> '')"
_ISHEAD = "(trim(l) <> '' AND length(trim(l)) <= 90 AND (regexp_matches(trim(l), '^[#*-]') OR (NOT regexp_matches(trim(l), '[.!?]') AND len(list_filter(string_split(trim(l), ' '), lambda w: w <> '')) <= 8 AND regexp_matches(trim(l), '^\\p{Lu}'))))"
_HL = f"hl AS (SELECT doc_id, unnest(range(len(x)))::int AS nth, unnest(x) AS term FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: {_ISHEAD}) AS x FROM documents WHERE text IS NOT NULL))"


def _cand(limit: int) -> str:
    return f"""{_S}, {_HL}, c0 AS (SELECT doc_id, pos, CASE WHEN contains(sentence, ':') THEN [string_split(sentence, ':')[1]] ELSE [] END || {_HEADS} || {_RUNS} || CASE WHEN {_any('sentence', op.CLASSES['formula'][0])} THEN [sentence] ELSE [] END AS x FROM s WHERE contains(sentence, ' ')),
c1 AS (SELECT doc_id, 0 AS h, pos, unnest(range(len(x)))::int AS nth, unnest(x) AS term FROM c0 UNION ALL SELECT doc_id, 1, 0, nth, term FROM hl), c2 AS (SELECT doc_id, {_KEY.format('term')} AS key, min((h, pos, nth, trim(term))) AS f FROM c1 WHERE {_meaningful('term')} GROUP BY ALL),
cand AS (SELECT * FROM (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY f[1], f[2], f[3], key))::int AS rank, key, f[4] AS term FROM c2 WHERE key <> '') WHERE rank <= {limit})"""


_SAID = f"sk AS (SELECT *, {_KEY.format('sentence')} AS sentence_key FROM s), said AS (SELECT c.doc_id, c.key, c.term, c.rank, pos, sentence, sentence_key FROM cand c JOIN sk ON sk.doc_id = c.doc_id AND contains(' ' || sentence_key || ' ', ' ' || key || ' '))"
_TRIG = "[" + ", ".join(f"' {v} '" for v in op.DEFINITION_TRIGGERS) + "]"
_HK = _KEY.format("substr(sentence, 1, strpos(lower(sentence), t) - 1)")
_FITS = f"strpos(lower(sentence), t) > 0 AND (starts_with({_HK}, name) OR ({_HK} <> '' AND starts_with(name, {_HK})))"
_DULL = _words(op.NOISE + op.GENERIC)
_LIMITS = "CASE class " + " ".join(f"WHEN '{n}' THEN {m}" for n, (_, m) in op.CLASSES.items() if m) + " ELSE 1000000 END"
_RELS = "[" + ", ".join(f"'{r}'" for r in _RELATIONS) + "][p_partkey % 10 + 1]"
_SLUG = "substr(replace(" + _KEY + ", ' ', '-'), 1, 48)"


def _case(x: str, table_: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN {_words(v)} THEN '{k}'" for k, v in table_.items()) + f" ELSE {other} END"


_TYPE = _case("translate(lower(trim(r)), '_-', '  ')", canonical.TYPES, f"CASE WHEN upper(trim(r)) IN {_words(canonical.TYPE_NAMES)} THEN upper(trim(r)) END")
_EXT = f"""c AS (SELECT p_partkey // 10 AS doc_id, (p_partkey // CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END)::varchar AS key, CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_type END AS definition, p_size / 45::double AS confidence, p_size / 40::double - 0.1::double AS importance FROM part),
e0 AS (SELECT p_partkey, p_partkey // 10 AS doc_id, p_partkey::varchar AS source, (p_partkey + p_size % 3)::varchar AS target, {_RELS} AS r FROM part), e AS (SELECT * FROM e0 UNION ALL SELECT * FROM e0 WHERE p_partkey % 8 = 0)"""
_ALIASES = f"""aw AS (SELECT doc_id, key, list_filter(string_split(term, ' '), lambda z: z <> '') AS w, list_filter(string_split(trim(regexp_replace(term, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda z: z <> '' AND lower(z) NOT IN {_DULL}) AS a FROM cand),
ao AS (SELECT doc_id, key, unnest([array_to_string(w, '-'), array_to_string(w, '_'), CASE WHEN len(a) > 1 THEN upper(array_to_string(list_transform(a, lambda z: substr(z, 1, 1)), '')) ELSE '' END]) AS alias FROM aw WHERE len(w) > 1 UNION ALL SELECT doc_id, key, unnest(list_transform(regexp_extract_all(sentence, '\\(([^()]{{1,40}})\\)', 1), lambda z: trim(z))) FROM said UNION ALL SELECT doc_id, key, unnest(list_filter(list_transform(string_split(sentence, '/'), lambda z: trim(z)), lambda z: z <> '' AND {_meaningful('z')})) FROM said WHERE contains(sentence, '/')),
au AS (SELECT doc_id, key, {_KEY.format('alias')} AS k, min(alias) AS alias FROM ao WHERE trim(alias) <> '' GROUP BY ALL),
al AS (SELECT DISTINCT doc_id, key, k, alias FROM au WHERE k <> '' AND k <> key)"""
_NAMED = "nm AS (SELECT doc_id, key, term, key AS name FROM cand UNION SELECT c.doc_id, c.key, c.term, al.k FROM cand c JOIN al ON al.doc_id = c.doc_id AND al.key = c.key), named AS (SELECT c.doc_id, c.key, c.term, c.name, pos, sentence, sentence_key FROM nm c JOIN sk ON sk.doc_id = c.doc_id AND contains(' ' || sentence_key || ' ', ' ' || name || ' '))"
ORACLES = {
    "c4_candidate_concepts": f"WITH {_cand(18)} SELECT doc_id, rank, key, term FROM cand",
    "c5_meaningful_terms": f"WITH w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents) SELECT doc_id, count(*) AS n, count(*) FILTER ({_meaningful('w')}) AS n_meaningful FROM w GROUP BY doc_id",
    "c6_topics": f"WITH {_cand(5)}, t0 AS (SELECT doc_id, 0 AS k, 0 AS nth, source || ' ' || lang AS term FROM documents UNION ALL SELECT doc_id, 1, nth, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS n FROM hl WHERE {_meaningful('term')}) WHERE n <= 6 UNION ALL SELECT doc_id, 2, rank, term FROM cand), t1 AS (SELECT doc_id, {_KEY.format('term')} AS key, min((k, nth, trim(term))) AS f FROM t0 WHERE {_meaningful('term')} GROUP BY ALL) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY f[1], f[2], key))::int AS rank, f[3] AS topic FROM t1 WHERE key <> ''",
    "c11_definitions": f"WITH {_cand(18)}, {_SAID}, {_ALIASES}, {_NAMED}, h AS (SELECT *, list_filter(list_transform({_TRIG}, lambda t, i: CASE WHEN {_FITS} THEN {{'i': i, 't': {_frag('trim(substr(sentence, strpos(lower(sentence), t) + length(t)))')}}} END), lambda z: z IS NOT NULL)[1] AS hit FROM named), b AS (SELECT doc_id, key, min((hit IS NULL, pos, hit.i, coalesce(hit.t, {_frag('sentence')}))) AS b FROM h GROUP BY ALL) SELECT c.doc_id, c.key, coalesce(b[4], c.term) AS definition, coalesce(NOT b[1], false) AS explicit FROM cand c LEFT JOIN b ON b.doc_id = c.doc_id AND b.key = c.key",
    "c12_aliases": f"WITH {_cand(18)}, {_SAID}, {_ALIASES} SELECT doc_id, key, string_agg(alias, '|' ORDER BY alias) AS aliases FROM al GROUP BY ALL",
    "c14_evidence": f"WITH {_cand(18)}, {_SAID}, {_ALIASES}, {_NAMED}, d AS (SELECT DISTINCT doc_id, key, pos FROM named), r AS (SELECT doc_id, key, (row_number() OVER (PARTITION BY doc_id, key ORDER BY pos))::int AS nth, pos FROM d) SELECT * FROM r WHERE nth <= 2 UNION ALL SELECT doc_id, key, 1, NULL FROM cand c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = c.doc_id AND d.key = c.key)",
    "c18_fallback_relationships": f"WITH {_cand(18)}, {_SAID}, m AS (SELECT doc_id, pos, key, row_number() OVER (PARTITION BY doc_id, pos ORDER BY strpos(' ' || sentence_key || ' ', ' ' || key || ' '), key) AS n FROM said WHERE doc_id % 5 <> 0), p AS (SELECT DISTINCT doc_id, source, target FROM (SELECT doc_id, pos, max(key) FILTER (n = 1) AS source, max(key) FILTER (n = 2) AS target FROM m GROUP BY ALL) WHERE target IS NOT NULL), t AS (SELECT doc_id, max(key) FILTER (rank = 1) AS source, max(key) FILTER (rank = 2) AS target FROM cand WHERE doc_id % 5 <> 0 AND doc_id NOT IN (SELECT doc_id FROM p) GROUP BY doc_id) SELECT doc_id, source, target, 0.45::double AS confidence FROM p UNION ALL SELECT doc_id, source, target, 0.35::double FROM t WHERE target IS NOT NULL",
    "c19_sentence_classes": f"WITH {_S}, x AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, sentence, '{n}' AS class FROM s WHERE {_any('lower(sentence)', cues)}" for n, (cues, _) in op.CLASSES.items()) + f"), r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, class ORDER BY pos))::int AS nth FROM x) SELECT doc_id, class, nth, pos, CASE WHEN class = 'action' THEN CASE WHEN contains(lower(sentence), 'must') OR contains(lower(sentence), 'important') THEN 'high' ELSE 'medium' END END AS priority FROM r WHERE nth <= {_LIMITS}",
    "c21_merge_extractions": f"WITH {_S}, r AS (SELECT doc_id // 3 AS doc_id, pos, {_KEY.format('substr(sentence, 1, 6)')} AS key, substr(sentence, 1, 6) AS name, sentence, length(sentence) % 10 / 10::double AS i, pos % 7 / 7::double AS c FROM s), a AS (SELECT doc_id, key, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM (SELECT doc_id, key, unnest([substr(sentence, 7, 2), substr(sentence, 9, 1)]) AS a FROM r) GROUP BY ALL), m AS (SELECT doc_id, key, arg_min(name, (pos, name)) AS name, md5(arg_max(sentence, (length(sentence), sentence))) AS definition, round(max(i), 6) AS importance, round(max(c), 6) AS confidence, count(*) AS n_chunks FROM r GROUP BY ALL) SELECT * FROM m JOIN a USING (doc_id, key)",
    "c22_document_scores": f"WITH {_cand(18)}, m AS (SELECT doc_id, avg(length(key) % 10 / 10::double) AS c, avg(1 / rank::double) AS i, count(*) AS n FROM cand GROUP BY doc_id), t AS (SELECT doc_id, greatest(1, len(regexp_extract_all(coalesce(text, ''), '\\S+')) // 4) AS t FROM documents) SELECT t.doc_id, round(coalesce(c, 0.5), 9) AS confidence, round(coalesce(i, 0.5), 9) AS importance, CASE WHEN t < 120 THEN 'intro' WHEN t < 450 AND coalesce(n, 0) < 10 THEN 'intermediate' ELSE 'advanced' END AS difficulty FROM t LEFT JOIN m ON m.doc_id = t.doc_id",
    "c23_extraction_quality": "WITH c AS (SELECT p_partkey // 30 AS doc_id, split_part(p_name, ' ', 1) AS key, p_size / 50::double AS x FROM part), q AS (SELECT doc_id, count(*) AS n_concepts, count(*) - count(DISTINCT key) AS n_duplicates, min(x) AS least, round(avg(x), 9) AS mean, max(x) AS most, round(avg((x >= 0.5)::int), 9) AS coverage FROM c GROUP BY doc_id), k AS (SELECT p_partkey // 30 AS doc_id, count(*) FILTER (p_partkey >= 3) AS a, count(*) FILTER (p_partkey >= 2) AS b FROM part GROUP BY 1) SELECT q.*, a + b AS n_edges, concat_ws(',', CASE WHEN a > 0 THEN 'PART_OF:' || a END, CASE WHEN b > 0 THEN 'REQUIRES:' || b END) AS kinds FROM q JOIN k ON k.doc_id = q.doc_id",
    "c24_noise_terms": f"SELECT DISTINCT doc_id, w AS term FROM (SELECT doc_id, unnest(string_split({_KEY.format('text')}, ' ')) AS w FROM documents) WHERE w IN {_DULL}",
    "d1_resolve_concepts": f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name || ' ' || (p_partkey // 40) AS name, p_type AS d, p_size / 50::double AS c, p_size % 7 / 7::double AS i, p_brand || ' ' || (p_partkey // 40) AS a FROM part), k AS (SELECT id, {_KEY.format('name')} AS k FROM p UNION SELECT id, {_KEY.format('a')} FROM p),
r AS (SELECT id, id AS x FROM p UNION SELECT r.id, k2.id FROM r JOIN k k1 ON k1.id = r.x JOIN k k2 ON k2.k = k1.k), m AS (SELECT id, min(x) AS canonical_id FROM r GROUP BY id)
SELECT canonical_id, arg_min(name, p.id) AS name, arg_max(d, (length(d), d)) AS definition, max(c) AS confidence, round(max(i), 9) AS importance, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases, count(*) AS n_merged FROM p JOIN m ON m.id = p.id GROUP BY canonical_id""",
    "d2_canonicalize": f"""WITH k0 AS (SELECT {_SLUG.format('p_name')} AS s, {_KEY.format('p_name')} AS nk, {_KEY.format('arg_min(p_type, p_partkey)')} AS ak FROM part WHERE p_partkey % 4 = 0 GROUP BY p_name),
kn AS (SELECT s AS cid, 0 AS r, ak AS k FROM k0 UNION ALL SELECT s, 1, 'known ' || nk FROM k0 UNION ALL SELECT s || '-3', 1, 'third ' || nk FROM k0), tk AS (SELECT DISTINCT cid FROM kn),
n0 AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'Known ' || p_name WHEN p_partkey % 7 = 0 THEN p_name || ' 2' WHEN p_partkey % 7 = 1 THEN upper(p_name || '!') WHEN p_partkey % 7 = 2 THEN repeat(p_name || ' ', 8) || p_size WHEN p_partkey % 7 = 3 THEN '!!!' ELSE p_name || ' ' || p_size % 4 END AS name, CASE WHEN p_partkey % 3 = 0 THEN {_KEY.format('p_type')} END AS ak FROM part WHERE p_partkey % 4 > 0),
nw AS (SELECT *, {_KEY.format('name')} AS k, coalesce(nullif({_SLUG.format('name')}, ''), 'concept') AS s FROM n0), q AS (SELECT id, ak AS k FROM nw WHERE ak IS NOT NULL UNION SELECT id, k FROM nw WHERE k <> ''), h AS (SELECT id, min((r, cid)) AS h FROM q JOIN kn ON kn.k = q.k GROUP BY id),
f AS (SELECT k, arg_min(s, id) AS s, min(id) AS id FROM nw WHERE id NOT IN (SELECT id FROM h) GROUP BY k), hd AS (SELECT s, min(id) AS id FROM f WHERE s NOT IN (SELECT cid FROM tk) GROUP BY s),
u AS (SELECT regexp_extract(x, '^(.*)-([1-9][0-9]*)$', 1) AS s, list(DISTINCT regexp_extract(x, '^(.*)-([1-9][0-9]*)$', 2)::int) AS ns FROM (SELECT cid AS x FROM tk UNION SELECT s FROM hd) WHERE regexp_matches(x, '-[1-9][0-9]*$') GROUP BY 1),
rs AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id) AS n FROM f WHERE (s, id) NOT IN (SELECT (s, id) FROM hd)),
m AS (SELECT rs.k, rs.s || '-' || list_filter(range(2, 10000), lambda i: NOT list_contains(coalesce(u.ns, []), i::int))[rs.n] AS cid FROM rs LEFT JOIN u ON u.s = rs.s UNION ALL SELECT f.k, f.s FROM f JOIN hd ON hd.id = f.id)
SELECT id AS concept_id, h[2] AS canonical_id, false AS is_new FROM h UNION ALL SELECT nw.id, m.cid, true FROM nw JOIN m ON m.k = nw.k WHERE nw.id NOT IN (SELECT id FROM h)""",
    "d7_map_relation": f"WITH x AS (SELECT p_partkey, {_RELS} AS r FROM part) SELECT p_partkey, {_TYPE} AS type, {_case('lower(trim(r))', canonical.KINDS, chr(39) + 'relatedTo' + chr(39))} AS kind FROM x",
    "d8_sanitize_rejects": f"WITH {_EXT}, g AS (SELECT * FROM c WHERE trim(name) <> ''), i AS (SELECT DISTINCT doc_id, key FROM g), j AS (SELECT e.doc_id, CASE WHEN source = target THEN 'self loop' WHEN NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = e.doc_id AND i.key = e.source) OR NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = e.doc_id AND i.key = e.target) THEN 'dangling' WHEN {_TYPE} IS NULL THEN 'unsupported relation' ELSE 'kept edges' END AS reason FROM e UNION ALL SELECT doc_id, CASE WHEN trim(name) = '' THEN 'empty name' ELSE 'kept concepts' END FROM c) SELECT doc_id, reason, count(*) AS n FROM j GROUP BY ALL",
    "d9_validate_extraction": f"WITH {_EXT}, a AS (SELECT doc_id, 'duplicate concept' AS rule FROM c GROUP BY doc_id, key HAVING count(*) > 1 UNION ALL SELECT doc_id, 'duplicate relation' FROM e GROUP BY doc_id, source, target, r HAVING count(*) > 1 UNION ALL SELECT doc_id, 'empty definition' FROM c WHERE trim(definition) = '' UNION ALL SELECT doc_id, 'confidence out of range' FROM c WHERE confidence NOT BETWEEN 0 AND 1 UNION ALL SELECT x.doc_id, 'invalid reference' FROM (SELECT doc_id, unnest(list_distinct([source, target])) AS k FROM e) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND c.key = x.k)) SELECT doc_id, rule, count(*) AS n FROM a GROUP BY ALL",
    "d11_normalize_extraction": f"WITH {_EXT}, n AS (SELECT doc_id, trim(regexp_replace('  ' || name, '\\s+', ' ', 'g')) AS name, trim(definition) AS definition, greatest(0::double, least(1::double, importance)) AS importance, greatest(0::double, least(1::double, confidence)) AS confidence FROM c), b AS (SELECT doc_id, {_KEY.format('name')} AS key, max((importance, confidence, name, definition)) AS b FROM n WHERE {_meaningful('name')} GROUP BY ALL) SELECT doc_id, key, b[3] AS name, b[4] AS definition, round(b[1], 9) AS importance, round(b[2], 9) AS confidence, {_SLUG.format('b[3]')} AS concept_id FROM b",
    "d13_ids": f"SELECT p_partkey, 'fact-' || {_SLUG.format('''p_name || ', ' || p_type || ', ' || p_brand''')} AS fact_id, 'rel-' || {_SLUG.format('p_name')} || '-' || {_SLUG.format('p_brand')} || '-' || lower(p_type) AS relation_id FROM part",
}
