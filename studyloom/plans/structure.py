"""Queries of the structure and table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import structure as op
from studyloom.sources import notes
from studyloom.plans._tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def b3_detect_blocks(spark, d):
    return op.detect_blocks(_docs(spark, d)).select("doc_id", "block_id")


def b5_line_kinds(spark, d):
    return op.lines(_docs(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def b14_section_tokens(spark, d):
    return op.section_tokens(op.split_sections(op.detect_blocks(_docs(spark, d)))).groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum("n_blocks").alias("n_blocks"), F.min("first_line").alias("first_line"))


def a7_overwrite_notes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("note_id"), F.round("c_acctbal", 2).alias("value"))
    new = c.where("value < 0").withColumn("value", F.lit(0.0))
    return notes.overwrite_notes(c, new, new.select("note_id"))


def a12_cascade_delete(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("concept_id"), F.col("o_custkey").alias("note_id"))
    concepts = o.select(F.col("concept_id").alias("id")).distinct()
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("note_id"))
    return notes.cascade_delete({"note_concepts": o, "concepts": concepts}, gone)["concepts"]


def d3_merge_aliases(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_brand").alias("alias"))
    new = table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_type").alias("alias"))
    return notes.merge_aliases(p, new).select("concept_id", F.array_join("aliases", ",").alias("aliases"))


def d4_upsert_concepts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("description"), F.col("p_size").alias("confidence"))
    new = table(spark, d, "part").select((F.col("p_partkey") + 5).alias("concept_id"), F.col("p_type").alias("description"), (F.col("p_size") + 3).alias("confidence"))
    return notes.upsert_concepts(p, new)


def d5_remap_ids(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("concept_id"), F.col("o_orderstatus").alias("kind"))
    m = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") / 2).cast("long").alias("new_id"))
    return notes.remap_ids(o, m, "concept_id")


QUERIES = {f.__name__: f for f in (b3_detect_blocks, b5_line_kinds, b14_section_tokens, a7_overwrite_notes, a12_cascade_delete, d3_merge_aliases, d4_upsert_concepts, d5_remap_ids)}

_CAP = r"regexp_matches({0}, '^\p{{Lu}}')"
_W = r"len(regexp_extract_all({0}, '\S+'))"
_OPS = "len(regexp_extract_all(t, '[=→⇒+−×÷^]'))"
_NUM = r"regexp_extract(t, '^\d+(?:\.\d+)*[.)]?\s+')"
_LINES = rf"""l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), tr AS (SELECT *, trim(line) AS t FROM l),
f AS (SELECT *, starts_with(t, '```') AS fence, sum(starts_with(t, '```')::int) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM tr),
k AS (SELECT doc_id, line_no, CASE WHEN fences % 2 = 1 OR fence THEN 'codeBlock' WHEN t = '' THEN 'blank'
 WHEN starts_with(t, '$') OR starts_with(t, '\[') OR ({_OPS} > 0 AND NOT regexp_matches(t, '[.?!]$') AND ({_W.format('t')} <= 12 OR {_OPS} >= 2)) THEN 'equation'
 WHEN CASE WHEN starts_with(t, '#') THEN trim(regexp_replace(t, '^[# ]+', '')) <> '' WHEN {_NUM} <> '' THEN {_CAP.format(r"trim(regexp_replace(t, '^\d+(?:\.\d+)*[.)]?\s+', ''))")}
  WHEN ends_with(t, ':') AND length(t) <= 80 AND {_CAP.format('t')} THEN true ELSE length(t) <= 72 AND {_CAP.format('t')} AND NOT regexp_matches(t, '\p{{P}}') AND {_W.format('t')} <= 8 END THEN 'heading'
 WHEN starts_with(t, '>') THEN 'quote' WHEN regexp_matches(t, '^[-*+]\s+') THEN 'bulletedList' WHEN regexp_matches(t, '^\d+[.)]\s+') THEN 'numberedList'
 WHEN len(regexp_extract_all(t, '\|')) >= 2 AND len(list_filter(string_split(t, '|'), lambda c: c <> '')) >= 3 THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN fences % 2 = 1 OR fence THEN (fences + 1) // 2 END AS fence_no FROM f)"""
_BLOCKS = f"""{_LINES}, o AS (SELECT *, CASE WHEN kind = 'heading' OR lag(kind) OVER w IS DISTINCT FROM kind OR lag(fence_no) OVER w IS DISTINCT FROM fence_no THEN 1 ELSE 0 END AS opens FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM o), bl AS (SELECT doc_id, block, kind, min(line_no) AS a, max(line_no) AS b FROM g WHERE kind <> 'blank' GROUP BY ALL)"""
ORACLES = {
    "b3_detect_blocks": f"WITH {_BLOCKS} SELECT doc_id, kind || '-' || a || '-' || b AS block_id FROM bl",
    "b5_line_kinds": f"WITH {_LINES} SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL",
    "b14_section_tokens": f"WITH {_BLOCKS}, s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN a END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY a), -1) AS sec FROM bl) SELECT doc_id, count(DISTINCT sec) AS n_sections, count(*) AS n_blocks, min(a)::int AS first_line FROM s GROUP BY doc_id",
    "a7_overwrite_notes": "SELECT c_custkey AS note_id, CASE WHEN round(c_acctbal, 2) < 0 THEN 0 ELSE round(c_acctbal, 2) END::double AS value FROM customer",
    "a12_cascade_delete": "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "d3_merge_aliases": "WITH k AS (SELECT DISTINCT lower(trim(p_brand)) AS k FROM part), n AS (SELECT arg_min(p_partkey, p_partkey) AS id, arg_min(p_type, p_partkey) AS alias FROM part WHERE lower(trim(p_type)) NOT IN (SELECT k FROM k) GROUP BY lower(trim(p_type))), u AS (SELECT p_partkey AS id, p_brand AS alias FROM part UNION SELECT id, alias FROM n) SELECT id AS concept_id, string_agg(alias, ',' ORDER BY alias) AS aliases FROM u GROUP BY id",
    "d4_upsert_concepts": "WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS d, p_size AS c FROM part), n AS (SELECT p_partkey + 5 AS id, p_type AS d, p_size + 3 AS c FROM part) SELECT coalesce(o.id, n.id) AS concept_id, coalesce(nullif(o.d, ''), nullif(n.d, ''), '') AS description, greatest(o.c, n.c) AS confidence FROM o FULL JOIN n ON o.id = n.id",
    "d5_remap_ids": "SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey // 2 ELSE o_custkey END AS concept_id, o_orderstatus AS kind FROM orders",
}
