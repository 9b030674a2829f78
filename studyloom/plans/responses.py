"""Queries of generated text, line repair and semantic chunks. What is parsed is made of the parts' names in the forms that it can have."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import chunks, repair, responses
from studyloom.plans._tables import table
from studyloom.plans.structure import _LINES

_LIMIT = 400


def _cards_text(spark, d):
    p = table(spark, d, "part")
    card = lambda kind, back, end: F.format_string(f'{{"type": "{kind}", "front": "%s", "back": "%s"{end}}}', "p_name", back)
    at = F.col("p_partkey") % 6
    plain = F.concat(F.lit("["), card("definition", F.col("p_type"), ', "whyItMatters": "w"'), F.lit(", "), card("cloze", F.col("p_brand"), ""), F.lit("]"))
    fenced = F.concat(F.lit('Sure: "quoted" text\n```json\n{"flashcards": ['), card("concept", F.col("p_type"), ""), F.lit('], "quizQuestions": []}\n```\nDone.'))
    loose = F.concat(F.lit("Here you are\n[ "), card("cloze", F.concat(F.lit("{"), "p_type", F.lit(r"} \"]\" ")), " , "), F.lit(" ,\n] and so on }"))
    blocks = F.concat(F.lit("Type: Definition card\r\nFront: "), "p_name", F.lit("\nBACK :  a: "), "p_type", F.lit("\nWhy: "), "p_brand", F.lit("\n---\nFront: only this\n---\nfront: second\nback: "), "p_brand")
    section = F.concat(F.lit("## Flashcards:\nnone of these { \n\nFront: "), "p_name", F.lit("\nBack: "), "p_type", F.lit("\n\nnothing: here"))
    return p.select(F.col("p_partkey").alias("id"), F.when(at == 0, plain).when(at == 1, fenced).when(at == 2, loose).when(at == 3, blocks).when(at == 4, section).otherwise(F.concat(F.lit("no cards: { "), "p_name")).alias("text"))


def k10_parse_cards(spark, d):
    return responses.item_rows(responses.parse_items(_cards_text(spark, d), "cards")).select("id", "nth", "type", "front", "back", F.coalesce("whyItMatters", F.lit("")).alias("why"))


def k10_parse_quiz(spark, d):
    at = F.col("p_partkey") % 5
    answer = F.when(at == 0, "b) that one").when(at == 1, F.col("p_brand")).when(at == 2, "It is TRUE.").when(at == 3, F.upper(F.regexp_replace("p_type", " ", "-"))).otherwise("")
    kind = F.when(at == 2, "True or false").when(at == 1, "short").otherwise("Multiple choice")
    options = F.when(at == 2, "").otherwise(F.concat(F.lit("OptionA: 1 "), "p_type", F.lit("\nOptionB: "), "p_brand", F.lit("\nOptionC:\nOptionD: "), "p_type", F.lit("\n")))
    text = F.concat(F.lit("Type: "), kind, F.lit("\nPrompt: What is "), "p_name", F.lit("?\n"), options, F.lit("Answer: "), answer, F.lit("\nExplanation: x: y\nKeywords: a, "), "p_brand", F.lit(" ,,b"))
    df = table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    rows = responses.item_rows(responses.parse_items(df, "quiz"))
    return rows.select("id", "type", "prompt", F.array_join("options", "|").alias("options"), F.col("correctAnswer").alias("answer"), "explanation", F.array_join("keywords", "|").alias("keywords"))


def k10_parse_insights(spark, d):
    at = F.col("p_partkey") % 3
    listed = F.concat(F.lit("## Key Concepts\n- "), "p_name", F.lit("\nnot this\n-   "), "p_brand", F.lit("\n- \n> Knowledge gaps:\n- "), "p_type", F.lit("\nOther:\n- no"))
    json = F.concat(F.lit('{"insights": {"keyConcepts": ["'), "p_name", F.lit('",], "knowledgeGaps": ["'), "p_type", F.lit('"]}}'))
    df = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(at == 0, listed).when(at == 1, json).otherwise("nothing").alias("text"))
    out = responses.parse_insights(df)
    return out.select("id", "failed", F.array_join("keyConcepts", "|").alias("key_concepts"), F.array_join("knowledgeGaps", "|").alias("gaps"), (F.size("importantConcepts") + F.size("potentialExamTopics")).alias("others"))


def k11_repair_json(spark, d):
    at = F.col("p_partkey") % 5
    body = F.concat(F.lit('"name": "'), "p_name", F.lit('", "marks": "},] \\" {", "sizes": ['), F.col("p_size").cast("string"), F.lit(" , ]"))
    text = F.when(at == 0, F.concat(F.lit("```json\n{"), body, F.lit("}\n```"))).when(at == 1, F.concat(F.lit("Well, {"), body, F.lit(",\n} or [1]"))).when(at == 2, F.concat(F.lit("{\x00"), body, F.lit("}}"))).when(at == 3, F.concat(F.lit("{"), body)).otherwise("no brackets")
    df = responses.repaired(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")))
    return df.select("id", "failed", *[F.get_json_object("json", f"$.{x}").alias(x) for x in ("name", "marks", "sizes")])


def b17_semantic_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return chunks.semantic_chunks(docs, _LIMIT).select("doc_id", "chunk", "section_line", "first_line", "last_line", F.md5("content").alias("content"))


def b21_reflow(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(repair.reflow("text")).alias("text"))


def b22_clean_generated(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(repair.clean_generated("text")).alias("text"))


QUERIES = {f.__name__: f for f in (k10_parse_cards, k10_parse_quiz, k10_parse_insights, k11_repair_json, b17_semantic_chunks, b21_reflow, b22_clean_generated)}

_TYPE = "CASE " + " ".join(f"WHEN h = '{k}' THEN '{v}'" for k, v in repair.HEADINGS.items()) + " END"
_ARTIFACT = " OR ".join(f"contains(lower(x.x), '{a}')" for a in repair.ARTIFACTS)
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_W = r"len(regexp_extract_all({0}, '\S+'))"
_BUDGET = max(chunks.LEAST, int(_LIMIT * chunks.FILL))


def _pack(name: str, source: str, key: str, share: float, cut: bool) -> str:
    """Ranges of consecutive items (toks, a list by key) within the budget, by the same rule; the first is 1."""
    over = f"held + toks[i + 1] > {_BUDGET} AND start <= i"
    s2 = f"CASE WHEN {over} THEN greatest(start, i + 1 - keep) ELSE start END"
    long = f"toks[i + 1] > {_BUDGET}" if cut else "false"
    return f"""{name}0 AS MATERIALIZED (SELECT {key}, toks, len(toks) AS n, greatest(1, ceil(len(toks) * {share}))::bigint AS keep FROM {source}),
{name}1 AS (SELECT {key}, toks, n, keep, 0::bigint AS i, 1::bigint AS start, 0::hugeint AS held, false AS over, 0::bigint AS os, 0::bigint AS s2, false AS cut FROM {name}0
  UNION ALL SELECT {key}, toks, n, keep, i + 1, CASE WHEN {long} THEN i + 2 ELSE {s2} END,
    CASE WHEN {long} THEN 0 ELSE toks[i + 1] + CASE WHEN {over} THEN coalesce(list_sum(list_slice(toks, greatest(start, i + 1 - keep), i)), 0) ELSE held END END, {over}, start, {s2}, {long}
  FROM {name}1 WHERE i < n),
{name} AS (SELECT {key}, i AS nth, 1 AS o, os AS a, i - 1 AS b, false AS cut FROM {name}1 WHERE over
  UNION ALL SELECT {key}, i, 2, s2, i - 1, false FROM {name}1 WHERE cut AND s2 < i UNION ALL SELECT {key}, i, 3, i, i, true FROM {name}1 WHERE cut
  UNION ALL SELECT {key}, n, 4, start, n, false FROM {name}1 WHERE i = n AND start <= n)"""


_CHUNKS = rf"""WITH RECURSIVE {_LINES},
a AS (SELECT k.doc_id, k.line_no, k.kind, f.t FROM k JOIN f USING (doc_id, line_no)),
s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN line_no END IGNORE NULLS) OVER d, -1) AS sec,
  (kind = 'heading' OR t = '' OR (regexp_matches(t, '^\p{{Lu}}[^:]*:') AND length(t) < 80) OR coalesce(lag(t = '' OR kind = 'heading') OVER d, true))::int AS opens FROM a WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM s),
p AS (SELECT doc_id, sec, run, min(line_no) AS first_line, max(line_no) AS last_line, list(t ORDER BY line_no) AS ls FROM r WHERE kind <> 'heading' AND t <> '' GROUP BY ALL),
q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY first_line) AS i, {_W.format("array_to_string(ls, ' ')")} AS w FROM p),
v AS MATERIALIZED (SELECT doc_id, sec, list(greatest(1, w * 3 // 4) ORDER BY i) AS toks, greatest(1, sum(w) * 3 // 4) AS alltoks, list(array_to_string(ls, chr(10)) ORDER BY i) AS texts, list(first_line ORDER BY i) AS firsts, list(last_line ORDER BY i) AS lasts FROM q GROUP BY ALL),
big AS (SELECT doc_id, sec, toks FROM v WHERE alltoks > {_BUDGET}),
{_pack("pk", "big", "doc_id, sec", chunks.OVERLAP, True)},
rg AS (SELECT * FROM pk UNION ALL SELECT doc_id, sec, 0, 0, 1, len(toks), false FROM v WHERE alltoks <= {_BUDGET}),
lo AS (SELECT q.doc_id, q.sec, q.i, list_transform(ls, lambda x: greatest(1, {_W.format("x")} * 3 // 4)) AS toks FROM q JOIN rg ON rg.doc_id = q.doc_id AND rg.sec = q.sec AND rg.cut AND rg.a = q.i),
{_pack("pl", "lo", "doc_id, sec, i0", chunks.LINE_OVERLAP, False).replace("FROM lo)", "FROM (SELECT doc_id, sec, i AS i0, toks FROM lo))")},
c AS (SELECT doc_id, sec, nth, o, 0 AS n2, firsts[a] AS first_line, lasts[b] AS last_line, array_to_string(list_slice(texts, a, b), chr(10) || chr(10)) AS content FROM rg JOIN v USING (doc_id, sec) WHERE NOT cut
  UNION ALL SELECT q.doc_id, q.sec, q.i, 3, pl.nth * 8 + pl.o, q.first_line, q.last_line, array_to_string(list_slice(ls, pl.a, pl.b), chr(10)) FROM pl JOIN q ON q.doc_id = pl.doc_id AND q.sec = pl.sec AND q.i = pl.i0
  UNION ALL SELECT doc_id, -1, 0, 0, 0, 0, 0, '' FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, nth, o, n2) - 1)::int AS chunk, sec::int AS section_line, first_line::int AS first_line, last_line::int AS last_line, md5(content) AS content FROM c"""

ORACLES = {
    "k10_parse_cards": """SELECT p_partkey AS id, 0 AS nth, ['definition', 'concept', 'cloze', 'definition', 'question_answer'][p_partkey % 6 + 1] AS type, p_name AS front,
 CASE p_partkey % 6 WHEN 2 THEN '{' || p_type || '} "]" ' WHEN 3 THEN 'a: ' || p_type ELSE p_type END AS back, CASE p_partkey % 6 WHEN 0 THEN 'w' WHEN 3 THEN p_brand ELSE '' END AS why FROM part WHERE p_partkey % 6 < 5
 UNION ALL SELECT p_partkey, 1, 'cloze', p_name, p_brand, '' FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 1, 'question_answer', 'second', p_brand, '' FROM part WHERE p_partkey % 6 = 3""",
    "k10_parse_quiz": """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 2 THEN 'true_false' WHEN 1 THEN 'short_answer' ELSE 'multiple_choice' END AS type, 'What is ' || p_name || '?' AS prompt,
 CASE p_partkey % 5 WHEN 2 THEN 'True|False' ELSE '1 ' || p_type || '|' || p_brand || '|' || p_type END AS options, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN 'True' ELSE p_type END AS answer,
 'x: y' AS explanation, 'a|' || p_brand || '|b' AS keywords FROM part WHERE p_partkey % 5 < 4""",
    "k10_parse_insights": """SELECT p_partkey AS id, p_partkey % 3 = 2 AS failed, CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN p_name ELSE '' END AS key_concepts,
 CASE WHEN p_partkey % 3 < 2 THEN p_type ELSE '' END AS gaps, 0 AS others FROM part""",
    "k11_repair_json": """SELECT p_partkey AS id, p_partkey % 5 > 2 AS failed, CASE WHEN p_partkey % 5 < 3 THEN p_name END AS name, CASE WHEN p_partkey % 5 < 3 THEN '},] " {' END AS marks, CASE WHEN p_partkey % 5 < 3 THEN '[' || p_size || ']' END AS sizes FROM part""",
    "b17_semantic_chunks": _CHUNKS,
    "b21_reflow": rf"""WITH l AS (SELECT doc_id, text, list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {{'d': NULL::varchar, 'l': {_TRIM.format('x')}}}) AS ls FROM documents),
r AS (SELECT doc_id, text, list_reduce(list_prepend({{'d': NULL::varchar, 'l': NULL::varchar}}, ls), lambda a, x: CASE
  WHEN a.l <> '' AND ends_with(a.l, '-') AND regexp_matches(x.l, '^\p{{Ll}}') THEN {{'d': a.d, 'l': a.l[:-2] || x.l}}
  WHEN a.l <> '' AND NOT regexp_matches(a.l, '[.!?;:]$') AND regexp_matches(x.l, '^(\p{{Ll}}|\p{{N}}|\)|•)') THEN {{'d': a.d, 'l': a.l || ' ' || x.l}}
  WHEN a.l IS DISTINCT FROM x.l THEN {{'d': CASE WHEN a.l IS NULL THEN NULL WHEN a.d IS NULL THEN a.l ELSE a.d || chr(10) || a.l END, 'l': x.l}} ELSE a END) AS z FROM l WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN z.d IS NULL THEN z.l ELSE z.d || chr(10) || z.l END) AS text FROM r UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
    "b22_clean_generated": rf"""WITH l AS (SELECT doc_id, list_transform(list_transform(string_split_regex(text, '\r\n?|\n'), lambda x: {_TRIM.format('x')}), lambda t: {{'x': t, 'h': replace(replace(replace(lower(t), ':', ''), '-', ' '), '  ', ' '), 'k': NULL::varchar, 'blank': false, 'said': NULL::varchar, 'sec': NULL::varchar}}) AS ls FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, list_transform(ls, lambda x: {{'x': x.x, 'h': {_TYPE.replace("h =", "x.h =")}, 'k': x.k, 'blank': x.blank, 'said': x.said, 'sec': x.sec}}) AS ls FROM l),
r AS (SELECT doc_id, list_reduce(list_prepend({{'x': '', 'h': NULL::varchar, 'k': NULL::varchar, 'blank': false, 'said': NULL::varchar, 'sec': NULL::varchar}}, ls), lambda a, x: CASE
  WHEN x.x = '' THEN CASE WHEN a.blank OR a.k IS NULL THEN a ELSE {{'x': '', 'h': NULL, 'k': a.k || chr(10), 'blank': true, 'said': a.said, 'sec': a.sec}} END
  WHEN {_ARTIFACT} OR coalesce(x.h = a.sec, false) OR (x.h IS NULL AND coalesce(x.x = a.said, false)) THEN {{'x': '', 'h': NULL, 'k': a.k, 'blank': false, 'said': a.said, 'sec': a.sec}}
  ELSE {{'x': '', 'h': NULL, 'k': CASE WHEN a.k IS NULL THEN '' ELSE a.k || chr(10) END || CASE WHEN x.h IS NULL THEN x.x ELSE '## ' || x.h END, 'blank': false, 'said': coalesce(x.h, x.x), 'sec': x.h}} END) AS z FROM t)
SELECT doc_id, md5({_TRIM.format("coalesce(z.k, '')")}) AS text FROM r UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
}
