"""Items linked to concepts and labels: keyword scores, ranked labels, graded explanations, star relationships, topic trees, visual cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import text as fn
from studyloom.operators.concepts import is_subsequence, label_score

# Points of a term and of the whole query by where they stand, and the days in which a note grows old.
TERM_TITLE, TERM_BODY, TERM_FOLDER, TERM_FUZZY = 3.0, 4.0, 1.5, 1.25
QUERY_TITLE, QUERY_BODY, QUERY_FOLDER = 4.0, 3.0, 1.0
RECENT_DAYS = 14
# Words that explain, and words that speak of a picture.
EXPLANATORY = ["adjusts", "allows", "because", "changes", "connects", "explains", "helps", "matters", "moves", "produces", "reduces", "relates", "supports", "uses"]
VISUAL = ["diagram", "figure", "chart", "workflow", "architecture", "pipeline", "graph", "table", "flowchart", "visual", "screenshot", "illustration", "sketch", "whiteboard"]
VISUAL_KINDS = ["slides", "whiteboard", "pdf"]
# Cues of a star relationship; the first that matches counts.
STAR_CUES = {"dependsOn": ["depends on", "requires", "prerequisite"], "leadsTo": ["causes", "leads to"], "illustrates": ["example"], "contrastsWith": ["compares", "versus", "compared to"]}


def keyword_score(title: Column, body: Column, folder: Column, query: Column, terms: Column, age_seconds: Column) -> Column:
    """Score of a note for a query and its terms (an array, in lower case); null where nothing matches, recency alone for a blank query."""
    t, b, f = F.lower(F.trim(title)), F.lower(F.trim(body)), F.lower(folder)
    q = F.lower(F.trim(query))
    fuzzy = lambda x: is_subsequence(x, t) | is_subsequence(x, b) | is_subsequence(x, f)
    points = lambda x: F.when(t.contains(x), TERM_TITLE).when(b.contains(x), TERM_BODY).when(f.contains(x), TERM_FOLDER).when(fuzzy(x), TERM_FUZZY).otherwise(0.0)
    by_term = F.aggregate(terms, F.lit(0.0), lambda a, x: a + points(x))
    recent = 1.0 - F.least(F.lit(1.0), age_seconds / (RECENT_DAYS * 86400.0))
    phrase = F.when(t.contains(q), QUERY_TITLE).otherwise(0.0) + F.when(b.contains(q), QUERY_BODY).otherwise(0.0) + F.when(f.contains(q), QUERY_FOLDER).otherwise(0.0)
    return F.when(q == "", recent).when(by_term + phrase > 0, by_term + phrase + recent)


def match_labels(df: DataFrame, key: str) -> DataFrame:
    """df: key, label_id, query, title, subtitle, keywords. Labels with a positive score by rank within a key."""
    scored = df.select(key, "label_id", "title", label_score(F.col("query"), F.col("title"), F.col("subtitle"), F.col("keywords")).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.lower("title"), "label_id"))
    return scored.select(key, rank.alias("rank"), "label_id", "score")


def _meaningful(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.length(w) > 2)


def grade_explanations(df: DataFrame) -> DataFrame:
    """df with answer, concept: adds label and confidence by the number of words, the concept's words and words that explain."""
    w, own = _meaningful(F.col("answer")), _meaningful(F.col("concept"))
    n = F.size(w)
    overlap = F.size(F.filter(w, lambda x: F.array_contains(own, x)))
    signals = F.size(F.filter(w, lambda x: x.isin(EXPLANATORY)))
    label = (
        F.when(n == 0, "incorrect")
        .when((n >= 10) & ((overlap > 0) | (signals >= 2) | (F.size(own) == 0)), "correct")
        .when((n >= 4) | (overlap > 0) | (signals > 0), "partiallyCorrect")
        .otherwise("incorrect")
    )
    graded = df.withColumn("label", label)
    base = F.when(F.col("label") == "correct", 0.82).when(F.col("label") == "partiallyCorrect", 0.55).otherwise(0.25)
    return graded.withColumn("confidence", F.least(F.lit(1.0), base + F.least(n / 80.0, F.lit(0.08))))


def link_items(items: DataFrame, found: DataFrame) -> DataFrame:
    """items: item_id, fallback (array); found: item_id, concept_id. The concepts named with the first fallback, or the fallback."""
    named = found.groupBy("item_id").agg(F.collect_set("concept_id").alias("named"))
    first = F.slice("fallback", 1, 1)
    linked = F.when(F.col("named").isNull(), F.col("fallback")).otherwise(F.array_union("named", first))
    return items.join(named, "item_id", "left").select("item_id", F.array_sort(linked).alias("concept_ids"))


def star_kind(sentence: Column) -> Column:
    s, kind = F.lower(sentence), None
    for name, cues in STAR_CUES.items():
        hit = F.lit(False)
        for cue in cues:
            hit = hit | s.contains(cue)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.otherwise("relatedTo")


def star_relationships(found: DataFrame, sentences: DataFrame) -> DataFrame:
    """Edges by document from the first-listed concept of a sentence to the next three; of equal ones the earliest sentence's.

    found: doc_id, pos, concept_id, listed (the concept's place in the list); sentences: doc_id, pos, sentence.
    """
    place = F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy("listed", "concept_id"))
    few = F.array_sort(F.collect_list(F.struct("place", "concept_id")))
    star = found.withColumn("place", place).where("place <= 4").groupBy("doc_id", "pos").agg(few.alias("c")).where("size(c) > 1")
    told = star.join(sentences.select("doc_id", "pos", "sentence"), ["doc_id", "pos"])
    confidence = F.when(F.length("sentence") > 80, 0.82).otherwise(0.68)
    edges = told.select("doc_id", "pos", F.col("c")[0]["concept_id"].alias("source_id"), F.explode(F.slice("c", 2, 3)).alias("t"), star_kind(F.col("sentence")).alias("relation"), confidence.alias("confidence"))
    return edges.groupBy("doc_id", "source_id", F.col("t.concept_id").alias("target_id"), "relation").agg(F.min_by("confidence", "pos").alias("confidence"))


def topic_tree(concepts: DataFrame, edges: DataFrame, width: int = 6, related: int = 3) -> DataFrame:
    """concepts: note_id, concept_id, listed; edges: edge_id, source_id, target_id. A note's first concepts, each with the first related ones (null: none)."""
    top = concepts.withColumn("place", F.row_number().over(Window.partitionBy("note_id").orderBy("listed", "concept_id"))).where(F.col("place") <= width).drop("listed")
    ends = [("source_id", "target_id"), ("target_id", "source_id")]
    both = [edges.select(F.col(a).alias("concept_id"), F.col(b).alias("related_id"), "edge_id") for a, b in ends]
    near = both[0].unionByName(both[1]).groupBy("concept_id", "related_id").agg(F.min("edge_id").alias("edge_id"))
    nth = F.row_number().over(Window.partitionBy("concept_id").orderBy("edge_id", "related_id"))
    near = near.withColumn("related_place", nth).where(F.col("related_place") <= related).drop("edge_id")
    return top.join(near, "concept_id", "left").select("note_id", "place", "concept_id", "related_place", "related_id")


def visual_cues(sources: DataFrame) -> DataFrame:
    """sources: doc_id, kind, text. Lines of slides, boards and PDFs that speak of a picture, one by title."""
    lines = sources.where(F.col("kind").isin(VISUAL_KINDS)).select("doc_id", "kind", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "raw"))
    said = lines.withColumn("raw", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    hit = F.lit(False)
    for cue in VISUAL:
        hit = hit | fn.norm_key(F.col("raw")).contains(cue)
    bare = F.regexp_replace(F.regexp_replace("raw", "•", ""), r"^\s+|\s+$", "")
    words = F.filter(F.split(bare, " "), lambda w: w != "")
    title = F.when(F.length(bare) <= 72, bare).otherwise(F.concat(F.array_join(F.slice(words, 1, 8), " "), F.lit("...")))
    told = said.where(hit).select("doc_id", "kind", "line", title.alias("title")).withColumn("key", fn.norm_key(F.col("title")))
    first = told.where("key <> ''").groupBy("doc_id", "key").agg(F.min(F.struct("line", "title", "kind")).alias("x"))
    return first.select("doc_id", "x.line", "x.title", F.when(F.col("x.kind") == "slides", 1.4).otherwise(1.1).alias("importance"))


def self_coverage(n_concepts: Column, n_topics: Column) -> Column:
    """Share of concepts among concepts and topics, where there is no source to compare with."""
    return F.least(F.lit(1.0), n_concepts / F.greatest(F.lit(1), n_topics + n_concepts))


def all_aliases(note: DataFrame, canonical: DataFrame) -> DataFrame:
    """Both: concept_id, alias. Every alias of a concept once, sorted."""
    both = note.select("concept_id", "alias").union(canonical.select("concept_id", "alias")).where("alias is not null")
    return both.groupBy("concept_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def unique_names(names: Column) -> Column:
    """Trimmed names without blank ones, the first of those that differ in case only."""
    said = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(said, F.lower)
    return F.filter(said, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def learner_summary(df: DataFrame) -> DataFrame:
    """df with the arrays weak, strong, missing, gaps and n_sources: adds identified_gaps (3 at most), level, evidence and confidence (0 without evidence)."""
    weak, strong, missing = unique_names(F.concat("weak", "gaps")), unique_names(F.col("strong")), unique_names(F.col("missing"))
    n = F.size(weak) + F.size(strong) + F.size(missing) + F.least(F.lit(3), F.col("n_sources"))
    level = F.when(F.size(missing) > 0, "Needs prerequisite support").when(F.size(weak) > 0, "Developing understanding").when(F.size(strong) > 0, "Ready for deeper explanation").when(F.col("n_sources") > 0, "Context available").otherwise("Unknown")
    found = df.withColumn("identified_gaps", F.slice(unique_names(F.concat(missing, weak)), 1, 3)).withColumn("level", level).withColumn("evidence", n)
    return found.withColumn("confidence", F.when(F.col("evidence") > 0, F.least(F.lit(0.85), 0.35 + F.col("evidence") * 0.1)).otherwise(0.0))


def set_coverage(source: DataFrame, prerequisites: DataFrame, notes: DataFrame) -> DataFrame:
    """source: lecture_id, concept_id, title, related (array); prerequisites: lecture_id, title; notes: lecture_id, title. Coverage by equal keys.

    A concept is covered where its title or a related one is in the notes, and partial where only a related one is;
    partial ones are thus covered too. Counts end at 6, 5 and 5.
    """
    known = notes.select("lecture_id", fn.norm_key(F.col("title")).alias("key")).distinct().withColumn("there", F.lit(True))
    keyed = source.select("lecture_id", "concept_id", F.posexplode(F.concat(F.array("title"), "related")).alias("place", "name")).withColumn("key", fn.norm_key(F.col("name")))
    met = keyed.join(known, ["lecture_id", "key"], "left").groupBy("lecture_id", "concept_id").agg(F.coalesce(F.bool_or(F.col("there") & (F.col("place") == 0)), F.lit(False)).alias("own"), F.coalesce(F.bool_or(F.col("there") & (F.col("place") > 0)), F.lit(False)).alias("near"))
    counts = met.groupBy("lecture_id").agg(F.count("*").alias("n"), F.least(F.lit(6), F.count_if(F.col("own") | F.col("near"))).alias("covered"), F.least(F.lit(5), F.count_if(F.col("near") & ~F.col("own"))).alias("partial"))
    lacking = prerequisites.select("lecture_id", fn.norm_key(F.col("title")).alias("key")).join(known, ["lecture_id", "key"], "left_anti").groupBy("lecture_id").agg(F.least(F.lit(5), F.count("*")).alias("missing"))
    out = counts.join(lacking, "lecture_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    rest = F.greatest(F.lit(0), F.col("n") - F.col("covered") - F.col("partial") - F.col("missing"))
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("covered") + F.col("partial") * 0.55 + rest * 0.18) / F.col("n"))))
