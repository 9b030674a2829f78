"""Study material from knowledge items (note_id, item_id, category, title, importance, difficulty), and checks of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import text as fn


def _nth(rows: DataFrame, key: list[str], *order) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def item_gaps(items: DataFrame) -> DataFrame:
    """Gaps of a note: its first four prerequisites and misconceptions (+.1), or its first concept; by priority."""
    cued = _nth(items.where("category in ('prerequisite', 'misconception')"), ["note_id", "category"], "item_id").where("nth <= 4")
    cued = cued.withColumn("priority", F.least(F.lit(1.0), F.col("importance") + F.when(F.col("category") == "misconception", 0.1).otherwise(0.0)))
    bare = items.where("category = 'concept'").join(cued.select("note_id").distinct(), "note_id", "left_anti")
    first = _nth(bare, ["note_id"], "item_id").where("nth = 1").withColumn("priority", F.col("importance"))
    every = cued.unionByName(first).select("note_id", "item_id", "title", "priority")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("note_id").orderBy(F.round("priority", 9).desc(), "item_id")))


def exam_prep(items: DataFrame, k: int = 6) -> DataFrame:
    """The hardest formulas, misconceptions and prerequisites of each note."""
    hard = items.where("category in ('formula', 'misconception', 'prerequisite')")
    return _nth(hard, ["note_id"], F.desc("difficulty"), "item_id").where(F.col("nth") <= k).select("note_id", F.col("nth").alias("rank"), "item_id", "title")


def build_memory(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates: note_id, concept. existing: note_id, concept, mastered, missed. What is known stays, others begin at 0."""
    named = lambda df: df.withColumn("key", fn.norm_key(F.col("concept")))
    known = named(existing).groupBy("note_id", "key").agg(F.min(F.struct("concept", "mastered", "missed")).alias("k"))
    fresh = named(candidates).groupBy("note_id", "key").agg(F.min("concept").alias("concept"))
    both = fresh.join(known, ["note_id", "key"], "left")
    return both.select("note_id", F.coalesce("k.concept", "concept").alias("concept"), F.coalesce("k.mastered", F.lit(0)).alias("mastered"), F.coalesce("k.missed", F.lit(0)).alias("missed"))


def check_outputs(outputs: DataFrame, required: list[str], least_confidence: float) -> DataFrame:
    """outputs: note_id, output_id, key, confidence and the required fields. rule and output_id of each breach."""
    empty = [outputs.where(F.coalesce(F.trim(F.col(f).cast("string")) == "", F.lit(True))).select("note_id", "output_id", F.lit(f"missing {f}").alias("rule")) for f in required]
    low = outputs.where(F.col("confidence") < least_confidence).select("note_id", "output_id", F.lit("low confidence").alias("rule"))
    again = _nth(outputs.withColumn("k", fn.norm_key(F.col("key"))), ["note_id", "k"], "output_id").where("nth > 1").select("note_id", "output_id", F.lit("duplicate").alias("rule"))
    found = low.unionByName(again)
    for e in empty:
        found = found.unionByName(e)
    return found


def latest_artifacts(df: DataFrame) -> DataFrame:
    """One row for each note and kind: the newest, of equal times that with the greatest id."""
    newest = F.max_by(F.struct(*df.columns), F.struct("generated_at", "artifact_id"))
    return df.groupBy("note_id", "kind").agg(newest.alias("a")).select("a.*")


def ingest_sources(sources: DataFrame, weights: dict[str, float]) -> DataFrame:
    """sources: lecture_id, side, source_id, kind, text, weight. Blank ones go; words, weight and text by lecture and side."""
    kind = F.lit(1.0)
    for name, w in weights.items():
        kind = F.when(F.col("kind") == name, w).otherwise(kind)
    rows = sources.where("trim(text) <> ''").withColumn("w", F.greatest(F.lit(0.1), F.col("weight") * kind))
    parts = F.array_sort(F.collect_list(F.struct("source_id", "text")))
    return rows.groupBy("lecture_id", "side").agg(F.count("*").alias("n_sources"), F.sum(fn.n_words(F.col("text"))).alias("n_words"), F.sum("w").alias("weight"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def best_match(source: DataFrame, notes: DataFrame) -> DataFrame:
    """source: lecture_id, concept_id, title. notes: lecture_id, note_concept_id, title. The most similar note concept of each, by tokens.

    Only concepts that share a word can score, so they meet by lecture and word.
    """

    def words(df: DataFrame, key: str, name: str) -> DataFrame:
        k = fn.norm_key(F.col("title"))
        return df.select("lecture_id", key, k.alias(name), F.explode(F.array_distinct(F.split(k, " "))).alias("word")).where("word <> ''")

    pairs = words(source, "concept_id", "a").join(words(notes, "note_concept_id", "b"), ["lecture_id", "word"]).groupBy("lecture_id", "concept_id", "note_concept_id").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    score = F.round(fn.jaccard(F.col("a"), F.col("b")), 9)
    best = pairs.groupBy("lecture_id", "concept_id").agg(F.max(F.struct(score.alias("score"), (-F.col("note_concept_id")).alias("n"))).alias("m"))
    return source.join(best, ["lecture_id", "concept_id"], "left").select("lecture_id", "concept_id", (-F.col("m.n")).alias("note_concept_id"), F.coalesce("m.score", F.lit(0.0)).alias("score"))


def review_priority(items: DataFrame) -> DataFrame:
    """items: lecture_id, title, state, importance, visual. Missing and partial ones and missed pictures (+.1), ranked by lecture: by priority, title, then state."""
    rows = items.where("visual or state in ('missing', 'partial')").withColumn("importance", F.col("importance") + F.when(F.col("visual"), 0.1).otherwise(0.0))
    state = F.when(F.col("visual"), "missing").otherwise(F.col("state"))
    rows = rows.withColumn("state", state).withColumn("priority", F.round(F.col("importance") * F.when(state == "missing", 1.35).otherwise(1.05), 9))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lecture_id").orderBy(F.desc("priority"), F.lower("title"), "title", "state"))).select("lecture_id", "rank", "title", "state", "priority")


def coverage_report(items: DataFrame, completeness: DataFrame) -> DataFrame:
    """items: lecture_id, state, visual. completeness: lecture_id, completeness. Counts by state and a sentence; its percentage is rounded to nine digits first, so that halves go up whatever the order of the sum."""
    concept = ~F.col("visual")
    counts = items.groupBy("lecture_id").agg(F.count_if(concept).alias("n"), *[F.count_if(concept & (F.col("state") == s)).alias(s) for s in ("missing", "partial", "covered")], F.count_if(F.col("visual")).alias("visual"))
    # The sentence of a report.
    text = F.format_string("%d%% completeness across %d lecture concepts, with %d missing, %d partial, %d covered, and %d missing visual cues.", F.round(F.round(F.col("completeness") * 100, 9)).cast("int"), "n", "missing", "partial", "covered", "visual")
    return counts.join(completeness, "lecture_id").select("lecture_id", "missing", "partial", "covered", "visual", text.alias("summary"))
