"""Interaction signals (proposal_id, signal_type, concept_ids, ts, event_id) and research events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import edit_class

# What a signal counts as, and what a count adds to mastery.
COUNTED = {
    "accepted": "accept", "rejected": "reject", "heavilyEdited": "heavily_edited", "lightlyEdited": "lightly_edited", "requestedAgain": "requested_again",
    "markedHelpful": "helpful", "questionCorrect": "helpful", "markedStillConfused": "confused", "questionPartiallyCorrect": "confused", "questionIncorrect": "confused",
}
WEIGHTS = {"helpful": 0.12, "accept": 0.08, "lightly_edited": 0.05, "confused": -0.14, "reject": -0.08, "heavily_edited": -0.10, "requested_again": -0.07}


def dedupe_signals(signals: DataFrame) -> DataFrame:
    """The first signal of each proposal and type; partial aggregation instead of a window."""
    first = F.min_by(F.struct(*signals.columns), F.struct("ts", "event_id"))
    return signals.groupBy("proposal_id", "signal_type").agg(first.alias("s")).select("s.*")


def profiles(signals: DataFrame) -> DataFrame:
    """Counts by concept and kind, and the last interaction."""
    rows = signals.select(F.explode("concept_ids").alias("concept_id"), "signal_type", "ts")
    kinds = dict.fromkeys(COUNTED.values())
    counts = [F.count_if(F.col("signal_type").isin(*[s for s, k in COUNTED.items() if k == kind])).alias(kind) for kind in kinds]
    return rows.groupBy("concept_id").agg(*counts, F.max("ts").alias("last_interaction"))


def profile_mastery(df: DataFrame) -> DataFrame:
    """Adds helpful and confusion ratios, and mastery from the weighted counts."""
    total = F.greatest(F.lit(1), sum((F.col(k) for k in WEIGHTS), F.lit(0)))
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.5))
    return df.withColumn("helpful_ratio", F.col("helpful") / total).withColumn("confusion_ratio", F.col("confused") / total).withColumn("mastery", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def history_flags(df: DataFrame) -> DataFrame:
    helpful = F.col("helpful") > F.col("confused")
    confusing = ((F.col("confused") > 0) & (F.col("confused") >= F.col("helpful"))) | (F.col("requested_again") >= 2)
    return df.select("concept_id", helpful.alias("historically_helpful"), confusing.alias("historically_confusing"), (F.col("confused") + F.col("requested_again")).alias("n_confusing"))


def event_statistics(events: DataFrame, types: list[str]) -> DataFrame:
    return events.agg(F.count("*").alias("total"), *[F.count_if(F.col("event_type") == t).alias(t) for t in types])


def respect_opt_out(events: DataFrame, opted_out: DataFrame) -> DataFrame:
    return events.join(opted_out.select("user_id"), "user_id", "left_anti")


def export_rows(events: DataFrame) -> DataFrame:
    """Lines of a CSV export: quotes only where a comma, quote or line end asks for them, metadata as JSON with sorted keys."""
    quoted = lambda c: F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    meta = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata"))))
    cells = [quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("id", "schema_version", "timestamp", "event_type", "session_id", "note_id")]
    return events.select(F.concat_ws(",", *cells, quoted(meta)).alias("line"))


# The header of an export, by column.
CSV_HEADER = {"id": "id", "schema_version": "schemaVersion", "timestamp": "timestamp", "event_type": "eventType", "session_id": "sessionID", "note_id": "noteID", "metadata": "metadata"}


def export_events_csv(events: DataFrame, path: str) -> None:
    """CSV files with the fixed header, quoted only where a comma, quote or line end asks for it; times in ISO 8601, metadata as JSON with sorted keys."""
    shown = {"metadata": F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))), "timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    rows = events.select(*[shown.get(c, F.col(c)).cast("string").alias(h) for c, h in CSV_HEADER.items()])
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def accept_signals(accepted: DataFrame) -> DataFrame:
    """accepted: proposal_id, generated, final. The signal that an accepted text gives, by how much it was edited."""
    kind = edit_class(F.col("generated"), F.col("final"))
    delta = F.when(kind.isNull(), 0.05).when(kind == "lightlyEdited", 0.02).otherwise(-0.02)
    return accepted.select("proposal_id", F.coalesce(kind, F.lit("accepted")).alias("signal_type"), delta.alias("confidence_delta"))


def answer_metrics(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions: question_id, asked. answers: question_id, answered, text, generated. Seconds (0 at least), characters, edit distance."""
    both = answers.join(questions, "question_id")
    seconds = F.greatest(F.lit(0), F.round(F.col("answered").cast("double") - F.col("asked").cast("double"))).cast("long")
    return both.select("question_id", seconds.alias("seconds"), F.length("generated").alias("n_generated"), F.length("text").alias("n_accepted"), F.levenshtein("generated", "text").alias("distance"))


def explode_gap_events(proposals: DataFrame) -> DataFrame:
    """proposals: proposal_id, note_id, gaps (array). An event for each gap."""
    return proposals.select("proposal_id", "note_id", F.posexplode("gaps").alias("nth", "concept"), F.lit("adaptiveContext").alias("heuristic"))


def stale_proposals(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """proposals: proposal_id, note_id, content_hash, version. current: note_id, content_hash, version. Whether each still holds."""
    now = current.select("note_id", F.col("content_hash").alias("now_hash"), F.col("version").alias("now_version"))
    same = (F.col("content_hash") == F.col("now_hash")) | (F.col("version") == F.col("now_version"))
    return proposals.join(now, "note_id", "left").select("proposal_id", (~F.coalesce(same, F.lit(False))).alias("stale"))
