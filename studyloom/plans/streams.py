"""Queries of the stateful streams: each reads its table as a stream, and its SQL states what the end of it must be."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import structure, transcripts
from studyloom.operators.learner import CONFIDENCE_STEP, MASTERY_STEP, START_CONFIDENCE, START_MASTERY
from studyloom.plans._tables import REVIEWS, fold_sql, states_sql, table
from studyloom.plans.structure import _BLOCKS
from studyloom.sources.store import new_path
from studyloom.streaming import events as streaming
from studyloom.streaming import learner
from studyloom.streaming import transcripts as partials
from studyloom.streaming.ingest import NoteStore

_LATE_S = 3600


def _reviews(spark, d):
    """The events as reviews, a stream."""
    s = streaming.read_events(spark, d, "events.parquet")
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "correct").when(kind == "signup", "easy").when(kind == "click", "partial").when(kind == "view", "hard").otherwise("incorrect")
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("concept_id"), (F.col("user_id") % 10).alias("note_id"), outcome.alias("outcome"))


def p2_running_mastery(spark, d):
    df = streaming.latest(streaming.drain(learner.running_mastery(_reviews(spark, d)), "update"), learner.KEY)
    return df.select("note_id", "concept_id", F.round("mastery", 9).alias("mastery"), F.round("confidence", 9).alias("confidence"), "review_count", "mistake_count", "last_reviewed")


def p7_due_alerts(spark, d):
    return streaming.drain(learner.due_alerts(_reviews(spark, d), f"{_LATE_S} seconds"), "append").select("note_id", "concept_id", "due")


def _blocks(notes):
    return structure.detect_blocks(notes.withColumnRenamed("note_id", "doc_id")).select(F.col("doc_id").alias("note_id"), "block_id", "tokens")


def p1_incremental_ingest(spark, d):
    """All documents come in; then every third is edited, then every fifth removed, and the edits come again, too late."""
    source = streaming.read_events(spark, d, "documents.parquet")
    note = F.col("doc_id").alias("note_id")
    first = source.select(note, F.lit(1).alias("version"), F.lit(False).alias("deleted"), F.col("source").alias("title"), "text")
    edits = source.where("doc_id % 3 = 0").select(note, F.lit(2).alias("version"), F.lit(False).alias("deleted"), F.lit("edited").alias("title"), F.concat(F.lit("## Edited\n\n"), "text").alias("text"))
    gone = source.where("doc_id % 5 = 0").select(note, F.lit(3).alias("version"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"))
    store = NoteStore(spark, new_path(spark), {"blocks": _blocks})
    held = {}

    def numbered(df, _):  # one store, several streams: its batches go on counting
        held["n"] = held.get("n", -1) + 1
        store.ingest(df, held["n"])

    for changes in (first, edits, gone, edits):
        changes.writeStream.foreachBatch(numbered).option("checkpointLocation", new_path(spark)).trigger(availableNow=True).start().awaitTermination()
    kind = source.schema["doc_id"].dataType
    notes = store.table("notes", kind).where("content_hash is not null")
    blocks = store.table("blocks", kind).groupBy("note_id").agg(F.count("*").alias("n_blocks"), F.min("block_id").alias("first_block"))
    return notes.join(blocks, "note_id", "left").select("note_id", "version", "content_hash", F.coalesce("n_blocks", F.lit(0).cast("long")).alias("n_blocks"), "first_block")


def _turns(df):
    """Turns of conversations, a minute apart, as partial transcripts of a session."""
    return df.select(F.col("conv_id").alias("session_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts"), F.col("turn").cast("long").alias("turn_id"), "text")


def j12_merge_partials(spark, d):
    return transcripts.merge_partials(_turns(table(spark, d, "conversations")))


def p5_merged_partials(spark, d):
    turns = _turns(streaming.read_events(spark, d, "conversations.parquet"))
    return streaming.latest(streaming.drain(partials.merged_partials(turns), "update"), ["session_id"])


QUERIES = {f.__name__: f for f in (p1_incremental_ingest, p2_running_mastery, p5_merged_partials, p7_due_alerts, j12_merge_partials)}

_SET = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda w: w <> ''))"
_PARTIALS = rf"""WITH t AS (SELECT conv_id, list(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') ORDER BY turn) AS ts, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT conv_id AS session_id, list_reduce(list_prepend('', ts), lambda a, x: CASE WHEN x = '' THEN a WHEN a = '' THEN x
  WHEN length(x) + {transcripts.SHORTER_BY} < length(a) AND len(list_intersect({_SET.format("a")}, {_SET.format("x")})) / greatest(1, len({_SET.format("a")}), len({_SET.format("x")}))::double < {transcripts.SHARED}::double THEN a || ' ' || x ELSE x END) AS text, n AS n_turns FROM t"""
_UNIT = "least(1::double, greatest(0::double, {0}))"
ORACLES = {
    "j12_merge_partials": _PARTIALS,
    "p5_merged_partials": _PARTIALS,
    "p1_incremental_ingest": f"""WITH ended AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 3 = 0 THEN 'edited' ELSE source END AS title, CASE WHEN doc_id % 3 = 0 THEN '## Edited' || chr(10) || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0),
{_BLOCKS.replace("FROM documents", "FROM ended")}
SELECT e.doc_id AS note_id, version::bigint AS version, sha256(trim(coalesce(title, '')) || '␞' || coalesce(text, '')) AS content_hash, coalesce(n, 0)::bigint AS n_blocks, first_block FROM ended e LEFT JOIN (SELECT doc_id, count(*) AS n, min(kind || '-' || a || '-' || b) AS first_block FROM bl GROUP BY doc_id) USING (doc_id)""",
    "p2_running_mastery": f"WITH {states_sql()} SELECT note_id, concept_id, round(mastery, 9) AS mastery, round(confidence, 9) AS confidence, review_count, mistake_count, last_reviewed FROM states",
    "p7_due_alerts": f"""WITH {REVIEWS}, w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {_LATE_S} SECONDS AS mark FROM reviews),
f AS (SELECT note_id, concept_id, ts, lead(ts) OVER k AS next, count(*) OVER p AS n, count(*) FILTER (outcome = 'incorrect') OVER p AS bad,
  {fold_sql(MASTERY_STEP, START_MASTERY).replace(" ORDER BY ts, event_id)", ") OVER p")} AS m, {fold_sql(CONFIDENCE_STEP, START_CONFIDENCE).replace(" ORDER BY ts, event_id)", ") OVER p")} AS c
  FROM reviews WINDOW k AS (PARTITION BY note_id, concept_id ORDER BY ts, event_id), p AS (PARTITION BY note_id, concept_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT note_id, concept_id, next, ts + to_days(floor(greatest(0::double, greatest(2::double, 5 + ln(greatest(1, n) + 1::double) * 4 + {_UNIT.format('c')} * 8 + {_UNIT.format('m')} * 10 - least(8::double, bad * 1.5::double))
  * ln(greatest(0.05::double, {_UNIT.format('m')} * 0.7::double + {_UNIT.format('c')} * 0.3::double) / 0.5::double)))::int) AS due, ts FROM f)
SELECT note_id, concept_id, due FROM d, w WHERE ts <= mark AND (due < next AND next <= mark OR due < mark AND (next IS NULL OR next > mark))""",
}
