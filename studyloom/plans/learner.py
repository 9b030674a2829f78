"""Queries of the learner operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import learner as op
from studyloom.plans._tables import AS_OF, REVIEWS, fold_sql, reviews, states, states_sql

_D = 9


def _r(*names: str) -> list:
    return [F.round(n, _D).alias(n) for n in names]


def h1_fold_reviews(spark, d):
    return states(spark, d).select("note_id", "concept_id", *_r("mastery", "confidence"), "review_count", "mistake_count")


def h2_upsert_mastery(spark, d):
    r = reviews(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp")
    df = op.upsert_mastery(op.fold_reviews(r.where(F.col("ts") < cut)), op.fold_reviews(r.where(F.col("ts") >= cut)))
    return df.select("note_id", "concept_id", *_r("mastery", "confidence"), "review_count", "mistake_count")


def h3_effective_mastery(spark, d):
    return states(spark, d).select("note_id", "concept_id", F.round(op.effective_mastery(F.col("mastery"), F.col("last_reviewed"), F.lit(AS_OF).cast("timestamp")), _D).alias("effective"))


def h4_retention(spark, d):
    return op.retention(states(spark, d), AS_OF).select("note_id", "concept_id", *_r("stability", "retention"))


def h5_forgetting_date(spark, d):
    return op.retention(states(spark, d), AS_OF).select("note_id", "concept_id", F.date_format("due", "yyyy-MM-dd").alias("due_day"), F.col("days_until_due").cast("long").alias("days_until_due"))


def h6_urgency(spark, d):
    return op.retention(states(spark, d), AS_OF).select("note_id", "concept_id", *_r("urgency"))


def h7_scheduled_reviews(spark, d):
    return op.scheduled_reviews(states(spark, d), AS_OF, 8, "note_id").select("note_id", "rank", "concept_id", "status", "risk", *_r("urgency"))


def h8_rank_learners(spark, d):
    s = states(spark, d).withColumn("mastery", F.round("mastery", _D))
    parts = [op.rank_learners(s, m, 10).select(F.lit(m).alias("mode"), "concept_id", "mastery") for m in ("weakest", "strongest")]
    return parts[0].unionByName(parts[1])


def h9_srs_fold(spark, d):
    return op.srs_fold(reviews(spark, d)).select("note_id", "concept_id", *_r("mastery", "ease", "confidence", "familiarity"), "review_count", "correct_count", "incorrect_count", "streak", "status", F.date_format("next_review", "yyyy-MM-dd HH:mm:ss").alias("next_review"))


def h10_learner_summary(spark, d):
    return op.learner_summary_scores(states(spark, d), AS_OF).select("note_id", *_r("mastery", "retention", "confidence", "exam_readiness"), "n_weak")


def h11_streaks(spark, d):
    return op.streaks(reviews(spark, d), "2024-01-30")


def h12_merge_ranked(spark, d):
    s = states(spark, d).withColumn("mastery", F.round("mastery", _D))
    lists = [op.rank_learners(s, m, 60).select(F.lit(i).alias("list_rank"), "concept_id", (F.col("mastery") + i).alias("mastery")) for i, m in enumerate(("weakest", "strongest"))]
    return op.merge_ranked(lists[0].unionByName(lists[1])).select("concept_id", *_r("mastery"), "list_rank")


def h13_mastery_state(spark, d):
    s = states(spark, d)
    m = F.round("mastery", _D)
    return s.select(op.mastery_state(m).alias("learner"), op.mastery_state(m, "graph").alias("graph")).groupBy("learner", "graph").agg(F.count("*").alias("n"))


def h14_memory_score(spark, d):
    s = states(spark, d)
    return s.select("note_id", "concept_id", F.round(op.memory_score(F.col("review_count") - F.col("mistake_count"), F.col("mistake_count")), _D).alias("memory"))


def h15_quiz_progress(spark, d):
    r = reviews(spark, d).groupBy(F.col("concept_id").alias("quiz_id"), F.to_date("ts").alias("day")).agg(F.count_if(F.col("outcome").isin("correct", "easy")).alias("correct"), F.count("*").alias("total"))
    return op.quiz_progress(r)


def h16_bucket_outcome(spark, d):
    return reviews(spark, d).groupBy(op.bucket_outcome(F.col("value") % 1.0).alias("outcome")).agg(F.count("*").alias("n"))


def h17_review_history(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("concept_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return reviews(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("concept_id", "rank", "event_id", "outcome")


def h18_mastery_histogram(spark, d):
    return op.mastery_histogram(states(spark, d).withColumn("mastery", F.round("mastery", _D)))


def h18_review_calendar(spark, d):
    df = op.review_calendar(op.retention(states(spark, d), AS_OF))
    return df.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_due", *_r("top_urgency"))


def h20_init_mastery(spark, d):
    s = states(spark, d)
    memory = s.groupBy("concept_id").agg(F.sum(F.col("review_count") - F.col("mistake_count")).alias("mastered"), F.sum("mistake_count").alias("missed")).where("concept_id % 3 = 0")
    return op.init_mastery(s.select("concept_id"), memory).select("concept_id", *_r("mastery"))


QUERIES = {f.__name__: f for f in (h1_fold_reviews, h2_upsert_mastery, h3_effective_mastery, h4_retention, h5_forgetting_date, h6_urgency, h7_scheduled_reviews, h8_rank_learners, h9_srs_fold, h10_learner_summary, h11_streaks, h12_merge_ranked, h13_mastery_state, h14_memory_score, h15_quiz_progress, h16_bucket_outcome, h17_review_history, h18_mastery_histogram, h18_review_calendar, h20_init_mastery)}

_S = f"WITH {states_sql()}"
_NOW = f"TIMESTAMP '{AS_OF}'"
_DAYS = f"greatest(0::double, (epoch_us({_NOW}) - epoch_us(last_reviewed)) / 86400e6::double)"
_RET = f"""{_S}, a AS (SELECT *, greatest(2::double, 5::double + ln(greatest(1, review_count) + 1::double) * 4::double + confidence * 8::double + mastery * 10::double - least(8::double, mistake_count * 1.5::double)) AS stability, mastery * 0.7::double + confidence * 0.3::double AS base FROM states),
b AS (SELECT *, greatest(0::double, least(1::double, base * exp(-{_DAYS} / stability))) AS retention, last_reviewed + to_days(floor(greatest(0::double, stability * ln(greatest(0.05::double, base) / 0.5::double)))::int) AS due FROM a),
c AS (SELECT *, date_diff('day', {_NOW}::date, due::date) AS days_until_due FROM b),
ret AS (SELECT *, greatest(0::double, least(1::double, 1::double - retention + CASE WHEN days_until_due <= 0 THEN 0.25 ELSE 0 END::double)) AS urgency FROM c)"""
_EFF = f"CASE WHEN last_reviewed IS NULL THEN mastery ELSE greatest(0::double, least(1::double, mastery * exp(-{_DAYS} / 30::double))) END"


def _srs(i: int) -> dict[str, float]:
    return {k: v[i] for k, v in op.SRS.items()}


def _half(where: str) -> str:
    return f"SELECT note_id, concept_id, {fold_sql(op.MASTERY_STEP, 0.0)} AS mastery, {fold_sql(op.CONFIDENCE_STEP, 0.5)} AS confidence, count(*) AS n, count(*) FILTER (outcome = 'incorrect') AS bad FROM reviews WHERE {where} GROUP BY ALL"


_STATE = "CASE WHEN m >= {0} THEN 'mastered' WHEN m >= {1} THEN 'familiar' WHEN m >= {2} THEN 'needs practice' ELSE 'struggling' END"
ORACLES = {
    "h1_fold_reviews": f"{_S} SELECT note_id, concept_id, round(mastery, 9) AS mastery, round(confidence, 9) AS confidence, review_count, mistake_count FROM states",
    "h2_upsert_mastery": f"WITH {REVIEWS}, o AS ({_half("ts < '2024-01-15'")}), n AS ({_half("ts >= '2024-01-15'")}) SELECT note_id, concept_id, round(coalesce(n.mastery, o.mastery), 9) AS mastery, round(coalesce(n.confidence, o.confidence), 9) AS confidence, coalesce(o.n, 0) + coalesce(n.n, 0) AS review_count, coalesce(o.bad, 0) + coalesce(n.bad, 0) AS mistake_count FROM o FULL JOIN n USING (note_id, concept_id)",
    "h3_effective_mastery": f"{_S} SELECT note_id, concept_id, round({_EFF}, 9) AS effective FROM states",
    "h4_retention": f"{_RET} SELECT note_id, concept_id, round(stability, 9) AS stability, round(retention, 9) AS retention FROM ret",
    "h5_forgetting_date": f"{_RET} SELECT note_id, concept_id, strftime(due, '%Y-%m-%d') AS due_day, days_until_due FROM ret",
    "h6_urgency": f"{_RET} SELECT note_id, concept_id, round(urgency, 9) AS urgency FROM ret",
    "h7_scheduled_reviews": f"{_RET}, k AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY days_until_due, urgency DESC, concept_id::varchar) AS rank FROM ret) SELECT note_id, rank::int AS rank, concept_id, CASE WHEN days_until_due < 0 THEN 'Overdue ' || abs(days_until_due) || ' days' WHEN days_until_due = 0 THEN 'Due today' WHEN days_until_due = 1 THEN 'Tomorrow' ELSE 'Due in ' || days_until_due || ' days' END AS status, CASE WHEN retention < 0.35 THEN 'High Risk' WHEN retention < 0.65 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk, round(urgency, 9) AS urgency FROM k WHERE rank <= 8",
    "h8_rank_learners": f"{_S}, m AS (SELECT concept_id, round(mastery, 9) AS mastery FROM states) SELECT * FROM (SELECT 'weakest' AS mode, * FROM m ORDER BY mastery, concept_id::varchar LIMIT 10) UNION ALL SELECT * FROM (SELECT 'strongest' AS mode, * FROM m ORDER BY mastery DESC, concept_id::varchar LIMIT 10)",
    "h9_srs_fold": f"""WITH {REVIEWS}, n AS (SELECT *, row_number() OVER (PARTITION BY note_id, concept_id ORDER BY ts, event_id) AS nth FROM reviews),
g AS (SELECT note_id, concept_id, {fold_sql(_srs(0), 0.0)} AS mastery, {fold_sql(_srs(1), 2.5, 1.3, 3.1)} AS ease, {fold_sql(_srs(2), 0.0)} AS confidence,
 list_reduce(list_prepend(0::double, list(CASE WHEN nth = 1 THEN CASE outcome {" ".join(f"WHEN '{k}' THEN {v[3]}" for k, v in op.SRS.items())} END ELSE CASE outcome {" ".join(f"WHEN '{k}' THEN {v[4]}" for k, v in op.SRS.items())} END END::double ORDER BY ts, event_id)), lambda a, x: greatest(0::double, least(1::double, a + x))) AS familiarity,
 count(*) AS n, count(*) FILTER (outcome = 'incorrect') AS bad, count(*) - coalesce(max(nth) FILTER (outcome NOT IN ('easy', 'correct')), 0) AS streak, arg_max(outcome, nth) AS last, max(ts) AS ts FROM n GROUP BY ALL)
SELECT note_id, concept_id, round(mastery, 9) AS mastery, round(ease, 9) AS ease, round(confidence, 9) AS confidence, round(familiarity, 9) AS familiarity, n AS review_count, n - bad AS correct_count, bad AS incorrect_count, streak,
 CASE WHEN last = 'incorrect' THEN 'forgotten' WHEN n = 1 THEN 'firstLearning' WHEN last = 'hard' THEN 'relearning' ELSE 'review' END AS status,
 strftime(ts + to_seconds(CASE last WHEN 'easy' THEN 172800 * greatest(1, streak + 1) WHEN 'correct' THEN CASE WHEN n = 1 THEN 1800 ELSE 172800 END WHEN 'hard' THEN 10800 WHEN 'partial' THEN 1800 ELSE 1200 END), '%Y-%m-%d %H:%M:%S') AS next_review FROM g""",
    "h10_learner_summary": f"{_S}, e AS (SELECT *, {_EFF} AS eff, CASE WHEN last_reviewed IS NULL THEN 0.65 ELSE greatest(0.35::double, least(1::double, 1::double - {_DAYS} / 45::double)) END AS rec FROM states), g AS (SELECT note_id, avg(eff) AS mastery, avg(eff * rec) AS retention, avg(confidence) AS confidence, count(*) FILTER (eff < 0.5) AS n_weak FROM e GROUP BY note_id) SELECT note_id, round(mastery, 9) AS mastery, round(retention, 9) AS retention, round(confidence, 9) AS confidence, round(greatest(0::double, least(1::double, mastery * 0.45::double + retention * 0.3::double + confidence * 0.25::double - least(0.25::double, least(n_weak, 20) * 0.0125::double))), 9) AS exam_readiness, n_weak FROM g",
    "h11_streaks": f"WITH {REVIEWS}, d AS (SELECT DISTINCT concept_id, ts::date AS day FROM reviews), r AS (SELECT concept_id, day, day - (row_number() OVER (PARTITION BY concept_id ORDER BY day))::int AS i FROM d), g AS (SELECT concept_id, i, count(*) AS n, max(day) AS last FROM r GROUP BY ALL) SELECT concept_id, max(CASE WHEN last = DATE '2024-01-30' THEN n ELSE 0 END) AS streak, max(n) AS longest FROM g GROUP BY concept_id",
    "h12_merge_ranked": f"{_S}, m AS (SELECT concept_id, round(mastery, 9) AS mastery FROM states), u AS (SELECT * FROM (SELECT 0 AS list_rank, concept_id, mastery FROM m ORDER BY mastery, concept_id::varchar LIMIT 60) UNION ALL SELECT * FROM (SELECT 1, concept_id, mastery + 1 FROM m ORDER BY mastery DESC, concept_id::varchar LIMIT 60)) SELECT concept_id, round(max_by(mastery, list_rank), 9) AS mastery, max(list_rank) AS list_rank FROM u GROUP BY concept_id",
    "h13_mastery_state": f"{_S}, m AS (SELECT round(mastery, 9) AS m FROM states) SELECT {_STATE.format(0.8, 0.6, 0.4)} AS learner, {_STATE.format(0.8, 0.55, 0.35)} AS graph, count(*) AS n FROM m GROUP BY ALL",
    "h14_memory_score": f"{_S} SELECT note_id, concept_id, round(CASE WHEN review_count = 0 THEN 0.5 ELSE (review_count - mistake_count)::double / review_count END, 9) AS memory FROM states",
    "h15_quiz_progress": f"WITH {REVIEWS}, q AS (SELECT concept_id AS quiz_id, ts::date AS day, count(*) FILTER (outcome IN ('correct', 'easy')) / count(*)::double * 100::double AS p FROM reviews GROUP BY ALL) SELECT quiz_id, count(*) AS n_attempts, round(round(avg(p), 9))::int AS average, round(round(max(p), 9))::int AS best, count(*) FILTER (p >= 70) AS n_passed FROM q GROUP BY quiz_id",
    "h16_bucket_outcome": f"WITH {REVIEWS} SELECT CASE WHEN value % 1::double >= 0.75 THEN 'correct' WHEN value % 1::double >= 0.4 THEN 'partial' ELSE 'incorrect' END AS outcome, count(*) AS n FROM reviews GROUP BY ALL",
    "h17_review_history": f"WITH {REVIEWS}, r AS (SELECT concept_id, (row_number() OVER (PARTITION BY concept_id ORDER BY ts DESC, event_id DESC))::int AS rank, event_id, outcome FROM reviews) SELECT * FROM r WHERE rank <= 5",
    "h18_mastery_histogram": f"{_S} SELECT note_id, least(9, floor(round(mastery, 9) * 10))::int AS bin, count(*) AS n FROM states GROUP BY ALL",
    "h18_review_calendar": f"{_RET} SELECT strftime(due::date, '%Y-%m-%d') AS day, count(*) AS n_due, round(max(urgency), 9) AS top_urgency FROM ret GROUP BY ALL",
    "h20_init_mastery": f"{_S}, g AS (SELECT concept_id, sum(review_count - mistake_count)::double AS a, sum(mistake_count)::double AS b FROM states GROUP BY ALL) SELECT concept_id, round(CASE WHEN concept_id % 3 <> 0 OR a + b = 0 THEN 0.5::double ELSE a / (a + b) END, 9) AS mastery FROM g",
}
