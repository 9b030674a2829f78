"""Learner state: mastery from review events, retention, due reviews, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What an outcome adds to mastery and to confidence.
MASTERY_STEP = {"correct": 0.05, "easy": 0.05, "partial": 0.01, "hard": 0.01, "incorrect": -0.05}
CONFIDENCE_STEP = {"correct": 0.04, "easy": 0.05, "partial": 0.01, "hard": -0.02, "incorrect": -0.04}
START_MASTERY, START_CONFIDENCE = 0.0, 0.5
FORGETTING_THRESHOLD = 0.5

# Fixed values of the spaced-repetition step, by outcome: mastery, ease, confidence, familiarity (first review, later ones).
SRS = {
    "easy": (0.14, 0.12, 0.18, 0.28, 0.16),
    "correct": (0.08, 0.04, 0.08, 0.18, 0.10),
    "hard": (0.02, -0.08, -0.04, 0.04, 0.04),
    "partial": (0.03, -0.02, 0.01, 0.02, 0.02),
    "incorrect": (-0.12, -0.18, -0.12, -0.12, -0.12),
}
EASE_START, EASE_LEAST, EASE_MOST = 2.5, 1.3, 3.1
LEARNING_S, REVIEW_S, RELEARNING_S, FORGOTTEN_S = 1800, 172_800, 10_800, 1200


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def step_of(outcome: Column, steps: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in steps.items():
        out = F.when(outcome == name, F.lit(value)).otherwise(out)
    return out


def _then(a: Column, b: Column) -> Column:
    """First x -> min(hi, max(lo, x + d)) of a, then that of b: again such a function."""
    return F.struct(
        F.least(b["hi"], F.greatest(b["lo"], a["lo"] + b["d"])).alias("lo"),
        F.least(b["hi"], F.greatest(b["lo"], a["hi"] + b["d"])).alias("hi"),
        (a["d"] + b["d"]).alias("d"),
    )


def _compose(steps: Column) -> Column:
    start = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0.0).alias("d"))
    return F.aggregate(steps, start, _then)


def fold_reviews(events: DataFrame, chunk: str = "day") -> DataFrame:
    """events: concept_id, note_id, outcome, ts, event_id. Mastery and confidence, clamped after each event.

    A clamped step is a function that composes with others like it, so events fold within
    a chunk of time first, and then the chunks: a key's whole history is never in one row.
    """
    one = [F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), step_of(F.col("outcome"), s).alias("d")).alias(n) for n, s in (("m", MASTERY_STEP), ("c", CONFIDENCE_STEP))]
    key = ["note_id", "concept_id"]
    chunks = (
        events.select(*key, "outcome", F.date_trunc(chunk, "ts").alias("chunk"), "ts", "event_id", *one)
        .groupBy(*key, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "m", "c"))).alias("es"), F.count("*").alias("n"), F.count_if(F.col("outcome") == "incorrect").alias("bad"), F.max("ts").alias("last"))
        .select(*key, "chunk", "n", "bad", "last", *[_compose(F.transform("es", _field(x))).alias(x) for x in "mc"])
    )
    whole = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", "m", "c"))).alias("es"), F.sum("n").alias("review_count"), F.sum("bad").alias("mistake_count"), F.max("last").alias("last_reviewed"))
    value = lambda x, start: F.least(x["hi"], F.greatest(x["lo"], F.lit(start) + x["d"]))
    return whole.select(*key, *[value(_compose(F.transform("es", _field(x))), s).alias(n) for x, s, n in (("m", START_MASTERY, "mastery"), ("c", START_CONFIDENCE, "confidence"))], "review_count", "mistake_count", "last_reviewed")


def _field(name: str):
    return lambda e: e[name]


def upsert_mastery(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores and last review from the new rows, counts added; keyed by note_id, concept_id."""
    key = ["note_id", "concept_id"]
    n = new.select(*key, *[F.col(c).alias(f"_{c}") for c in ("mastery", "confidence", "review_count", "mistake_count", "last_reviewed")])
    latest = lambda c: F.coalesce(f"_{c}", c).alias(c)
    added = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
    return old.join(n, key, "full").select(*key, latest("mastery"), latest("confidence"), added("review_count"), added("mistake_count"), latest("last_reviewed"))


def days_since(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400e6))


def effective_mastery(mastery: Column, last: Column, as_of: Column) -> Column:
    """Mastery that decays over 30 days since the last review."""
    return F.when(last.isNull(), clamp(mastery)).otherwise(clamp(mastery * F.exp(-days_since(last, as_of) / 30.0)))


def stability_days(df_mastery: Column, confidence: Column, reviews: Column, mistakes: Column) -> Column:
    bonus = F.log(F.greatest(F.lit(1), reviews) + F.lit(1.0)) * 4.0
    return F.greatest(F.lit(2.0), F.lit(5.0) + bonus + clamp(confidence) * 8.0 + clamp(df_mastery) * 10.0 - F.least(F.lit(8.0), mistakes * F.lit(1.5)))


def retention(df: DataFrame, as_of: str) -> DataFrame:
    """Adds stability, retention, due (predicted forgetting), days_until_due and urgency.

    A record that was never reviewed counts from its updated_at, where there is such a column.
    """
    last = F.coalesce("last_reviewed", "updated_at") if "updated_at" in df.columns else F.col("last_reviewed")
    now = F.lit(as_of).cast("timestamp")
    base = clamp(F.col("mastery")) * 0.7 + clamp(F.col("confidence")) * 0.3
    until = F.floor(F.greatest(F.lit(0.0), F.col("stability") * F.log(F.greatest(F.lit(0.05), base) / FORGETTING_THRESHOLD)))
    return (
        df.withColumn("stability", stability_days(F.col("mastery"), F.col("confidence"), F.col("review_count"), F.col("mistake_count")))
        .withColumn("retention", clamp(base * F.exp(-days_since(last, now) / F.col("stability"))))
        .withColumn("due", last + F.make_dt_interval(until.cast("int")))
        .withColumn("days_until_due", F.datediff(F.to_date("due"), F.to_date(now)))
        .withColumn("urgency", clamp(F.lit(1.0) - F.col("retention") + F.when(F.col("days_until_due") <= 0, 0.25).otherwise(0.0)))
    )


def status_text(days: Column) -> Column:
    return F.when(days < 0, F.concat(F.lit("Overdue "), F.abs(days), F.lit(" days"))).when(days == 0, "Due today").when(days == 1, "Tomorrow").otherwise(F.concat(F.lit("Due in "), days, F.lit(" days")))


def risk_class(value: Column) -> Column:
    return F.when(value < 0.35, "High Risk").when(value < 0.65, "Medium Risk").otherwise("Low Risk")


def scheduled_reviews(states: DataFrame, as_of: str, k: int | None = None, partition: str | None = None) -> DataFrame:
    """Due reviews with status and risk, ranked by due day, urgency, name (within a partition column, if given)."""
    df = retention(states, as_of).withColumn("status", status_text(F.col("days_until_due"))).withColumn("risk", risk_class(F.col("retention")))
    order = ["days_until_due", F.desc("urgency"), F.lower(F.col("concept_id").cast("string")), F.col("concept_id").cast("string")]
    if partition:
        df = df.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
        return df.where(F.col("rank") <= k) if k else df
    df = df.orderBy(*order)
    return df.limit(k) if k else df


def srs_fold(events: DataFrame) -> DataFrame:
    """Spaced repetition per (note, concept) in order of (ts, event_id): familiarity, confidence, mastery, ease, streak, status, next review.

    Mastery, confidence, familiarity and ease are clamped sums, so they compose by chunk;
    the rest depends on the last events only.
    """
    key = ["note_id", "concept_id"]
    order = Window.partitionBy(*key).orderBy("ts", "event_id")
    nth = F.row_number().over(order)
    o = F.col("outcome")
    steps = [step_of(o, {k: v[i] for k, v in SRS.items()}) for i in range(5)]
    bound = lambda d, lo=0.0, hi=1.0: F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), d.alias("d"))
    df = events.withColumn("nth", nth)
    df = df.select(*key, "ts", "event_id", "outcome", "nth", bound(steps[0]).alias("m"), bound(steps[1], EASE_LEAST, EASE_MOST).alias("e"), bound(steps[2]).alias("c"), bound(F.when(F.col("nth") == 1, steps[3]).otherwise(steps[4])).alias("f"))
    good = F.col("outcome").isin("easy", "correct")
    chunks = (
        df.groupBy(*key, F.date_trunc("day", "ts").alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "m", "e", "c", "f"))).alias("es"), F.max(F.struct("ts", "event_id", "outcome")).alias("last"), F.max("nth").alias("n"), F.max(F.when(~good, F.col("nth"))).alias("broken"), F.count_if(F.col("outcome") == "incorrect").alias("bad"))
        .select(*key, "chunk", "last", "n", "broken", "bad", *[_compose(F.transform("es", _field(x))).alias(x) for x in "mecf"])
    )
    whole = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", "m", "e", "c", "f"))).alias("es"), F.max("last").alias("last"), F.max("n").alias("n"), F.coalesce(F.max("broken"), F.lit(0)).alias("broken"), F.sum("bad").alias("bad"))
    value = lambda x, start: F.least(x["hi"], F.greatest(x["lo"], F.lit(start) + x["d"]))
    streak, last, first = F.col("n") - F.col("broken"), F.col("last.outcome"), F.col("n") == 1
    status = F.when(last == "incorrect", "forgotten").when(first, "firstLearning").when(last == "hard", "relearning").otherwise("review")
    wait = F.when(last == "easy", F.lit(REVIEW_S) * F.greatest(F.lit(1), streak + 1)).when(last == "correct", F.when(first, LEARNING_S).otherwise(REVIEW_S)).when(last == "hard", RELEARNING_S).when(last == "partial", LEARNING_S).otherwise(FORGOTTEN_S)
    return whole.select(
        *key,
        *[value(_compose(F.transform("es", _field(x))), s).alias(n) for x, s, n in (("m", 0.0, "mastery"), ("e", EASE_START, "ease"), ("c", 0.0, "confidence"), ("f", 0.0, "familiarity"))],
        F.col("n").alias("review_count"), (F.col("n") - F.col("bad")).alias("correct_count"), F.col("bad").alias("incorrect_count"), streak.alias("streak"), status.alias("status"),
        F.timestamp_micros(F.unix_micros(F.col("last.ts")) + wait.cast("long") * 1_000_000).alias("next_review"),
    )


def mastery_state(score: Column, scheme: str = "learner") -> Column:
    """Two scales of thresholds: learner (.8, .6, .4) and graph (.8, .55, .35)."""
    a, b, c = {"learner": (0.8, 0.6, 0.4), "graph": (0.8, 0.55, 0.35)}[scheme]
    return F.when(score >= a, "mastered").when(score >= b, "familiar").when(score >= c, "needs practice").otherwise("struggling")


def rank_learners(states: DataFrame, mode: str, k: int) -> DataFrame:
    """weakest, strongest, recent, or needing (never reviewed first): the k first records."""
    name = F.col("concept_id").cast("string")
    order = {"weakest": [F.asc("mastery"), name], "strongest": [F.desc("mastery"), name], "recent": [F.desc_nulls_last("last_reviewed"), name], "needing": [F.asc_nulls_first("last_reviewed"), F.asc("mastery"), name]}[mode]
    return states.orderBy(*order).limit(k)


def learner_summary_scores(states: DataFrame, as_of: str, weak: float = 0.5, weak_cap: int = 20) -> DataFrame:
    """Mean mastery, recency-weighted retention, confidence and exam readiness of all records of a note."""
    now = F.lit(as_of).cast("timestamp")
    eff = effective_mastery(F.col("mastery"), F.col("last_reviewed"), now)
    recency = F.when(F.col("last_reviewed").isNull(), 0.65).otherwise(F.greatest(F.lit(0.35), F.least(F.lit(1.0), 1.0 - days_since(F.col("last_reviewed"), now) / 45.0)))
    df = states.groupBy("note_id").agg(F.avg(eff).alias("mastery"), F.avg(eff * recency).alias("retention"), F.avg("confidence").alias("confidence"), F.count_if(eff < weak).alias("n_weak"))
    penalty = F.least(F.lit(0.25), F.least(F.col("n_weak"), F.lit(weak_cap)) * 0.0125)
    return df.withColumn("exam_readiness", clamp(F.col("mastery") * 0.45 + F.col("retention") * 0.30 + F.col("confidence") * 0.25 - penalty))


def streaks(events: DataFrame, as_of: str) -> DataFrame:
    """Days in a row with events, up to the day of as_of; longest run as well. events: concept_id, ts."""
    days = events.select("concept_id", F.to_date("ts").alias("day")).distinct()
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy("concept_id").orderBy("day")))).groupBy("concept_id", "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy("concept_id").agg(F.max(F.when(F.col("last") == F.lit(as_of).cast("date"), F.col("n")).otherwise(0)).alias("streak"), F.max("n").alias("longest"))


def merge_ranked(lists: DataFrame) -> DataFrame:
    """lists: list_rank, concept_id and a value; the last list wins for a concept."""
    return lists.groupBy("concept_id").agg(F.max_by("mastery", "list_rank").alias("mastery"), F.max("list_rank").alias("list_rank"))


def memory_score(mastered: Column, missed: Column) -> Column:
    return F.when(mastered + missed == 0, 0.5).otherwise(mastered / (mastered + missed))


def quiz_progress(attempts: DataFrame) -> DataFrame:
    """attempts: quiz_id, correct, total. Rounded mean and best percentage, and how many attempts pass at 70.

    Rounded to nine digits first, so that halves go up whatever the order of the sum.
    """
    percent = F.when(F.col("total") > 0, F.col("correct") / F.col("total") * 100.0).otherwise(0.0)
    return attempts.groupBy("quiz_id").agg(F.count("*").alias("n_attempts"), F.round(F.round(F.avg(percent), 9)).cast("int").alias("average"), F.round(F.round(F.max(percent), 9)).cast("int").alias("best"), F.count_if(percent >= 70).alias("n_passed"))


def bucket_outcome(score: Column) -> Column:
    return F.when(score >= 0.75, "correct").when(score >= 0.4, "partial").otherwise("incorrect")


def mastery_histogram(states: DataFrame, bins: int = 10) -> DataFrame:
    at = F.least(F.lit(bins - 1), F.floor(clamp(F.col("mastery")) * bins)).cast("int")
    return states.groupBy("note_id", at.alias("bin")).agg(F.count("*").alias("n"))


def review_calendar(scheduled: DataFrame) -> DataFrame:
    return scheduled.groupBy(F.to_date("due").alias("day")).agg(F.count("*").alias("n_due"), F.max("urgency").alias("top_urgency"))


def init_mastery(concepts: DataFrame, memory: DataFrame) -> DataFrame:
    """Concepts and keys of memory together; the score from memory, or one half. concepts: concept_id; memory: concept_id, mastered, missed."""
    keys = concepts.select("concept_id").union(memory.select("concept_id")).distinct()
    return keys.join(memory, "concept_id", "left").select("concept_id", memory_score(F.coalesce("mastered", F.lit(0)), F.coalesce("missed", F.lit(0))).alias("mastery"))
