"""Knowledge gaps, tasks and plans from concepts, prerequisite edges and mastery (concept_id, mastery, mistake_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import text as fn
from studyloom.operators.graph import prerequisite_chain, prerequisite_edges, traverse
from studyloom.operators.text import from_text
from studyloom.sources.store import keep

LOW, MISSED, WEAK_PREREQUISITE = "Low mastery", "Frequently missed in review", "Weak prerequisite for mastered dependent concept"
TASK_MINUTES = 15
# Which reason of two tasks for one concept stays, and the order of a plan.
DUPLICATE_RANK = {"missingPrerequisite": 5, "weakConcept": 4, "examPreparation": 3, "highDependencyConcept": 2, "reviewDue": 1}
ORDER_RANK = {"missingPrerequisite": 5, "weakConcept": 4, "reviewDue": 3, "examPreparation": 2, "highDependencyConcept": 1}


def detect_gaps(concepts: DataFrame, edges: DataFrame, mastery: DataFrame) -> DataFrame:
    """concept_id, reason, severity: the largest severity; a weak prerequisite as the reason beats low mastery."""
    best = mastery.groupBy("concept_id").agg(F.max("mastery").alias("mastery"), F.max("mistake_count").alias("mistake_count"))
    scored = concepts.select("concept_id").join(best, "concept_id", "left").select("concept_id", F.coalesce("mastery", F.lit(0.5)).alias("mastery"), F.coalesce("mistake_count", F.lit(0)).alias("mistake_count"))
    low = scored.where("mastery < 0.5").select("concept_id", F.lit(LOW).alias("reason"), (1.0 - F.col("mastery")).alias("severity"), F.lit(0).alias("prefer"))
    missed = scored.where("mistake_count > 0 and mastery < 0.65").select("concept_id", F.lit(MISSED).alias("reason"), F.least(F.lit(1.0), 0.45 + F.col("mistake_count") * 0.12).alias("severity"), F.lit(0).alias("prefer"))
    a = scored.select(F.col("concept_id").alias("source_id"), F.col("mastery").alias("dependent"))
    b = scored.select(F.col("concept_id").alias("target_id"), F.col("mastery").alias("prerequisite"))
    weak = prerequisite_edges(edges).join(a, "source_id").join(b, "target_id").where("dependent >= 0.8 and prerequisite < 0.5")
    weak = weak.select(F.col("target_id").alias("concept_id"), F.lit(WEAK_PREREQUISITE).alias("reason"), F.least(F.lit(1.0), F.col("dependent") - F.col("prerequisite")).alias("severity"), F.lit(1).alias("prefer"))
    every = low.unionByName(missed).unionByName(weak)
    return every.groupBy("concept_id").agg(F.max_by("reason", F.struct("prefer", "severity", "reason")).alias("reason"), F.max("severity").alias("severity"))


def prerequisite_plan(edges: DataFrame, targets: DataFrame, mastery: DataFrame, review_below: float = 0.65) -> DataFrame:
    """Ordered steps to a target with mastery and why; needs are those under the limit."""
    chain = prerequisite_chain(edges, targets)
    df = chain.join(mastery.select(F.col("concept_id").alias("node"), "mastery"), "node", "left").withColumn("mastery", F.coalesce("mastery", F.lit(0.5)))
    return df.select("target", "place", "node", "distance", "mastery", F.when(F.col("mastery") < review_below, "review").otherwise("known").alias("reason"))


def learning_path(plan: DataFrame) -> DataFrame:
    """Beginner for the first half of a target's steps, intermediate for the rest."""
    n = F.count("*").over(Window.partitionBy("target"))
    return plan.withColumn("stage", F.when(F.col("place") <= F.greatest(F.lit(1), F.floor(n / 2)), "beginner").otherwise("intermediate"))


def unstarted(concepts: DataFrame, mastery: DataFrame) -> DataFrame:
    return concepts.join(mastery.select("concept_id"), "concept_id", "left_anti")


def _rank(reason: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in ranks.items():
        out = F.when(reason == name, F.lit(value)).otherwise(out)
    return out


def merge_tasks(tasks: DataFrame) -> DataFrame:
    """tasks: concept, priority, reason, depth. One per concept, in the order of a plan (place)."""
    high = (F.col("reason") == "reviewDue") & (F.col("priority") >= 1.0)
    best = tasks.groupBy(F.lower(F.trim("concept")).alias("key")).agg(F.max_by(F.struct("concept", "priority", "reason", "depth"), F.struct(high.cast("int"), _rank(F.col("reason"), DUPLICATE_RANK), "priority", "depth")).alias("t")).select("t.*")
    order = F.when(high, 6).otherwise(_rank(F.col("reason"), ORDER_RANK))
    ordered = best.withColumn("rank", order)
    # parts of the whole order, each numbered in a task of its own, and the sizes of the parts before it
    keys = [F.desc("rank"), F.col("depth"), F.desc("priority"), F.col("reason"), F.lower("concept"), F.col("concept")]
    parts = int(best.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(ordered.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return dealt.withColumn("nth", nth).join(F.broadcast(before), "part").select("concept", "priority", "reason", "depth", (F.col("before") + F.col("nth")).alias("place"))


def pack_days(tasks: DataFrame, days: int, minutes: int) -> DataFrame:
    """Tasks of TASK_MINUTES each in order of place; what the days can't hold is left out."""
    each = max(1, minutes // TASK_MINUTES)
    return tasks.withColumn("day", F.floor((F.col("place") - 1) / each) + 1).where(F.col("day") <= days)


def plan_totals(tasks: DataFrame) -> DataFrame:
    """Tasks and minutes by day, and in total (day null)."""
    return tasks.rollup("day").agg(F.count("*").alias("n_tasks"), (F.count("*") * TASK_MINUTES).alias("minutes"))


# --- recommendations and further plans ------------------------------------------------------


def recommend_reviews(ranked: DataFrame, concepts: DataFrame, k: int = 8) -> DataFrame:
    """ranked: learner_id, concept_id, place (from operators.learner.rank_learners or the like). The k first by name; unknown concepts go."""
    named = ranked.join(concepts.select("concept_id", "name"), "concept_id")
    rank = F.row_number().over(Window.partitionBy("learner_id").orderBy("place", "concept_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("learner_id", "rank", "concept_id", "name")


def review_dependencies(plan: DataFrame, below: float = 0.75) -> DataFrame:
    """plan: that of prerequisite_plan. The prerequisites of each target that need a review, in order."""
    return plan.where(F.col("mastery") < below).select("target", "place", "node", "mastery")


def next_topics(strong: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """strong: learner_id, concept_id, place. What depends on strong concepts within two steps, in the order of first mention."""
    up = traverse(edges, strong.select("concept_id").distinct(), "in", 2).where("distance > 0")
    found = strong.join(up.select(F.col("seed").alias("concept_id"), "node", "distance"), "concept_id")
    first = found.groupBy("learner_id", "node").agg(F.min(F.struct("place", "distance")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("learner_id").orderBy("at", "node"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("learner_id", "rank", "node")


def learning_gaps(weak: DataFrame, edges: DataFrame, k: int = 6) -> DataFrame:
    """weak: concept_id. Weak concepts that block others within four steps, and the first k of those."""
    up = traverse(edges, weak.select("concept_id").distinct(), "in", 4).where("distance > 0")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))
    blocked = up.withColumn("rank", rank).where(F.col("rank") <= k)
    return blocked.groupBy(F.col("seed").alias("concept_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("blocked"))


def exam_tasks(chain: DataFrame, targets: DataFrame, mastery: DataFrame, days: int) -> DataFrame:
    """chain: that of prerequisite_chain. A task for each prerequisite and the target: concept, priority, reason, depth."""
    last = targets.select(F.col("concept_id").alias("target"), F.col("concept_id").alias("node"), F.lit(True).alias("last"))
    steps = chain.select("target", "node", F.col("place") - 1, F.lit(False)).toDF("target", "node", "nth", "last")
    n = chain.groupBy("target").agg(F.count("*").alias("n"))
    every = steps.unionByName(last.join(n, "target", "left").select("target", "node", F.coalesce("n", F.lit(0)).alias("nth"), "last")).join(n, "target", "left")
    scored = every.join(mastery.select(F.col("concept_id").alias("node"), "mastery"), "node", "left")
    ahead = F.coalesce("n", F.lit(0)) - F.col("nth")
    priority = 0.72 + (1.0 - F.coalesce("mastery", F.lit(0.5))) * 0.22 + ahead * 0.03 + (0.08 if days <= 7 else 0.0) - F.col("nth") * 0.01
    return scored.select("target", F.col("node").cast("string").alias("concept"), priority.alias("priority"), F.when(F.col("last"), "examPreparation").otherwise("missingPrerequisite").alias("reason"), F.col("nth").cast("int").alias("depth"))


def review_tasks(reviews: DataFrame) -> DataFrame:
    """reviews: concept, urgency, place (from 1, in order of due dates). Tasks of a review plan."""
    return reviews.select("concept", (0.95 + F.col("urgency") - (F.col("place") - 1) * 0.01).alias("priority"), F.lit("reviewDue").alias("reason"), F.lit(0).alias("depth"))


def _first(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows with their place from 0."""
    return df.orderBy(*order).limit(k).withColumn("nth", F.row_number().over(Window.orderBy(*order)) - 1)


def prioritized_tasks(overdue: DataFrame, due: DataFrame, weak: DataFrame, chain: DataFrame, reviews: DataFrame, bottlenecks: DataFrame, minutes: int, k: int = 8, most: int = 6) -> DataFrame:
    """The tasks that fit in the minutes, in the order of a plan.

    overdue, due: concept, urgency. weak, reviews: concept, mastery. chain: that of prerequisite_chain.
    bottlenecks: concept, downstream, prerequisites. The k first (most first bottlenecks) of each count.
    """
    task = lambda df, concept, priority, reason, depth: df.select(F.col(concept).cast("string").alias("concept"), priority.alias("priority"), F.lit(reason).alias("reason"), depth.cast("int").alias("depth"))
    nth, urgency = F.col("nth"), F.col("urgency")
    late = task(_first(overdue, k, F.desc("urgency"), F.col("concept")), "concept", 1.2 + urgency - nth * 0.01, "reviewDue", F.lit(-1))
    today = task(_first(due, k, F.desc("urgency"), F.col("concept")), "concept", 0.76 + urgency * 0.05 - nth * 0.01, "reviewDue", F.lit(-1))
    weakest = _first(weak, k, F.col("mastery"), F.col("concept")).select(F.col("concept").alias("target"))
    before = chain.join(F.broadcast(weakest), "target")
    n = before.groupBy("target").agg(F.count("*").alias("n"))
    first = task(before, "node", 0.95 - (F.col("place") - 1) * 0.01, "missingPrerequisite", F.col("place") - 1)
    then = task(weakest.join(n, "target", "left"), "target", F.lit(0.9), "weakConcept", F.coalesce("n", F.lit(0)))
    again = task(_first(reviews, k, F.col("mastery"), F.col("concept")), "concept", 0.74 - nth * 0.02, "reviewDue", F.lit(0))
    narrow = task(_first(bottlenecks, most, F.desc("downstream"), F.desc("prerequisites"), F.col("concept")), "concept", 0.62 + F.least(F.lit(0.2), F.col("downstream") * 0.02), "highDependencyConcept", F.col("prerequisites"))
    every = late.unionByName(today).unionByName(first).unionByName(then).unionByName(again).unionByName(narrow)
    return merge_tasks(every).where(F.col("place") <= max(1, minutes // TASK_MINUTES))


def study_next(chain: DataFrame, edges: DataFrame, targets: DataFrame, k: int = 4) -> DataFrame:
    """The k next things to learn for each target: its prerequisites, then what builds on it within two steps."""
    before = chain.select("target", "node", (0.88 - (F.col("place") - 1) * 0.03).alias("priority"), F.lit("missingPrerequisite").alias("reason"), (F.col("place") - 1).alias("depth"))
    up = traverse(edges, targets, "in", 2).where("distance > 0")
    nth = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))
    after = up.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("seed").alias("target"), "node", (0.58 - (F.col("nth") - 1) * 0.03).alias("priority"), F.lit("highDependencyConcept").alias("reason"), F.col("nth").alias("depth"))
    key = F.struct(_rank(F.col("reason"), DUPLICATE_RANK), F.round("priority", 9))
    best = before.unionByName(after).groupBy("target", "node").agg(F.max_by(F.struct("priority", "reason", "depth"), key).alias("t")).select("target", "node", "t.*")
    order = Window.partitionBy("target").orderBy(_rank(F.col("reason"), ORDER_RANK).desc(), "depth", F.round("priority", 9).desc(), "node")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_gaps(existing: DataFrame, detected: DataFrame, as_of: str) -> DataFrame:
    """existing: note_id, title, priority, status, detected_at. detected: note_id, title, priority.

    Detected gaps refresh title and priority of known ones and keep their status; new ones are active.
    Gaps are the same where their keys are; of several rows with one key the most urgent counts.
    """

    def once(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumn("key", fn.norm_key(F.col("title"))).where("key <> ''")
        return rows.groupBy("note_id", "key").agg(F.max_by(F.struct(*df.columns), F.struct("priority", "title", *df.columns)).alias(name))

    both = once(existing, "old").join(once(detected, "new"), ["note_id", "key"], "full")
    return both.select(
        "note_id", F.coalesce("new.title", "old.title").alias("title"), F.coalesce("new.priority", "old.priority").alias("priority"),
        F.coalesce("old.status", F.lit("active")).alias("status"), F.coalesce("old.detected_at", F.lit(as_of).cast("timestamp")).alias("detected_at"),
    )


def corpus_gaps(keywords: DataFrame, notes: DataFrame, k: int = 10, most: int = 6) -> DataFrame:
    """keywords: note_id, term. What two notes or more mention, of the k commonest terms, and a note doesn't: its gaps, most first."""
    common = keywords.groupBy("term").agg(F.countDistinct("note_id").alias("n_notes")).where("n_notes >= 2").orderBy(F.desc("n_notes"), "term").limit(k)
    every = notes.select("note_id").distinct().join(F.broadcast(common))  # k rows at most
    rank = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("n_notes"), "term"))
    return every.join(keywords.select("note_id", "term").distinct(), ["note_id", "term"], "left_anti").withColumn("rank", rank).where(F.col("rank") <= most)


# What a topic needs.
TOPIC_NEEDS = {
    "neural networks": ("gradient descent", "backpropagation", "activation function", "loss function"),
    "machine learning": ("training data", "loss function", "overfitting", "gradient descent"),
    "regression": ("loss function", "feature", "prediction"),
    "statistics": ("probability", "mean", "variance"),
    "probability": ("distribution", "random variable", "expectation"),
    "calculus": ("derivative", "chain rule", "gradient"),
    "database": ("normalization", "index", "transaction"),
    "operating system": ("process", "thread", "memory"),
    "reinforcement learning": ("reward", "policy", "value function"),
    "linear algebra": ("matrix", "vector", "eigenvalue"),
}


def mapped_gaps(notes: DataFrame, needs: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """notes: note_id, text. Needs of a note's topics that it doesn't mention but other notes do, and how many do."""
    needs = TOPIC_NEEDS if needs is None else needs
    wanted = sorted({n for v in needs.values() for n in v})

    # both lists are fixed ones, so a note's topics and words are found within its row
    def found(text: str) -> list[tuple]:
        lower = text.lower()
        has = dict.fromkeys(n for n in wanted if n in lower)
        return [(None, n) for n in has] + [(t, n) for t, v in needs.items() if t in lower for n in v if n not in has]

    rows = keep(from_text(notes.select(F.col("note_id").alias("doc_id"), "text"), F.col("text"), found, "topic string, need string").withColumnRenamed("doc_id", "note_id"))
    counts = rows.where("topic is null").groupBy("need").agg(F.count("*").alias("n_notes"))
    return rows.where("topic is not null").join(F.broadcast(counts), "need").select("note_id", "topic", "need", "n_notes")  # as many rows as needs are listed, at most


def dedupe_gaps(gaps: DataFrame) -> DataFrame:
    """gaps: note_id, title, priority. The most urgent of each key."""
    keyed = gaps.withColumn("key", fn.norm_key(F.col("title"))).where("key <> ''")
    return keyed.groupBy("note_id", "key").agg(F.max_by(F.struct("title", "priority"), F.struct("priority", "title")).alias("g")).select("note_id", "key", "g.*")


# From where a concept to practise is taken first.
PICK_ORDER = ("gap", "confusing", "weak", "lowMastery", "recommended", "manual")


def practice_pick(candidates: DataFrame) -> DataFrame:
    """candidates: learner_id, source, concept_id, score. One concept for each learner: by source, then score, then id."""
    rank = F.array_position(F.array(*map(F.lit, PICK_ORDER)), F.col("source"))
    best = F.min_by(F.struct("source", "concept_id"), F.struct(rank, -F.col("score"), "concept_id"))
    return candidates.where(rank > 0).groupBy("learner_id").agg(best.alias("b")).select("learner_id", "b.*")


def practice_sessions(answers: DataFrame) -> DataFrame:
    """answers: session_id, nth, result. Complete with the first correct answer, or with the second one whatever it is; else a follow-up."""
    ends = F.least(F.min(F.when(F.col("result") == "correct", F.col("nth"))), F.min(F.when(F.col("place") >= 2, F.col("nth"))))
    placed = answers.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("nth")))
    done = placed.groupBy("session_id").agg(ends.alias("ends"), F.count("*").alias("n"))
    return done.select("session_id", F.when(F.col("ends").isNotNull(), "complete").otherwise("followUp").alias("state"), "ends", "n")
