"""The driver's tables in the roles of notes, reviews, signals and graphs; each rule as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 12:00:00"
_OUTCOMES = {"purchase": "correct", "signup": "easy", "click": "partial", "view": "hard", "error": "incorrect"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "correct").when(kind == "signup", "easy").when(kind == "click", "partial").when(kind == "view", "hard").otherwise("incorrect")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("concept_id"), (F.col("user_id") % 10).alias("note_id"), outcome.alias("outcome"), "value")


REVIEWS = """reviews AS (SELECT event_id, ts::timestamp AS ts, user_id AS concept_id, user_id % 10 AS note_id,
  CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'signup' THEN 'easy' WHEN 'click' THEN 'partial' WHEN 'view' THEN 'hard' ELSE 'incorrect' END AS outcome, value FROM events)"""


def _case(steps: dict[str, float]) -> str:
    return "CASE outcome " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in steps.items()) + " END::double"


def fold_sql(steps: dict[str, float], start: float, lo: float = 0.0, hi: float = 1.0) -> str:
    """An aggregate over rows with outcome, ts and event_id."""
    return f"list_reduce(list_prepend({start}::double, list({_case(steps)} ORDER BY ts, event_id)), lambda a, x: greatest({lo}::double, least({hi}::double, a + x)))"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.operators.learner import fold_reviews

    return fold_reviews(reviews(spark, sf_dir))


def states_sql() -> str:
    from studyloom.operators.learner import CONFIDENCE_STEP, MASTERY_STEP, START_CONFIDENCE, START_MASTERY

    return f"""{REVIEWS}, states AS (SELECT note_id, concept_id, {fold_sql(MASTERY_STEP, START_MASTERY)} AS mastery, {fold_sql(CONFIDENCE_STEP, START_CONFIDENCE)} AS confidence,
  count(*) AS review_count, count(*) FILTER (outcome = 'incorrect') AS mistake_count, max(ts) AS last_reviewed FROM reviews GROUP BY note_id, concept_id)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REQUIRES p -> p/2 and PART_OF p -> p/3; edge_id is unique."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), (F.lit(0.3) + (F.col("p_partkey") % 7) / 10.0).alias("confidence"))
    one = p.where("p >= 2").select((F.col("p") * 2).alias("edge_id"), F.col("p").alias("source_id"), F.floor(F.col("p") / 2).alias("target_id"), F.lit("REQUIRES").alias("relation"), "confidence")
    two = p.where("p >= 3").select((F.col("p") * 2 + 1).alias("edge_id"), F.col("p").alias("source_id"), F.floor(F.col("p") / 3).alias("target_id"), F.lit("PART_OF").alias("relation"), "confidence")
    return one.unionByName(two)


EDGES = """edges AS (SELECT p_partkey * 2 AS edge_id, p_partkey AS source_id, p_partkey // 2 AS target_id, 'REQUIRES' AS relation, 0.3::double + (p_partkey % 7) / 10.0::double AS confidence FROM part WHERE p_partkey >= 2
  UNION ALL SELECT p_partkey * 2 + 1, p_partkey, p_partkey // 3, 'PART_OF', 0.3::double + (p_partkey % 7) / 10.0::double FROM part WHERE p_partkey >= 3)"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"))


def mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: a fixed spread of mastery and mistakes, for the graph's operators."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p.alias("concept_id"), ((p * 37 % 100) / 100.0).alias("mastery"), (p % 4).alias("mistake_count"))


MASTERY = "mastery AS (SELECT p_partkey AS concept_id, (p_partkey * 37 % 100) / 100.0::double AS mastery, p_partkey % 4 AS mistake_count FROM part)"
