"""Scores of evaluation runs: records (run, note_id, category, score, latency, parsed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import text as fn

ALERT = -0.05


def run_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("run").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("latency").alias("latency"))


def rank_runs(summary: DataFrame) -> DataFrame:
    """By quality, then speed, then name; the runs are few."""
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "latency", "run")))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: note_id, score. Change by note of a; null where b lacks it."""
    return a.join(b.select("note_id", F.col("score").alias("other")), "note_id", "left").select("note_id", (F.col("other") - F.col("score")).alias("delta"), (F.col("other") != F.col("score")).alias("changed"))


def regressions(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """One row each; metric, baseline, comparison, delta, alert."""
    pairs = a.select(*[F.col(m).alias(f"a_{m}") for m in metrics]).crossJoin(b.select(*[F.col(m).alias(f"b_{m}") for m in metrics]))  # single rows
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("baseline"), F.col(f"b_{m}").alias("comparison")) for m in metrics]))
    return pairs.select(rows.alias("r")).select("r.*").withColumn("delta", F.col("comparison") - F.col("baseline")).withColumn("alert", F.col("delta") < ALERT)


def weaknesses(records: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """feature, n for the features with records beyond their limit."""
    one = records.agg(*[F.count_if(c).alias(k) for k, c in limits.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("n")) for k in limits]))
    return one.select(rows.alias("r")).select("r.*").where("n > 0")


def model_comparison(records: DataFrame) -> DataFrame:
    return records.groupBy("category", "run").agg(F.avg(F.col("parsed").cast("double")).alias("parse_rate"), F.avg("latency").alias("latency"), F.count_if(~F.col("parsed")).alias("failures"))


def recommend_model(records: DataFrame, grounded: str, bonus: float = 0.1) -> DataFrame:
    """The run with the best parse rate, with a bonus if it parsed any grounded record."""
    s = records.groupBy("run").agg((F.avg(F.col("parsed").cast("double")) + F.when(F.count_if((F.col("category") == grounded) & F.col("parsed")) > 0, bonus).otherwise(0.0)).alias("score"))
    return s.agg(F.max_by("run", F.struct(F.round("score", 9), "run")).alias("run"), F.max("score").alias("score"))


def throughput(chars: Column, seconds: Column) -> Column:
    """Tokens a second, at four characters a token."""
    return F.when(seconds > 0, chars / 4.0 / seconds).otherwise(0.0)


# --- scores of generated study material ---------------------------------------------------

# The ideal length of an answer and the score of a number of options.
ANSWER_IDEAL, ANSWER_SPREAD = 110, 140.0


def _mean(*parts: Column) -> Column:
    return sum(parts[1:], parts[0]) / float(len(parts))


def keyword_coverage(text: Column, keywords: Column) -> Column:
    """Share of the keywords (an array) that the normalised text contains; 0 without keywords."""
    plain = fn.norm_key(text)
    hits = F.size(F.filter(keywords, lambda k: plain.contains(fn.norm_key(k))))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(0.0)


def score_summaries(df: DataFrame) -> DataFrame:
    """df: note_id, summary, keywords (array), n_raw (characters of the note). Five parts and their mean."""
    s = fn.sentence_array(F.col("summary"))
    ideal = F.greatest(F.lit(80), F.least(F.lit(360), F.floor(F.col("n_raw") / 3)))
    repeated = F.when(F.size(s) == 0, 0.0).otherwise(1.0 - F.size(F.array_distinct(F.transform(s, fn.norm_key))) / F.size(s))
    mean = F.aggregate(s, F.lit(0), lambda a, x: a + fn.n_words(x)) / F.size(s)
    lines = F.split("summary", "\n", -1)
    marked = F.size(F.filter(lines, lambda x: F.trim(x).rlike("^[#*-]")))
    parts = {
        "coverage": keyword_coverage(F.col("summary"), F.col("keywords")),
        "repetition": 1.0 - repeated,
        "readability": F.when(F.size(s) == 0, 0.5).otherwise(1.0 - F.least(F.lit(1.0), F.abs(mean - 16.0) / 24.0)),
        "length": 1.0 - F.least(F.lit(1.0), F.abs(F.length("summary") - ideal) / ideal),
        "structure": F.least(F.lit(1.0), (marked + 1) / (F.size(lines) + 1)),
    }
    scored = df.select("note_id", *[c.alias(n) for n, c in parts.items()])
    return scored.withColumn("overall", _mean(*[F.col(n) for n in parts]))


def answer_length_score(text: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(F.length(F.trim(text)) - ANSWER_IDEAL) / ANSWER_SPREAD))


def specificity(text: Column) -> Column:
    """Half for a number, half for more than five words."""
    n = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    return (text.rlike(r"\p{N}").cast("int") + (n > 5).cast("int")) / 2.0


def option_count_score(n: Column) -> Column:
    return F.when(n == 4, 1.0).when(n.isin(3, 5), 0.8).when(n.isin(2, 6), 0.6).otherwise(0.2)


def _coverage(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """texts: note_id, text. keywords: note_id, keyword. note_id and coverage of each note with keywords."""
    hit = fn.norm_key(F.col("text")).contains(fn.norm_key(F.col("keyword")))
    return keywords.join(texts, "note_id").groupBy("note_id").agg(F.avg(hit.cast("double")).alias("coverage"))


def _joined(rows: str, *fields: str) -> Column:
    """Fields of an array of structs, all of the first before all of the second, with spaces."""
    return F.concat_ws(" ", *[F.array_join(F.col(rows)[f], " ") for f in fields])


def score_flashcards(cards: DataFrame, keywords: DataFrame) -> DataFrame:
    """cards: note_id, card_id, front, back."""
    rows = F.array_sort(F.collect_list(F.struct("card_id", "front", "back"))).alias("rows")
    unique = F.countDistinct(fn.norm_key(F.col("front"))) / F.count("*")
    notes = cards.groupBy("note_id").agg(unique.alias("uniqueness"), F.avg(answer_length_score(F.col("back"))).alias("answer_length"), F.avg(specificity(F.col("back"))).alias("specificity"), rows)
    covered = _coverage(notes.select("note_id", _joined("rows", "front", "back").alias("text")), keywords)
    df = notes.drop("rows").join(covered, "note_id", "left").fillna(0.0, ["coverage"])
    return df.withColumn("overall", _mean(*[F.col(c) for c in ("uniqueness", "answer_length", "coverage", "specificity")]))


def score_quizzes(quiz: DataFrame, keywords: DataFrame) -> DataFrame:
    """quiz: note_id, question_id, prompt, explanation, answer, options (array)."""
    given = lambda c: F.avg((F.trim(c) != "").cast("double"))
    rows = F.array_sort(F.collect_list(F.struct("question_id", "prompt", F.array_join("options", " ").alias("options")))).alias("rows")
    notes = quiz.groupBy("note_id").agg((F.countDistinct(fn.norm_key(F.col("prompt"))) / F.count("*")).alias("uniqueness"), given("explanation").alias("explanations"), F.avg(option_count_score(F.size("options"))).alias("option_count"), given("answer").alias("answers"), rows)
    covered = _coverage(notes.select("note_id", _joined("rows", "prompt", "options").alias("text")), keywords)
    df = notes.drop("rows").join(covered, "note_id", "left").fillna(0.0, ["coverage"])
    return df.withColumn("overall", _mean(*[F.col(c) for c in ("uniqueness", "explanations", "option_count", "answers", "coverage")]))


def score_maps(nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """nodes: note_id, node_id, parent_id (null for a root), title. expected: note_id, n_relationships, n_terms."""
    inner = nodes.where("parent_id is not null").select("note_id", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    root = F.col("parent_id").isNull()
    roots = nodes.where(root).select("note_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("under_root"))
    df = nodes.join(inner, ["note_id", "node_id"], "left").join(roots, ["note_id", "parent_id"], "left")
    notes = df.groupBy("note_id").agg(F.count("*").alias("n"), F.countDistinct(fn.norm_key(F.col("title"))).alias("titles"), F.count_if(F.col("inner").isNull()).alias("leaves"), F.count_if(root).alias("roots"), F.count_if(F.col("under_root").isNotNull()).alias("children"))
    df = notes.join(expected, "note_id", "left").fillna(0, ["n_relationships", "n_terms"])
    most = lambda c: F.greatest(F.lit(0.0), c)
    df = df.select(
        "note_id",
        most((F.col("leaves") - F.col("n_relationships")) / F.greatest(F.lit(1), F.col("leaves"))).alias("disconnected"),
        F.when(F.col("n_relationships") == 0, 0.5).otherwise(most(1.0 - F.col("n") / F.greatest(F.lit(1), F.col("n_terms")))).alias("missing"),
        (1.0 - F.col("titles") / F.col("n")).alias("duplication"),
        F.least(F.lit(1.0), (F.col("children") + F.col("roots")) / (F.col("roots") * 3)).alias("hierarchy"),
    )
    return df.withColumn("overall", _mean(1.0 - F.col("disconnected"), 1.0 - F.col("missing"), 1.0 - F.col("duplication"), F.col("hierarchy")))


def score_insights(df: DataFrame) -> DataFrame:
    """df: note_id, text, keywords (array), n_gaps."""
    s = fn.sentence_array(F.col("text"))
    unique = F.when(F.size(s) == 0, 1.0).otherwise(F.size(F.array_distinct(F.transform(s, fn.norm_key))) / F.size(s))
    missing = F.when(F.size("keywords") > 0, 1.0 - keyword_coverage(F.col("text"), F.col("keywords"))).otherwise(0.0)
    df = df.select("note_id", missing.alias("missing"), unique.alias("repetition"), F.when(F.col("n_gaps") == 0, 0.35).otherwise(F.least(F.lit(1.0), F.col("n_gaps") / 4.0)).alias("actionability"))
    return df.withColumn("overall", _mean(1.0 - F.col("missing"), F.col("repetition"), F.col("actionability")))


def score_payloads(df: DataFrame, parts: list[str]) -> DataFrame:
    """df: note_id, titles (of its concepts) and a count for each part. Parsed, valid and complete (six parts are enough)."""
    filled = sum((F.coalesce(F.col(p) > 0, F.lit(False)).cast("int") for p in parts), F.lit(0))
    df = df.select("note_id", F.when(filled > 0, 1.0).otherwise(0.0).alias("parsed"), F.when(F.forall("titles", lambda t: t != ""), 1.0).otherwise(0.0).alias("valid"), F.least(F.lit(1.0), filled / 6.0).alias("completeness"))
    return df.withColumn("overall", _mean(*[F.col(c) for c in ("parsed", "valid", "completeness")]))


def score_vs_gold(outputs: DataFrame, gold: DataFrame, fields: list[str]) -> DataFrame:
    """Token overlap of each field with the reference's, and the mean; notes without a reference are left out."""
    both = outputs.join(gold.select("note_id", *[F.col(f).alias(f"gold_{f}") for f in fields]), "note_id")
    df = both.select("note_id", *[fn.max_overlap(F.coalesce(f, F.lit("")), F.coalesce(f"gold_{f}", F.lit(""))).alias(f) for f in fields])
    return df.withColumn("overall", _mean(*[F.col(f) for f in fields]))


def combined(df: DataFrame) -> DataFrame:
    """df: note_id, heuristic, gold (null without a reference), seconds, memory_mb, hallucinations. Weighted score and signals."""
    gold = F.coalesce("gold", "heuristic")
    # Names of signals, and from what they are given.
    signals = F.array_compact(
        F.array(
            F.when(F.col("heuristic") >= 0.8, "strong_heuristic_performance").otherwise("heuristic_coverage_needs_work"),
            F.when(gold >= 0.8, "strong_gold_standard_alignment").otherwise("gold_standard_alignment_gap"),
            F.when(F.col("seconds") > 0, F.when(F.col("seconds") > 2, "slow_generation").otherwise("fast_generation")),
            F.when(F.col("memory_mb") > 0, F.when(F.col("memory_mb") > 1500, "high_memory_usage").otherwise("moderate_memory_usage")),
            F.when(F.col("hallucinations") > 0, "hallucinations_detected"),
        )
    )
    return df.select("note_id", (F.col("heuristic") * 0.7 + gold * 0.3).alias("overall"), signals.alias("signals"))


def diff_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: identifier, system_prompt, output_description. Those in both whose hashes differ, and which field changed."""

    def hashed(df: DataFrame, name: str) -> DataFrame:
        one = df.groupBy("identifier").agg(F.min(F.struct("system_prompt", "output_description")).alias(name))
        return one.withColumn(f"{name}_hash", F.sha2(F.concat_ws("\n", f"{name}.system_prompt", f"{name}.output_description"), 256))

    both = hashed(a, "baseline").join(hashed(b, "comparison"), "identifier").where("baseline_hash <> comparison_hash")
    changed = F.array_compact(F.array(*[F.when(F.col(f"baseline.{c}") != F.col(f"comparison.{c}"), F.lit(c)) for c in ("system_prompt", "output_description")]))
    return both.select("identifier", "baseline_hash", "comparison_hash", F.array_join(changed, ",").alias("changed"))


def extraction_counts(expected: DataFrame, **found: DataFrame) -> DataFrame:
    """expected: file. A count by file of each table, and whether the file has none of them."""
    df = expected.select("file").distinct()
    for name, rows in found.items():
        df = df.join(rows.groupBy("file").agg(F.count("*").alias(name)), "file", "left").fillna(0, [name])
    return df.withColumn("failed", sum((F.col(n) for n in found), F.lit(0)) == 0)
