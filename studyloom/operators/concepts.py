"""Rule-based scores of concepts, relationships and coverage; token mentions of concepts in sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import text as fn

# Cue phrases by kind of relationship; the first kind with a cue wins.
RELATION_CUES = {
    "exampleOf": ("example of", "for example"),
    "comparesTo": ("compared to", "compares to", "versus"),
    "causes": ("causes", "leads to", "results in", "triggers"),
    "partOf": ("part of",),
    "contains": ("contains", "includes"),
    "requires": ("requires", "depends on", "depends upon"),
    "uses": ("uses", "utilizes"),
    "produces": ("produces", "generates", "creates"),
}
NGRAM = 6


def relation_kind(sentence: Column) -> Column:
    out = F.lit("relatedTo")
    for kind, cues in reversed(RELATION_CUES.items()):
        hit = F.lit(False)
        for cue in cues:
            hit = hit | sentence.contains(cue)
        out = F.when(hit, kind).otherwise(out)
    return out


def relation_confidence(sentence: Column, kind: Column, source_defined: Column, target_defined: Column) -> Column:
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    score = 0.52 + plus(F.lower(sentence).contains(F.lower(kind)), 0.12) + plus(source_defined, 0.08) + plus(target_defined, 0.08) - plus(kind == "relatedTo", 0.08)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.25), score))


def concept_importance(frequency: Column, in_heading: Column, in_notebook: Column) -> Column:
    return F.least(F.lit(1.0), 0.22 + frequency * 0.16 + F.when(in_heading, 0.18).otherwise(0.0) + F.when(in_notebook, 0.12).otherwise(0.0))


def concept_difficulty(name: Column, n_mentions: Column) -> Column:
    n = F.size(F.filter(F.split(fn.norm_key(name), " "), lambda w: w != ""))
    formula = name.contains("=") | name.contains("→") | name.contains("->")
    return F.least(F.lit(1.0), 0.2 + F.least(F.lit(0.35), n * 0.06) + F.when(formula, 0.2).otherwise(0.0) + F.when(n_mentions <= 1, 0.1).otherwise(0.0))


def concept_confidence(defined: Column, has_alias: Column, n_mentions: Column) -> Column:
    return F.least(F.lit(1.0), 0.38 + F.when(defined, 0.2).otherwise(0.0) + F.when(has_alias, 0.1).otherwise(0.0) + F.least(F.lit(0.3), n_mentions * 0.08))


def strategy(tokens: Column) -> Column:
    """Tier and concept limit by token count."""
    return F.when(tokens < 240, F.struct(F.lit("singlePass").alias("tier"), F.lit(18).alias("concept_limit"))).when(tokens < 900, F.struct(F.lit("mapReduce").alias("tier"), F.lit(28).alias("concept_limit"))).otherwise(F.struct(F.lit("hierarchical").alias("tier"), F.lit(36).alias("concept_limit")))


def _stem(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, "s$", ""))


def mentions(sentences: DataFrame, concepts: DataFrame) -> DataFrame:
    """doc_id, pos, concept_id, at: sentences (doc_id, pos, sentence) that name a concept (concept_id, name).

    Token windows of 1 to NGRAM words, plural tolerant, meet concepts by an equi-join; lengths
    that no concept has are never made. Longer names meet by their first NGRAM words, and the
    rest is compared where those stand.
    """
    key = F.array_join(_stem(F.split(fn.norm_key(F.col("name")), " ")), " ")
    named = concepts.select("concept_id", key.alias("gram")).where("gram <> ''").withColumn("n", F.size(F.split("gram", " ")))
    named = named.withColumn("head", F.array_join(F.slice(F.split("gram", " "), 1, NGRAM), " "))
    known = sorted(r.n for r in named.select(F.least("n", F.lit(NGRAM + 1)).alias("n")).distinct().collect())  # NGRAM + 1 values at most
    words = sentences.select("doc_id", "pos", _stem(F.split(fn.norm_key(F.col("sentence")), " ")).alias("w"))
    # the windows of all lengths from one reading; outer: else Spark makes the array twice, first for a filter on its size
    windows = F.flatten(F.array(*[_windows(n) for n in sorted({min(n, NGRAM) for n in known})])) if known else _windows(1)
    grams = words.select("doc_id", "pos", F.explode_outer(windows).alias("g")).where("g is not null").select("doc_id", "pos", "g.at", F.col("g.head").alias("head"))
    met = grams.join(named.select("concept_id", "gram", "head", "n"), "head")
    found = met.where(F.col("n") <= NGRAM).select("doc_id", "pos", "concept_id", "at")
    if known and known[-1] > NGRAM:
        whole = F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ") == F.col("gram")
        found = found.unionByName(met.where(F.col("n") > NGRAM).join(words, ["doc_id", "pos"]).where(whole).select("doc_id", "pos", "concept_id", "at"))
    return found.groupBy("doc_id", "pos", "concept_id").agg(F.min("at").alias("at"))


def _windows(n: int) -> Column:
    """Each n words of w in turn, with their place from 0."""
    head = lambda i: F.get(F.col("w"), i - 1) if n == 1 else F.array_join(F.slice(F.col("w"), i, n), " ")
    every = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct((i - 1).alias("at"), head(i).alias("head")))
    return F.when(F.size("w") >= n, every).otherwise(F.expr("cast(array() as array<struct<at: int, head: string>>)"))


def extract_relationships(found: DataFrame, sentences: DataFrame) -> DataFrame:
    """One edge by sentence, from the concept named first to the one named next, with its kind."""
    place = F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy("at", "concept_id"))
    ranked = found.withColumn("place", place).where("place <= 2")
    pair = ranked.groupBy("doc_id", "pos").agg(F.max(F.when(F.col("place") == 1, F.col("concept_id"))).alias("source_id"), F.max(F.when(F.col("place") == 2, F.col("concept_id"))).alias("target_id")).where("target_id is not null")
    return pair.join(sentences.select("doc_id", "pos", "sentence"), ["doc_id", "pos"]).select("doc_id", "pos", "source_id", "target_id", relation_kind(F.col("sentence")).alias("relation"))


def coverage_state(score: Column, detail: Column) -> Column:
    return F.when(score <= 0, "missing").when((score >= 0.75) & (detail >= 0.65), "covered").when((score >= 0.40) | (detail >= 0.35), "partial").otherwise("missing")


def completeness(df: DataFrame, key: str) -> DataFrame:
    """df: key, state, importance, visual. Covered and half of partial importance over all, less what pictures lack."""
    w = F.greatest(F.col("importance"), F.lit(0.1))
    concept = ~F.col("visual")
    part = lambda c, x: F.sum(F.when(c, w * x).otherwise(0.0))
    out = df.groupBy(key).agg(part(concept, 1.0).alias("total"), (part(concept & (F.col("state") == "covered"), 1.0) + part(concept & (F.col("state") == "partial"), 0.55) - part(F.col("visual"), 0.12)).alias("got"))
    return out.select(key, F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("got") / F.col("total")))).otherwise(0.0).alias("completeness"))


def missing_detail(source: Column, note: Column, stop: list[str] = fn.STOP_WORDS) -> Column:
    """The four longest words of the source that the note lacks; of equal length by the word."""
    w = lambda c: F.filter(F.split(fn.norm_key(c), " "), lambda x: x != "")
    lacking = F.array_except(w(source), F.array_union(w(note), F.array(*[F.lit(s) for s in stop])))
    keyed = F.array_sort(F.transform(lacking, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.array_join(F.slice(F.transform(keyed, lambda k: k["x"]), 1, 4), " ")


def is_subsequence(pattern: Column, text: Column) -> Column:
    """Whether the pattern's characters stand in the text in this order."""
    chars = F.filter(F.split(F.lower(pattern), ""), lambda c: c != "")
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"))

    def step(a: Column, c: Column) -> Column:
        hit = F.call_function("locate", c, F.lower(text), a["at"])
        return F.struct(F.when(a["ok"] & (hit > 0), hit + 1).otherwise(a["at"]).alias("at"), (a["ok"] & (hit > 0)).alias("ok"))

    return F.aggregate(chars, start, step, lambda a: a["ok"])


def label_score(query: Column, title: Column, subtitle: Column, keywords: Column) -> Column:
    """Phrase 40, prefix 30, and by term: title 18, subtitle 10, keywords 12, in order anywhere 6."""
    q, t, s, k = F.lower(F.trim(query)), F.lower(title), F.lower(subtitle), F.lower(keywords)
    space = F.concat_ws(" ", t, s, k)
    terms = F.filter(F.split(q, r"\s+"), lambda x: x != "")
    each = F.aggregate(terms, F.lit(0), lambda a, x: a + F.when(t.contains(x), 18).when(s.contains(x), 10).when(k.contains(x), 12).when(is_subsequence(x, space), 6).otherwise(0))
    return F.when(q == "", 1).otherwise(F.when(space.contains(q), 40).otherwise(0) + F.when(t.startswith(q), 30).otherwise(0) + each)
