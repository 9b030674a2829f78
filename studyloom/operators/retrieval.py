"""Retrieval around a graph: query terms, expansion, re-ranking, order and citations of hits, grading of answers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from studyloom.functions import text as fn
from studyloom.operators.graph import traverse
from studyloom.sources.store import keep

# What the kind of a hit and where it comes from add to its score.
KIND_BOOST = {"note": 0.08, "chunk": 0.12, "concept": 0.16}
BASE = {"lexical": 1.0, "graph": 0.86, "vector": 0.5}
DIMENSION, PAIR_WEIGHT = 384, 0.75


def _lookup(c: Column, values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, v in values.items():
        out = F.when(c == name, v).otherwise(out)
    return out


def query_terms(queries: DataFrame) -> DataFrame:
    """queries: query_id, query. The whole text, its words, and its runs of two and three words, each once."""
    w = F.filter(F.split(fn.norm_key(F.col("query")), " "), lambda x: x != "")

    def runs(n: int) -> Column:
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))

    rows = queries.select("query_id", w.alias("w")).where(F.size("w") > 0)
    return rows.select("query_id", F.explode(F.array_distinct(F.concat(F.array(F.array_join("w", " ")), F.col("w"), runs(2), runs(3)))).alias("term"))


def expand(seeds: DataFrame, edges: DataFrame, depth: int = 4, per_hop: int = 8, most: int = 64) -> DataFrame:
    """seeds: query_id, node. Each hop takes a node's most confident edges out and in; the nearest and most confident nodes stay.

    query_id, node, distance, confidence (of the best edge that reached it; 1 for a seed).
    """

    def ranked(a: str, b: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(a).orderBy(F.desc("confidence"), "edge_id"))
        return edges.withColumn("n", rank).where(F.col("n") <= per_hop).select(F.col(a).alias("node"), F.col(b).alias("next"), "confidence")

    steps = keep(ranked("source_id", "target_id").unionByName(ranked("target_id", "source_id")).groupBy("node", "next").agg(F.max("confidence").alias("confidence")))
    front = seeds.select("query_id", "node").distinct().withColumn("distance", F.lit(0)).withColumn("confidence", F.lit(1.0))
    seen = front
    for level in range(1, depth + 1):
        nxt = front.select("query_id", "node").join(steps, "node").groupBy("query_id", F.col("next").alias("node")).agg(F.max("confidence").alias("confidence"))
        front = keep(nxt.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").select("query_id", "node", F.lit(level).alias("distance"), "confidence"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.desc("confidence"), "node"))
    return seen.withColumn("rank", rank).where(F.col("rank") <= most)


def rerank(hits: DataFrame, queries: DataFrame, mastery: DataFrame, k: int) -> DataFrame:
    """hits: query_id, hit_id, origin, kind, title, content, n_sources, relation_id, concept_id, relevance. Best first, by query."""
    words = F.array_distinct(F.filter(F.split(fn.norm_key(F.col("query")), " "), lambda x: x != ""))
    df = hits.join(queries.select("query_id", words.alias("words"), fn.norm_key(F.col("query")).alias("q")), "query_id").join(mastery.select("concept_id", "mastery"), "concept_id", "left")
    title, content = F.lower(F.trim("title")), F.lower(F.trim("content"))
    space = F.concat_ws(" ", title, content)
    score = (
        F.col("relevance") / (F.abs("relevance") + 1.0)
        + _lookup(F.col("origin"), BASE)
        + F.least(F.lit(0.12), F.col("n_sources") * 0.04)
        + F.when(F.col("relation_id").isNull(), 0.0).otherwise(0.08)
        + _lookup(F.col("kind"), KIND_BOOST)
        + F.when(F.exists("words", lambda w: space.contains(w)), 0.08).otherwise(0.0)
        + F.when((F.col("kind") == "note") & (F.col("q") != "") & (title.contains(F.col("q")) | content.contains(F.col("q"))), 3.0).otherwise(0.0)
        + F.when(F.col("kind").isin("concept", "chunk"), (1.0 - F.coalesce("mastery", F.lit(0.5))) * 0.1).otherwise(0.0)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "kind", F.lower("title"), "hit_id"))
    return df.select("query_id", "hit_id", "kind", "title", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).drop("title")


def final_order(hits: DataFrame, note_id: Column | None = None) -> DataFrame:
    """hits: query_id, hit_id, kind, note_id, score, updated_at. Notes that match come first, then by score and recency; one note's, if asked."""
    rows = hits if note_id is None else hits.where(F.col("note_id") == note_id)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("kind") == "note").desc(), F.round("score", 9).desc(), F.col("updated_at").desc_nulls_last(), "hit_id"))
    return rows.withColumn("rank", rank)


def citations(hits: DataFrame) -> DataFrame:
    """hits: query_id, hit_id, sources (array of kind, id, title, snippet). The first source of each."""
    return hits.where(F.size("sources") > 0).select("query_id", "hit_id", F.element_at("sources", 1).alias("s")).select("query_id", "hit_id", "s.*")


def node_attributes(concepts: DataFrame, edges: DataFrame, learner: DataFrame) -> DataFrame:
    """concepts: concept_id, confidence. learner: concept_id, mastery, retention. Importance, difficulty, mastery, risk and edges of each node."""
    ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("concept_id"))
    degree = ends.groupBy("concept_id").agg(F.count("*").alias("n_edges"))
    df = concepts.join(degree, "concept_id", "left").join(learner, "concept_id", "left").fillna(0, ["n_edges"]).fillna(0.5, ["mastery", "retention"])
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    risk = F.when(F.col("retention") < 0.35, "High Risk").when(F.col("retention") < 0.65, "Medium Risk").otherwise("Low Risk")
    return df.select("concept_id", clamp(F.col("confidence") + F.least(F.lit(0.3), F.col("n_edges") * 0.04)).alias("importance"), clamp(1.0 - F.col("mastery")).alias("difficulty"), "mastery", "retention", risk.alias("risk"), "n_edges")


def filter_graph(nodes: DataFrame, edges: DataFrame, condition: Column, least_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The nodes (concept_id ...) that meet a condition, and the edges between them that are confident enough."""
    kept = nodes.where(condition)
    ids = kept.select("concept_id").distinct()
    inside = edges.where(F.col("confidence") >= least_confidence).join(ids.withColumnRenamed("concept_id", "source_id"), "source_id", "left_semi")
    return kept, inside.join(ids.withColumnRenamed("concept_id", "target_id"), "target_id", "left_semi")


def concept_tree(concepts: DataFrame, edges: DataFrame, n_roots: int = 5, depth: int = 8) -> DataFrame:
    """root, node, distance: what the first concepts without an edge to them lead to; the names' order says which are first."""
    into = edges.where("source_id <> target_id").select(F.col("target_id").alias("concept_id")).distinct()
    roots = concepts.join(into, "concept_id", "left_anti").orderBy(F.lower("name"), "name", "concept_id").limit(n_roots).select("concept_id")
    return traverse(edges, roots, "out", depth).withColumnRenamed("seed", "root")


def note_graph(note_concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """note_concepts: note_id, concept_id, confidence. Concepts and edges of each note, each ranked by confidence: note_id, kind, id, rank."""
    side = lambda c: note_concepts.select("note_id", F.col("concept_id").alias(c)).distinct()
    inside = edges.select("edge_id", "source_id", "target_id", "confidence").join(side("source_id"), "source_id").join(side("target_id"), ["note_id", "target_id"])
    rows = note_concepts.select("note_id", F.lit("concept").alias("kind"), F.col("concept_id").alias("id"), "confidence").unionByName(inside.select("note_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "confidence"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("note_id", "kind").orderBy(F.desc("confidence"), "id"))).drop("confidence")


def graph_rerank(items: DataFrame, edges: DataFrame, mastery: DataFrame) -> DataFrame:
    """items: concept_id, importance. edges: prerequisites among others (source needs target). Importance by links, weak needs and weak bases."""
    known = mastery.select("concept_id", "mastery")
    degree = edges.select(F.explode(F.array("source_id", "target_id")).alias("concept_id")).groupBy("concept_id").agg(F.count("*").alias("n_edges"))
    pre = edges.where(F.lower("relation").contains("require") | F.lower("relation").contains("depend") | F.lower("relation").contains("prereq"))
    weak = pre.join(known.withColumnRenamed("concept_id", "target_id"), "target_id", "left").where(F.coalesce("mastery", F.lit(0.5)) < 0.5).select(F.col("source_id").alias("concept_id")).distinct().withColumn("weak_need", F.lit(True))
    base = pre.select(F.col("target_id").alias("concept_id")).distinct().withColumn("is_base", F.lit(True))
    df = items.join(degree, "concept_id", "left").join(known, "concept_id", "left").join(weak, "concept_id", "left").join(base, "concept_id", "left")
    plus = F.least(F.lit(0.18), F.coalesce("n_edges", F.lit(0)) * 0.03) + F.when(F.col("is_base") & (F.coalesce("mastery", F.lit(0.5)) < 0.65), 0.14).otherwise(0.0) - F.when(F.col("weak_need"), 0.18).otherwise(0.0)
    return df.select("concept_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("importance") + plus)).alias("importance"))


def xx_bucket(term: Column, dimension: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(dimension)).cast("int")


def _md5_buckets(terms: Iterable[bytes], dimension: int) -> np.ndarray:
    """By a hash that other engines have, too: the first seven hex digits, of many terms at once."""
    return (np.frombuffer(b"".join([md5(t).digest() for t in terms]), ">u4")[::4] >> 4).astype(np.int64) % dimension


def _unit(words: np.ndarray, pairs: np.ndarray, dimension: int) -> np.ndarray:
    """Weighted counts of the buckets of words and of pairs, of unit length; zeros without words."""
    v = np.bincount(words, minlength=dimension) + PAIR_WEIGHT * np.bincount(pairs, minlength=dimension)
    return v / (np.sqrt((v * v).sum()) or 1.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unit_counts(buckets: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for words, pairs, dimension in buckets:
        yield pd.Series([_unit(*x) for x in zip(words, pairs, dimension, strict=True)])


def _by_md5(dimension: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embedded(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in keys:
            out = []
            for key in series:
                w = key.encode().split()
                out.append(_unit(_md5_buckets(w, dimension), _md5_buckets(map(b" ".join, zip(w, w[1:], strict=False)), dimension), dimension))
            yield pd.Series(out)

    return embedded


def hashed_embedding(docs: DataFrame, dimension: int = DIMENSION, hashed: str = "xxhash64") -> DataFrame:
    """docs: doc_id, text. Words count 1 and pairs .75 in their buckets; unit length, zeros without words. A document stays in its row.

    hashed: xxhash64, which Spark has, or md5, which other engines have as well.
    """
    key = fn.norm_key(F.coalesce("text", F.lit("")))
    if hashed == "md5":
        return docs.select("doc_id", _by_md5(dimension)(key).alias("embedding"))
    rows = docs.select("doc_id", F.filter(F.split(key, " "), lambda x: x != "").alias("w")).withColumn("most", F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.col("most")), F.slice("w", F.lit(2), F.col("most")), lambda a, b: F.concat(a, F.lit(" "), b))
    buckets = [F.transform(terms, lambda x: xx_bucket(x, dimension)) for terms in (F.col("w"), pairs)]
    return rows.select("doc_id", _unit_counts(*buckets, F.lit(dimension)).alias("embedding"))


@F.pandas_udf(T.DoubleType())
def _dot(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, y in pairs:
        yield pd.Series([float(np.dot(a, b)) for a, b in zip(x, y, strict=True)], dtype="float64")


def embedding_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: doc_id, embedding (unit length or zeros). Cosine of those of equal ids."""
    both = a.select("doc_id", "embedding").join(b.select("doc_id", F.col("embedding").alias("other")), "doc_id")
    return both.select("doc_id", _dot("embedding", "other").alias("similarity"))


def text_similarity(a: DataFrame, b: DataFrame, hashed: str = "xxhash64") -> DataFrame:
    """a, b: doc_id, text. Cosine of the hashed embeddings of equal ids, 0 where one has no words."""
    return embedding_similarity(hashed_embedding(a, DIMENSION, hashed), hashed_embedding(b, DIMENSION, hashed))


def grade_answers(df: DataFrame) -> DataFrame:
    """df: answer_id, answer, expected, keywords (array), similarity. grade, score and keyword_overlap."""
    a, e = fn.norm_key(F.coalesce("answer", F.lit(""))), fn.norm_key(F.coalesce("expected", F.lit("")))
    keys = F.filter(F.transform("keywords", fn.norm_key), lambda k: k != "")
    overlap = F.when(F.size(keys) > 0, F.size(F.filter(keys, lambda k: a.contains(k))) / F.size(keys)).otherwise(0.0)
    exact, best = (a != "") & (a == e), F.greatest(F.col("similarity"), F.col("keyword_overlap"))
    graded = df.select("answer_id", exact.alias("exact"), "similarity", overlap.alias("keyword_overlap"))
    steps = [(F.col("exact") | (best >= 0.9), "correct", 1.0), (best >= 0.75, "mostlyCorrect", 0.85), (best >= 0.6, "partialUnderstanding", 0.7), (F.col("keyword_overlap") >= 0.5, "partialUnderstanding", 0.6)]
    grade, score = F.lit("incorrect"), F.lit(0.0)
    for c, g, s in reversed(steps):
        grade, score = F.when(c, g).otherwise(grade), F.when(c, s).otherwise(score)
    return graded.select("answer_id", grade.alias("grade"), score.alias("score"), F.when(F.col("exact"), 1.0).otherwise(F.col("keyword_overlap")).alias("keyword_overlap"))
