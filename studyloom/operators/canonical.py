"""Canonical concepts: resolution of names and aliases, ids, mapping of relations, and checks of extracted tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from studyloom.functions import text as fn
from studyloom.operators.graph import components
from studyloom.sources.store import keep

# Relation names by what they mean, for the six types and for the nine kinds.
TYPES = {
    "DEPENDS_ON": ("prerequisite of", "prerequisite", "requires", "required by", "depends on", "depends upon", "depend on"),
    "PART_OF": ("part of", "contains", "includes", "component of", "member of"),
    "EXAMPLE_OF": ("example of", "for example", "example", "instance of"),
    "CAUSES": ("causes", "cause", "leads to", "results in", "triggers", "produces"),
    "RELATED_TO": ("related to", "related", "associated with", "linked to"),
}
TYPE_NAMES = (*TYPES, "PREREQUISITE_OF")
KINDS = {
    "requires": ("requires", "required", "requires to", "depends on", "depends upon"),
    "causes": ("causes", "cause", "leads to", "results in", "triggers"),
    "partOf": ("part of", "part_of"),
    "contains": ("contains", "contain", "includes", "include"),
    "exampleOf": ("example of", "example_of"),
    "comparesTo": ("compares to", "compared to", "versus"),
    "uses": ("uses", "utilizes", "utilises"),
    "produces": ("produces", "generates", "creates"),
}


def map_relation(c: Column, scheme: str = "type") -> Column:
    """A relation's type (null if it has none) or kind (relatedTo if it has none)."""
    plain = F.lower(F.trim(c))
    if scheme == "kind":
        out = F.lit("relatedTo")
        for name, words in KINDS.items():
            out = F.when(plain.isin(*words), name).otherwise(out)
        return out
    plain, exact = F.translate(plain, "_-", "  "), F.upper(F.trim(c))
    out = F.when(exact.isin(*TYPE_NAMES), exact)
    for name, words in TYPES.items():
        out = F.when(plain.isin(*words), name).otherwise(out)
    return out


def resolve_concepts(df: DataFrame) -> DataFrame:
    """df: concept_id (long), name, definition, confidence, importance, aliases. Concepts that share a name or alias key are one.

    Keys and concepts make a bipartite graph; its components, found by pointer jumping, are the
    concepts: the smallest id and its name, the longest definition, the highest scores, all aliases.
    """
    names = F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))
    keys = df.select("concept_id", F.explode(names).alias("n")).select("concept_id", fn.norm_key(F.col("n")).alias("key")).where("key <> ''").distinct()
    least = keys.groupBy("key").agg(F.min("concept_id").alias("target_id"))
    links = keys.join(least, "key").where("concept_id <> target_id").select(F.col("concept_id").alias("source_id"), "target_id", F.lit(0).alias("edge_id"), F.lit("same").alias("relation"), F.lit(1.0).alias("confidence"))
    labels = components(links)
    joined = df.join(labels, df.concept_id == labels.node, "left").withColumn("canonical_id", F.coalesce("label", "concept_id"))
    longest = F.max_by("definition", F.struct(F.length("definition"), "definition"))
    merged = joined.groupBy("canonical_id").agg(F.min_by("name", "concept_id").alias("name"), longest.alias("definition"), F.max("confidence").alias("confidence"), F.max("importance").alias("importance"), F.flatten(F.collect_set("aliases")).alias("aliases"), F.count("*").alias("n_merged"))
    return merged.withColumn("aliases", F.array_sort(F.array_distinct("aliases")))


def slug(c: Column, most: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ", "-"), 1, most)


def canonicalize(new: DataFrame, canon: DataFrame) -> DataFrame:
    """new: concept_id, name, aliases. canon: canonical_id (string), name, aliases. The id of each new concept.

    A known alias wins over a known name, then the smaller id. Others of one key are one new concept.
    It gets the slug of its name ("concept" where that is empty) if no canonical id and no other new
    concept has it: of several that would, the one with the smallest id does. The rest get -2, -3 ...,
    each the first that is free.
    """
    none = F.expr("cast(array() as array<string>)")
    kinds = lambda: F.concat(F.transform(F.coalesce("aliases", none), lambda a: F.struct(F.lit(0).alias("rank"), fn.norm_key(a).alias("key"))), F.array(F.struct(F.lit(1).alias("rank"), fn.norm_key(F.col("name")).alias("key"))))
    known = canon.select("canonical_id", F.explode(kinds()).alias("k")).select("canonical_id", "k.*").where("key <> ''")
    asked = new.select("concept_id", F.explode(kinds()).alias("k")).select("concept_id", F.col("k.key").alias("key")).distinct()
    hit = asked.join(known, "key").groupBy("concept_id").agg(F.min(F.struct("rank", "canonical_id")).alias("h")).select("concept_id", F.col("h.canonical_id").alias("known_id"))
    name = F.coalesce("name", F.lit(""))
    df = keep(new.select("concept_id", fn.norm_key(name).alias("key"), F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("concept")).alias("slug")).join(hit, "concept_id", "left"))
    fresh = df.where("known_id is null").groupBy("key").agg(F.min_by("slug", "concept_id").alias("slug"), F.min("concept_id").alias("first"))
    taken = canon.select(F.col("canonical_id").alias("slug")).distinct()
    heads = fresh.groupBy("slug").agg(F.min("first").alias("first")).join(taken, "slug", "left_anti")
    # numbers that canonical ids and bare slugs have taken already, by the slug before them
    numbered = lambda i: F.regexp_extract("slug", "^(.*)-([1-9][0-9]{0,8})$", i)
    used = taken.unionByName(heads.select("slug")).select(numbered(1).alias("slug"), numbered(2).alias("n")).where("n <> ''")
    used = used.groupBy("slug").agg(F.collect_set(F.col("n").cast("int")).alias("used"))
    rest = fresh.join(heads, ["slug", "first"], "left_anti")
    numbers = rest.groupBy("slug").agg(F.count("*").cast("int").alias("m")).join(used, "slug", "left").withColumn("used", F.coalesce("used", F.expr("cast(array() as array<int>)")))
    free = F.slice(F.array_except(F.sequence(F.lit(2), F.col("m") + F.size("used") + 1), "used"), F.lit(1), F.col("m"))
    numbers = numbers.select("slug", F.posexplode(free).alias("at", "n"))
    ranked = rest.withColumn("at", F.row_number().over(Window.partitionBy("slug").orderBy("first")) - 1)
    made = ranked.join(numbers, ["slug", "at"]).select("key", F.concat_ws("-", "slug", F.col("n").cast("string")).alias("made"))
    made = fresh.join(heads, ["slug", "first"], "left_semi").select("key", F.col("slug").alias("made")).unionByName(made)
    out = df.where("known_id is null").join(made, "key").select("concept_id", F.col("made").alias("canonical_id"), F.lit(True).alias("is_new"))
    return df.where("known_id is not null").select("concept_id", F.col("known_id").alias("canonical_id"), F.lit(False).alias("is_new")).unionByName(out)


def sanitize_extraction(concepts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """concepts: doc_id, key, name. edges: doc_id, source, target, relation. Clean tables, and rejects: doc_id, reason, n."""
    named = F.coalesce(F.trim("name") != "", F.lit(False))
    good = concepts.where(named)
    ids = good.select("doc_id", "key").distinct()
    side = lambda c: ids.select("doc_id", F.col("key").alias(c), F.lit(True).alias(f"has_{c}"))
    both = edges.join(side("source"), ["doc_id", "source"], "left").join(side("target"), ["doc_id", "target"], "left")
    reason = F.when(F.col("source") == F.col("target"), "self loop").when(F.col("has_source").isNull() | F.col("has_target").isNull(), "dangling").when(map_relation(F.col("relation")).isNull(), "unsupported relation")
    judged = both.withColumn("reason", reason)
    rejects = judged.where("reason is not null").groupBy("doc_id", "reason").agg(F.count("*").alias("n"))
    empty = concepts.where(~named).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("empty name").alias("reason"), "n")
    return good, judged.where("reason is null").select("doc_id", "source", "target", "relation"), rejects.unionByName(empty)


def validate_extraction(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """concepts: doc_id, key, definition, confidence. doc_id, rule, n: what is wrong with a document's tables."""
    count = lambda df, rule: df.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(rule).alias("rule"), "n")
    again = concepts.groupBy("doc_id", "key").count().where("count > 1")
    twice = edges.groupBy("doc_id", "source", "target", "relation").count().where("count > 1")
    ids = concepts.select("doc_id", "key").distinct()
    ends = edges.select("doc_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("key"))
    rules = [
        count(again, "duplicate concept"), count(twice, "duplicate relation"),
        count(concepts.where(F.coalesce(F.trim("definition") == "", F.lit(True))), "empty definition"),
        count(concepts.where("key is null or key = ''"), "missing id"),
        count(concepts.where(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), "confidence out of range"),
        count(ends.join(ids, ["doc_id", "key"], "left_anti"), "invalid reference"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def normalize_extraction(concepts: DataFrame, meaningful) -> DataFrame:
    """concepts: doc_id, name, definition, importance, confidence. Trimmed, scores in 0 to 1, one of each key, without dull terms, with ids."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    name = F.trim(F.regexp_replace("name", r"\s+", " "))
    rows = concepts.select("doc_id", name.alias("name"), F.trim(F.coalesce("definition", F.lit(""))).alias("definition"), clamp(F.col("importance")).alias("importance"), clamp(F.col("confidence")).alias("confidence"))
    rows = rows.where(meaningful(F.col("name"))).withColumn("key", fn.norm_key(F.col("name")))
    best = rows.groupBy("doc_id", "key").agg(F.max(F.struct("importance", "confidence", "name", "definition")).alias("b")).select("doc_id", "key", "b.*")
    return best.withColumn("concept_id", slug(F.col("name")))


def relation_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat_ws("-", F.lit("rel"), source, target, F.lower(kind))


def fact_id(c: Column) -> Column:
    return F.concat(F.lit("fact-"), slug(c, 48))


#: Texts longer than all but so many others are hashed alone from there on.
FEW = 16
# Fixed values of the hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a_of(texts: list[bytes]) -> list[int]:
    """All texts in step, byte position by byte position; what only a few long ones have goes byte by byte."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    data, starts = np.frombuffer(b"".join(texts[i] for i in order), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(order) else sizes
    h, common = np.full(len(order), FNV_START, np.uint64), int(sizes[FEW]) if len(order) > FEW else 0
    for at in range(common):
        n = int(np.searchsorted(-sizes, -at, "left"))  # so many are longer
        h[:n] = (h[:n] ^ data[starts[:n] + at]) * np.uint64(FNV_PRIME)
    out = [0] * len(order)
    for k, i in enumerate(order):
        x = int(h[k])
        for b in texts[i][common:]:
            x = ((x ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        out[i] = x
    return out


@F.pandas_udf(StringType())
def fnv1a(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit FNV-1a of the UTF-8 bytes, in hexadecimal; Spark has no such hash."""
    for series in texts:
        yield pd.Series([f"{h:x}" for h in fnv1a_of([(t or "").encode() for t in series])])
