"""Sentences, terms and keywords of documents (doc_id, text)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from studyloom.functions import text as fn

#: Rows of a batch that goes back to Spark.
ROWS = 50_000


def sentences(docs: DataFrame) -> DataFrame:
    # outer: else Spark makes the array twice, first for a filter on its size
    return docs.select("doc_id", F.posexplode_outer(fn.sentence_array(F.col("text"))).alias("pos", "sentence")).where("pos is not null")


def document_stats(docs: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    lines = F.split(t, "\n", -1)
    blank = F.size(F.filter(lines, lambda x: F.trim(x) == ""))
    return docs.select("doc_id", F.length(t).alias("n_chars"), fn.n_words(t).alias("n_words"), F.size(fn.sentence_array(t)).alias("n_sentences"), F.size(lines).alias("n_lines"), blank.alias("n_blank"))


def document_complexity(stats: DataFrame) -> DataFrame:
    """stats: n_words, n_sentences, n_signals (headings, lists, tables ...), n_blocks."""
    mean = F.when(F.col("n_sentences") == 0, 0.0).otherwise(F.col("n_words") / F.col("n_sentences"))
    density = F.col("n_signals") / F.greatest(F.lit(1), F.col("n_sentences"))
    structure = F.col("n_signals") / F.greatest(F.lit(1), F.col("n_blocks"))
    reading = F.least(F.lit(1.0), 0.20 + mean / 30.0 * 0.45 + structure * 0.25 + density * 0.10)
    minutes = F.greatest(F.lit(1), F.ceil(F.col("n_words") / 180.0 + F.col("n_signals") * 0.45))
    score = F.least(F.lit(1.0), 0.35 * reading + 0.35 * F.least(F.lit(1.0), density / 2.0) + 0.30 * F.least(F.lit(1.0), structure * 2.5))
    return stats.select("doc_id", fn.difficulty(mean, structure, F.col("n_words")).alias("difficulty"), F.least(F.lit(1.0), density).alias("concept_density"), F.least(F.lit(1.0), structure).alias("structural_density"), reading.alias("reading_score"), minutes.alias("study_minutes"), score.alias("complexity"))


def terms(docs: DataFrame) -> DataFrame:
    """doc_id, pos, term: the normalised words in order."""
    return docs.select("doc_id", F.posexplode(F.filter(F.split(fn.norm_key(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")).alias("pos", "term"))


def from_text(docs: DataFrame, value: Column, made: Callable[[str], Iterable[tuple]], columns: str) -> DataFrame:
    """docs: doc_id (its key), text. Rows that a function makes of a string of each document, in the document's row: nothing is shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = to_arrow_schema(T._parse_datatype_string(f"doc_id {kind}, {columns}"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, said in enumerate(batch.column("said")):
                found = list(made(said.as_py()))
                at += [i] * len(found)
                out += found
                if len(out) > ROWS or i + 1 == batch.num_rows:
                    ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
                    fields = zip(*out, strict=True) if out else [[] for _ in schema.names[1:]]
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(v), t) for v, t in zip(fields, schema.types[1:], strict=True)]], names=schema.names)
                    at, out = [], []

    return docs.select("doc_id", F.coalesce(value, F.lit("")).alias("said")).mapInArrow(rows, f"doc_id {kind}, {columns}")


def _from_words(docs: DataFrame, made: Callable[[list[str]], Iterable[tuple]], columns: str) -> DataFrame:
    """Like from_text, of a document's normalised words."""
    return from_text(docs, fn.norm_key(F.col("text")), lambda key: made([w for w in key.split(" ") if w]), columns)


def counted_terms(docs: DataFrame) -> DataFrame:
    """doc_id, term, n, n_words: how often each word occurs in a document of so many words."""
    return _from_words(docs, lambda words: ((t, n, len(words)) for t, n in Counter(words).items()), "term string, n long, n_words long")


def _heaviest(weights: Counter, k: int) -> list[tuple[str, int, int]]:
    """The k heaviest terms with their weight and rank; ties by term."""
    best = nsmallest(k, weights.items(), key=lambda e: (-e[1], e[0]))
    return [(t, w, i) for i, (t, w) in enumerate(best, 1)]


def term_frequency(docs: DataFrame, stop: list[str] = fn.STOP_WORDS) -> DataFrame:
    """Counts by document without stop words."""
    return counted_terms(docs).where(~F.col("term").isin(*stop)).select("doc_id", "term", "n")


def top_keywords(docs: DataFrame, k: int, stop: list[str] = fn.STOP_WORDS) -> DataFrame:
    """The k heaviest words (1 an occurrence) and word pairs (2); ties by term. Words of two letters or fewer and stop words part pairs."""
    dull = frozenset(stop)

    def weighed(words: list[str]) -> list[tuple]:
        kept = [w if len(w) > 2 and w not in dull else None for w in words]
        weights = Counter(w for w in kept if w)
        for a, b in zip(kept, kept[1:], strict=False):
            if a and b:
                weights[f"{a} {b}"] += 2
        return _heaviest(weights, k)

    return _from_words(docs, weighed, "term string, weight long, rank int")


def concept_doc_frequency(docs: DataFrame, k: int = 12) -> DataFrame:
    """In how many documents a keyword is among the k first."""
    return top_keywords(docs, k).groupBy("term").agg(F.count("*").alias("n_docs"))


def frequent_terms(docs: DataFrame, k: int = 8, stop: list[str] = fn.STOP_WORDS) -> DataFrame:
    dull = frozenset(stop)
    return _from_words(docs, lambda words: _heaviest(Counter(w for w in words if w not in dull), k), "term string, n long, rank int")


def text_quality(docs: DataFrame, ideal: int = 600) -> DataFrame:
    """Share of repeated sentences, readability about 16 words a sentence, length against an ideal, share of structured lines."""
    t = F.coalesce("text", F.lit(""))
    s = fn.sentence_array(t)
    keys = F.array_distinct(F.transform(s, fn.norm_key))
    repeated = F.when(F.size(s) == 0, 0.0).otherwise(1.0 - F.size(keys) / F.size(s))
    mean = F.aggregate(s, F.lit(0), lambda a, x: a + fn.n_words(x)) / F.size(s)
    readable = F.when(F.size(s) == 0, 0.5).otherwise(1.0 - F.least(F.lit(1.0), F.abs(mean - 16.0) / 24.0))
    length = 1.0 - F.least(F.lit(1.0), F.abs(F.length(t) - ideal) / float(ideal))
    lines = F.split(t, "\n", -1)
    marked = F.size(F.filter(lines, lambda x: F.trim(x).rlike("^[#*-]")))
    return docs.select("doc_id", repeated.alias("repeated"), readable.alias("readability"), length.alias("length_score"), F.least(F.lit(1.0), (marked + 1) / (F.size(lines) + 1)).alias("structure"))
