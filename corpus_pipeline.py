"""The corpus pipeline: filter, de-duplicate, decontaminate and pack a table of documents.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it got;
the last returns packed pieces. A driver writes what a stage returns and reads it again
for the next one; ``run`` does the same in the shared folder.

Null and empty texts are documents like others: the classifier scores them, nothing in them repeats or
is contaminated, and each is packed as its end token. Rows without an id are scored by their text and
columns, stay in the stages by lines and by similarity, and are packed with a null id. Equal rows are
judged alike. Of rows that share an id with different texts the smallest text is the document for the
stages by lines and by similarity, and the others stay whole. A document that loses all its lines goes.
Very long texts are read whole. Other columns, of any name, pass through all stages but the last. An
empty table has no documents and no pieces; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import decontaminate, jaccard, line_dedup, packing, quality
from studyloom.llm._store import keep, rows_of


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return quality.keep_good(docs, quality.train(docs, rows_of(spark, sf_dir, "labels")))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those with nothing else in them go."""
    said = lambda c: F.coalesce(F.trim(F.translate(c, "\n\t\r", "   ")) != "", F.lit(False))
    other = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", said("text").alias("had"), F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"))  # a struct: no name clashes
    left = line_dedup.dedup_lines(rows).where(~F.col("had") | said("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return left.select(*[own.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more."""
    return jaccard.drop_similar(docs, 5, 80)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, rows_of(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_filter), ("line dedup", line_filter), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_filter), ("best-fit packing", packed)]
#: The classifier, the packing and the order of near copies aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs)
    return docs
