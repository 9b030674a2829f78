"""The shared store of iterative jobs, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.sources.store import keep, keep_bucketed, new_path, shared_dir

__all__ = ["first_texts", "keep", "keep_bucketed", "new_path", "rows_of", "shared_dir"]


def first_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs: doc_id, text. One row an id, and those of repeated ids (None where there are none).

    Of rows that share an id the one with the smallest text counts, null before all. Only ids are
    shuffled to find repeated ones, and only their texts move.
    """
    many = keep(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if many.isEmpty():
        return docs, None
    whole = F.min(F.struct(F.col("text").isNotNull().alias("there"), "text")).alias("x")
    again = keep(docs.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(whole).select("doc_id", "x.text"))
    return docs.join(many, "doc_id", "left_anti").select("doc_id", "text").unionByName(again), again


def rows_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
