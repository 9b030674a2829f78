"""Incremental ingest of notes: a batch of changes replaces the rows of the notes that it touches.

A store is a folder of tables in buckets by note. A batch writes the buckets it touches, whole,
to folders of its own, and at the end a row a bucket that says which batch holds it now: readers
see a batch all at once or not at all. A batch that is run again starts from the one before and
writes the same; one that comes twice changes nothing, since a note keeps the version it got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.functions.text import content_hash
from studyloom.sources.store import keep, new_path

BUCKETS = 64
CHANGES = ["note_id", "version", "deleted", "title", "text"]


class NoteStore:
    """derive: by table, a function from notes (note_id, title, text) to that table's rows, which have note_id."""

    def __init__(self, spark: SparkSession, path: str, derive: dict[str, Callable[[DataFrame], DataFrame]], buckets: int = BUCKETS):
        self.spark, self.path, self.derive, self.buckets = spark, path, derive, buckets

    def _holders(self, before: int | None) -> dict[int, int]:
        """The batch that holds each bucket, as of the last batch (before a given one)."""
        try:
            rows = self.spark.read.schema("bucket int, holder long, batch long").json(f"{self.path}/heads")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return {} if last is None else {r.bucket: r.holder for r in rows.where(F.col("batch") == last).collect()}

    def _rows(self, name: str, schema: T.StructType, holders: dict[int, int]) -> DataFrame:
        """The table's rows in the given buckets; only their folders are read."""
        by_batch: dict[int, list[int]] = {}
        for bucket, batch in holders.items():
            by_batch.setdefault(batch, []).append(bucket)
        held = F.lit(False)
        for batch, buckets in by_batch.items():
            held = held | (F.col("batch") == batch) & F.col("bucket").isin(buckets)
        if not by_batch:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
        whole = T.StructType([*schema, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(f"{self.path}/{name}").where(held).drop("batch")

    def _notes(self, note_id: T.DataType) -> T.StructType:
        return T.StructType([T.StructField("note_id", note_id), T.StructField("version", T.LongType()), T.StructField("content_hash", T.StringType())])

    def _schemas(self, note_id: T.DataType) -> dict[str, T.StructType]:
        empty = self.spark.createDataFrame([], T.StructType([T.StructField("note_id", note_id), *[T.StructField(c, T.StringType()) for c in ("title", "text")]]))
        return {"notes": self._notes(note_id)} | {name: f(empty).schema for name, f in self.derive.items()}

    def table(self, name: str, note_id: T.DataType) -> DataFrame:
        """A table as of the last batch. "notes": note_id, version, content_hash (null where the note was removed)."""
        return self._rows(name, self._schemas(note_id)[name], self._holders(None)).drop("bucket")

    def judge(self, changes: DataFrame, holders: dict[int, int]) -> DataFrame:
        """The last change of each note, if newer than what the store has: with its hash, bucket and kind (added, changed, removed, same)."""
        last = changes.groupBy("note_id").agg(F.max(F.struct(*CHANGES[1:])).alias("x")).select("note_id", "x.*")
        old = self._rows("notes", self._notes(changes.schema["note_id"].dataType), holders).select("note_id", F.col("version").alias("_version"), F.col("content_hash").alias("_hash"))
        new = last.withColumn("content_hash", F.when(~F.col("deleted"), content_hash(F.col("title"), F.col("text"))))
        there, here = F.col("_hash").isNotNull(), F.col("content_hash").isNotNull()
        kind = F.when(~there & here, "added").when(there & ~here, "removed").when(there & (F.col("_hash") != F.col("content_hash")), "changed").otherwise("same")
        both = new.join(old, "note_id", "left").where(F.col("_version").isNull() | (F.col("version") > F.col("_version")))
        return both.withColumn("kind", kind).withColumn("bucket", F.pmod(F.xxhash64("note_id"), F.lit(self.buckets)).cast("int")).drop("_version", "_hash")

    def ingest(self, changes: DataFrame, batch: int) -> DataFrame:
        """changes: note_id, version, deleted, title, text. Writes the batch; note_id and kind of the changes that counted."""
        changes = changes.select("note_id", F.col("version").cast("long").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "title", "text").where("note_id is not null")
        note_id = changes.schema["note_id"].dataType
        holders = self._holders(batch)
        judged = keep(self.judge(changes, holders))
        touched = sorted(r.bucket for r in judged.select("bucket").distinct().collect())
        here = {b: holders[b] for b in touched if b in holders}
        new = judged.where("kind in ('added', 'changed')").select("note_id", "title", "text")
        fresh = {"notes": judged.select("note_id", "version", "content_hash")} | {name: f(new) for name, f in self.derive.items()}
        gone = {name: judged.select("note_id") if name == "notes" else judged.where("kind <> 'same'").select("note_id") for name in fresh}
        for name, schema in self._schemas(note_id).items():
            stay = self._rows(name, schema, here).drop("bucket").join(gone[name], "note_id", "left_anti")
            rows = stay.unionByName(fresh[name]).withColumn("bucket", F.pmod(F.xxhash64("note_id"), F.lit(self.buckets)).cast("int"))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={batch}")
        heads = [(b, h) for b, h in (holders | dict.fromkeys(touched, batch)).items()]
        self.spark.createDataFrame(heads, "bucket int, holder long").coalesce(1).write.mode("overwrite").json(f"{self.path}/heads/batch={batch}")
        return judged.select("note_id", "kind")

    def follow(self, changes: DataFrame, state: str | None = None) -> None:
        """Ingests a stream of changes, batch by batch; state: the checkpoint's folder, to go on where an earlier run ended."""
        query = changes.writeStream.foreachBatch(lambda df, n: self.ingest(df, n) and None).option("checkpointLocation", state or new_path(self.spark)).trigger(availableNow=True).start()
        query.awaitTermination()
