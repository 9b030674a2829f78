"""Readers and writers of notes, transcripts and their dependent tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDERS = "struct<folders: array<struct<id: string, title: string, notes: array<struct<id: string, title: string, content: string>>>>>"
GROUND_TRUTH = "concepts array<string>, relationships array<struct<source: string, relationship: string, target: string>>, facts array<string>"
# Tables that hang on a note, by the name of the column that names it.
DEPENDENTS = {"documents": "note_id", "chunks": "note_id", "note_concepts": "note_id", "relationships": "source_note_id", "flashcards": "note_id", "questions": "note_id", "summaries": "note_id", "student_concepts": "note_id", "review_events": "note_id"}


def import_folders_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Folders and notes of nested JSON files, orders from their places."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", FOLDERS).alias("v"))
    folder = raw.select(F.posexplode("v.folders").alias("sort_order", "f"))
    folders = folder.select(F.col("f.id").alias("id"), F.col("f.title").alias("title"), "sort_order")
    notes = folder.select(F.col("f.id").alias("folder_id"), F.posexplode("f.notes").alias("note_order", "n"))
    return folders, notes.select("folder_id", F.col("n.id").alias("id"), F.col("n.title").alias("title"), F.col("n.content").alias("content"), "note_order")


def read_markdown_dir(spark: SparkSession, path: str) -> DataFrame:
    """id (hash of the file name), title and keywords from the name, text."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    title = F.initcap(F.regexp_replace(name, "[-_]+", " "))
    return spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.sha2(F.col("_metadata.file_name"), 256).alias("id"), title.alias("title"), F.split(F.lower(title), " ").alias("keywords"), F.col("value").alias("text"))


def parse_front_matter(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds front (map) and body: what stands between a first and a second line of dashes, and the rest."""
    head = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    first = F.aggregate(entries, F.expr("cast(array() as array<struct<key: string, value: string>>)"), lambda a, e: F.when(F.exists(a, lambda k: k["key"] == e["key"]), a).otherwise(F.concat(a, F.array(e))))
    return df.withColumn("front", F.map_from_entries(first)).withColumn("body", F.regexp_replace(text, r"(?s)^---\s*\n.*?\n---\s*(?:\n|$)", ""))


def parse_transcript(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """[mm:ss] Speaker: words. key, line_no, seconds, speaker, said."""
    pattern = r"^\[(\d+):(\d{2})\]\s*([^:]+):\s*(.*)$"
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    return rows.select(key, "line_no", (part(1).cast("int") * 60 + part(2).cast("int")).alias("seconds"), F.trim(part(3)).alias("speaker"), F.trim(part(4)).alias("said"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)


def overwrite_notes(old: DataFrame, new: DataFrame, note_ids: DataFrame, key: str = "note_id") -> DataFrame:
    """All rows of the given notes replaced by the new ones."""
    return old.join(note_ids.select(key), key, "left_anti").unionByName(new)


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order, null where missing; other columns follow."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], *[c for c in df.columns if c not in set(schema.names)])


def cascade_delete(tables: dict[str, DataFrame], note_ids: DataFrame) -> dict[str, DataFrame]:
    """Without the notes and their rows; concepts left without a note go, and their edges and aliases."""
    gone = note_ids.select("note_id").distinct()
    out = {name: df.join(gone.withColumnRenamed("note_id", DEPENDENTS[name]), DEPENDENTS[name], "left_anti") if name in DEPENDENTS else df for name, df in tables.items()}
    if "notes" in out:
        out["notes"] = out["notes"].join(gone.withColumnRenamed("note_id", "id"), "id", "left_anti")
    if "note_concepts" in out and "concepts" in out:
        live = out["note_concepts"].select("concept_id").distinct()
        out["concepts"] = out["concepts"].join(live.withColumnRenamed("concept_id", "id"), "id", "left_semi")
        if "relationships" in out:
            out["relationships"] = out["relationships"].join(live.withColumnRenamed("concept_id", "source_concept_id"), "source_concept_id", "left_semi").join(live.withColumnRenamed("concept_id", "target_concept_id"), "target_concept_id", "left_semi")
        if "concept_aliases" in out:
            out["concept_aliases"] = out["concept_aliases"].join(live, "concept_id", "left_semi")
    return out


def merge_aliases(known: DataFrame, new: DataFrame) -> DataFrame:
    """concept_id, aliases (sorted) of known rows (concept_id, alias) and those of new whose key no concept has yet."""
    key: Column = F.lower(F.trim("alias"))
    fresh = new.withColumn("key", key).join(known.select(key.alias("key")).distinct(), "key", "left_anti").groupBy("key").agg(F.min(F.struct("concept_id", "alias")).alias("x")).select("x.*")
    return known.select("concept_id", "alias").unionByName(fresh).groupBy("concept_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def upsert_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """concept_id, description, confidence: the first description that isn't empty, the larger confidence."""
    n = new.select("concept_id", F.col("description").alias("_d"), F.col("confidence").alias("_c"))
    return old.join(n, "concept_id", "full").select("concept_id", F.coalesce(F.nullif("description", F.lit("")), F.nullif("_d", F.lit("")), F.lit("")).alias("description"), F.greatest("confidence", "_c").alias("confidence"))


def remap_ids(table: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Ids by a mapping (old_id, new_id) where it has them; rows that become alike are one."""
    m = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    return table.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*table.columns).distinct()


def notes_by_folder(folders: DataFrame, notes: DataFrame) -> DataFrame:
    """folders: id, title, sort_order. notes: id, folder_id, title, note_order. One row a folder, its notes in order."""
    inside = notes.groupBy(F.col("folder_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("note_order", F.col("id").alias("note_id"), "title"))).alias("notes"))
    return folders.join(inside, "id", "left").select(F.col("id").alias("folder_id"), F.col("title").alias("folder"), "sort_order", "notes")


def export_events_json(events: DataFrame, path: str) -> None:
    """One JSON object a line, dates in ISO 8601."""
    events.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").json(path)


def write_eval_run(results: DataFrame, path: str) -> None:
    """results: run_id, run_at and the rest by note. A folder for each run; a run that is written again replaces its own."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def recent_runs(results: DataFrame, n: int) -> DataFrame:
    """run_id, run_at, n_notes of the n latest runs."""
    return results.groupBy("run_id").agg(F.max("run_at").alias("run_at"), F.count("*").alias("n_notes")).orderBy(F.desc("run_at"), "run_id").limit(n)
