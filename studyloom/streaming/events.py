"""Streaming twins of the event operators; each gives what its batch form gives on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.sources.store import new_path

LATE = "1 hour"


def read_events(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over a table's files: a folder of its own, or one file beside others."""
    table = spark.read.parquet(f"{folder}/{name}")
    reader = spark.readStream.schema(table.schema)
    if table.inputFiles()[0].endswith(f"/{name}"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(f"{folder}/{name}")


def distinct_signals(signals: DataFrame, late: str = LATE) -> DataFrame:
    """The first signal to arrive of each proposal and type within the watermark."""
    return signals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["proposal_id", "signal_type"])


def windowed_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events by window and type; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def study_sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Runs of a user's events without a longer gap, with the minutes from the first to the last."""
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60e6).alias("minutes"))


def drain(stream: DataFrame, mode: str = "complete", out: str | None = None, state: str | None = None) -> DataFrame:
    """Runs a stream over what is there and gives the rows of its sink, a table in the shared folder.

    out and state: the sink's and the checkpoint's folders, to go on where an earlier run ended; a batch that runs
    again replaces its own rows. Modes but "complete" add the batch of each row.
    """
    spark = stream.sparkSession
    out, state = out or new_path(spark), state or new_path(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema if mode == "complete" else stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(out)


def latest(drained: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the row of its last batch."""
    rest = [c for c in drained.columns if c not in key]
    one = drained.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return one.select(*key, *[f"x.{c}" for c in rest if c != "batch"])
