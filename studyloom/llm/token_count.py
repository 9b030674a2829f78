"""Token counts: a separator scan over flat token files.

A token file is nothing but little-endian 16-bit words: vocabulary id + 1, and 0 at the
end of each document. There is no index. Files are read in blocks that know nothing of
documents; numpy finds the separators of a block, and a prefix scan over the blocks'
summaries (words, separators, last separator) says where a block starts in its file,
which document is open there and since when.

``write_token_files`` makes such files from documents, one part per partition of the
input, and ``token_counts`` gives each document its place and length. It relies on the
input having the same rows in the same order each time, as Parquet files or a
checkpoint have. Null texts are documents without tokens. Repeated rows are documents
of their own, rows without an id stay (with a null id), other columns are ignored; an
empty table gives no rows. A file holds a bounded number of words, or one longer text. Words after a file's last separator are a document that
isn't closed.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from studyloom.llm._store import keep, rows_of, shared_dir

SEPARATOR = 0
BLOCK_WORDS = 1 << 20
#: Words of a part of a file, a single document at least, and parts in one file: a file is one row for Spark's reader.
PART_WORDS, FILE_PARTS = 1 << 22, 8


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Flat token files of all documents in their order; a file ends by its words, however many or long its documents are."""
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, n = _encoder(vocabulary), [], 0
        if encoder.max_token_value + 1 > np.iinfo(np.uint16).max:
            raise ValueError("this vocabulary's ids don't fit 16 bits beside the separator")
        row = lambda: pa.RecordBatch.from_arrays([pa.array([end_word.join(held)], pa.binary())], ["value"])
        for batch in batches:
            for text in batch.column(0):
                words = (np.array(encoder.encode_ordinary(text.as_py() or ""), np.uint16) + np.uint16(1)).astype("<u2").tobytes()
                if held and n + len(words) // 2 + 1 > part_words:
                    yield row()
                    held, n = [], 0
                held.append(words)
                n += len(words) // 2 + 1
        if held:
            yield row()

    end_word, part_words = np.array([SEPARATOR], "<u2").tobytes(), PART_WORDS

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(encode, "value binary")
    end = np.array([SEPARATOR], "<u2").tobytes().decode()  # Spark's text writer ends each row by it, and adds nothing else
    words.select(F.col("value").cast("string")).write.option("lineSep", end).option("maxRecordsPerFile", FILE_PARTS).text(path)


def scan_blocks(files: DataFrame, separator: int = SEPARATOR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """By file and block: its words, and where in the block separators are. files: path string, content binary."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                words = np.frombuffer(content.as_buffer(), "<u2")
                for k, lo in enumerate(range(0, len(words), block_words)):
                    block = words[lo : lo + block_words]
                    at = np.flatnonzero(block == separator)
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([k], pa.int64()), pa.array([len(block)], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64()))], ["path", "block", "n_words", "ends"])

    return files.select("path", "content").mapInArrow(scan, "path string, block long, n_words long, ends array<long>")


def count_tokens(blocks: DataFrame) -> DataFrame:
    """By file and document, from 0: start word, tokens without the separator, and whether a separator closes it."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = blocks.select("path", "block", "n_words", F.size("ends").cast("long").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last_end"))
    placed = summary.withColumn("start", F.coalesce(F.sum("n_words").over(before), F.lit(0)))
    scanned = placed.withColumn("position", F.col("start") + F.col("last_end")).select(
        "path", "block", "start",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.last("position", ignorenulls=True).over(before) + 1, F.lit(0)).alias("opened"),
        F.when(F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull(), F.col("start") + F.col("n_words")).alias("total"),
    )
    joined = blocks.select("path", "block", "ends").join(scanned, ["path", "block"])
    ends = F.transform("ends", lambda e: F.col("start") + e)
    begins = F.concat(F.array("opened"), F.transform("stops", lambda e: e + 1))
    closed = F.transform("stops", lambda e, i: F.struct((F.col("first") + i).alias("document"), F.element_at("begins", i + 1).alias("start_word"), (e - F.element_at("begins", i + 1)).alias("n_tokens"), F.lit(True).alias("closed")))
    tail = F.element_at("begins", -1)
    rest = F.struct((F.col("first") + F.size("stops")).alias("document"), tail.alias("start_word"), (F.col("total") - tail).alias("n_tokens"), F.lit(False).alias("closed"))
    rows = F.when(F.col("total") > tail, F.concat("closed", F.array(rest))).otherwise(F.col("closed"))
    return joined.withColumn("stops", ends).withColumn("begins", begins).withColumn("closed", closed).select("path", F.explode(rows).alias("d")).select("path", "d.*")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.read.format("binaryFile").schema(schema).load(path).select("path", "content")


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, part, document (number in its part), start_word (in its file) and n_tokens of each document, by way of token files."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/studyloom/{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary)
    blocks = keep(scan_blocks(read_token_files(spark, path)))
    name = F.element_at(F.split("path", "/"), -1)
    part, nth = F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"), F.regexp_extract(name, r"-c(\d+)\D*$", 1).cast("long")
    # documents in a part's earlier files; there is a row a file
    files = blocks.groupBy("path").agg(F.sum(F.size("ends")).alias("n")).select("path", part.alias("part"), nth.alias("nth"), "n")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("path", "part", earlier.alias("earlier"))
    counted = count_tokens(blocks).join(files, "path").select("part", (F.col("earlier") + F.col("document")).alias("document"), "start_word", "n_tokens")
    at = F.monotonically_increasing_id()
    order = docs.select("doc_id", at.alias("at")).select("doc_id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("document"))
    return order.join(counted, ["part", "document"], "left").select("doc_id", "part", "document", "start_word", F.when(F.col("n_tokens").isNull(), F.raise_error(F.lit("the input's rows have changed")).cast("long")).otherwise(F.col("n_tokens")).alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(rows_of(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
