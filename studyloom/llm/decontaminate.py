"""Benchmark decontamination: a word-level Wu-Manber search of all benchmark windows in every document.

Patterns are runs of ``window`` words of a benchmark item (an item with fewer words
is one pattern). Patterns of one length share a shift table over hashed blocks of two
words: a position moves on by the table's shift, and only where it is 0 does the
block's bucket name patterns, whose words are then compared one by one. Many stretches
of text advance together, so each step is one numpy operation.

Nulls: a null text has no words (n_words 0, not contaminated), a null item text has no
windows, items without an id are skipped, and so are documents without an id. Repeated
document rows give a row each, also where rows with one id have different texts; repeated
item ids count once. Other columns of either table are ignored. Empty tables give no
rows, an empty benchmark no hits. Texts of any length are searched whole, by stretches.
A benchmark of any size gives the same result: larger ones only take more passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm._store import keep, rows_of
from studyloom.llm._text import ALNUM, Words, chain, mix, slices, spread, text_bytes

WINDOW = 10
#: Benchmark words in one broadcast search table (8 bytes a word and some 30 a window); larger benchmarks take several passes.
PASS_WORDS = 1_000_000
LANE = 256
TABLE_BITS = 20


class WuManber:
    """Shift tables and suffix buckets for patterns of one length over a stream of word hashes."""

    def __init__(self, stream: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int):
        self.stream, self.m, self.block = stream, length, min(2, length)
        self.mask = np.uint64((1 << TABLE_BITS) - 1)
        most = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, most, np.uint8 if most < 256 else np.int32)
        blocks = self.blocks(stream)
        for j in range(length - 1, self.block - 2, -1):
            at = (blocks[starts + j] & self.mask).astype(np.int64)
            self.shift[at] = np.minimum(self.shift[at], length - 1 - j)
        key = self.key(blocks, starts)
        order = np.argsort(key, kind="stable")
        self.bucket, self.starts, self.owner = key[order], starts[order], owner[order]

    def blocks(self, words: np.ndarray) -> np.ndarray:
        """The hash of the block that ends at each word."""
        if self.block == 1:
            return mix(words)
        out = mix(words)
        out[1:] = chain(words[:-1], words[1:])
        return out

    def key(self, blocks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Suffix block with prefix block."""
        return chain(blocks[starts + self.m - 1], blocks[starts + self.block - 1])

    def search(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and item of each occurrence; at: the number of each text's first word, and the total."""
        n = np.maximum(np.diff(at) - self.m + 1, 0)
        lanes = -(-n // LANE)
        part = spread(np.zeros(len(n), np.int64), lanes)
        first = np.repeat(at[:-1], lanes) + part * LANE + self.m - 1
        end = np.minimum(first + LANE, np.repeat(at[1:], lanes))
        blocks, found = self.blocks(words), []
        code = (blocks & self.mask).astype(np.int64)
        while len(first):
            step = self.shift[code[first]].astype(np.int64)
            found.append(first[step == 0])
            first = first + np.maximum(step, 1)
            on = first < end
            first, end = first[on], end[on]
        start = np.sort(np.concatenate(found)) - self.m + 1 if found else np.empty(0, np.int64)
        key = self.key(blocks, start)
        lo, hi = np.searchsorted(self.bucket, key, "left"), np.searchsorted(self.bucket, key, "right")
        start, pattern = np.repeat(start, hi - lo), spread(lo, hi - lo)
        for j in range(self.m):  # word by word
            same = words[start + j] == self.stream[self.starts[pattern] + j]
            start, pattern = start[same], pattern[same]
        return start, self.owner[pattern]


def build(texts: list[str | None], window: int) -> list[WuManber]:
    words = Words(*text_bytes(pa.array(texts, pa.string())), ALNUM)
    n, made = words.counts(), []
    for m in sorted({min(window, int(x)) for x in n} - {0}):
        mine = np.flatnonzero(n >= window if m == window else n == m)
        runs = n[mine] - m + 1
        made.append(WuManber(words.hash, spread(words.at[mine], runs), np.repeat(mine, runs), m))
    return made


def _scan(batch: pa.RecordBatch, tables: list[WuManber]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, whether each is hit, and the distinct (text, item) pairs."""
    words = Words(*text_bytes(batch.column("text")), ALNUM)
    edge, pairs = np.zeros(len(words.hash) + 1, np.int64), []
    for table in tables:
        start, item = table.search(words.hash, words.at)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + table.m, -1)
        pairs.append(np.unique(np.stack([np.searchsorted(words.at, start, "right") - 1, item], 1), axis=0))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
    return words, np.cumsum(edge[:-1]) > 0, pairs[:, 0], pairs[:, 1]


def _runs(hit: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """By text, the hit words as start, end, start, end ..."""
    out = []
    for i in range(len(at) - 1):
        mine = np.diff(np.concatenate([[0], hit[at[i] : at[i + 1]].astype(np.int8), [0]]))
        out.append(np.flatnonzero(mine).tolist())
    return out


def _items(benchmark: DataFrame, pass_words: int) -> tuple[DataFrame, int]:
    """Items with an id, and in how many passes they fit the bound of a broadcast."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    weight = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]  # a word takes two characters or more, with its end
    return items, max(1, int(-(-weight // pass_words)))


def _part(items: DataFrame, p: int, passes: int) -> list:
    return items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()


def find_benchmark_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, spans (word numbers start, end, start, end ...) and items (sorted distinct ids as strings)."""
    spark = docs.sparkSession
    items, passes = _items(benchmark, pass_words)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def one(docs: DataFrame, rows: list) -> tuple[DataFrame, Broadcast]:
        other = [c for c in docs.columns if c not in ("doc_id", "text")]
        held = spark.sparkContext.broadcast(([r.item_id for r in rows], build([r.text for r in rows], window)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, tables = held.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    words, hit, text, item = _scan(batch, tables)
                    found: list[set[str]] = [set() for _ in range(batch.num_rows)]
                    for t, i in zip(text.tolist(), item.tolist(), strict=True):
                        found[t].add(names[i])
                    spans = _runs(hit, words.at) if hit.any() else [[]] * batch.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string())), *[batch.column(c) for c in other]],
                        ["doc_id", "n_words", "spans", "items", *other],
                    )

        return docs.mapInArrow(scan, f"doc_id {id_type}, n_words long, spans array<long>, items array<string>" + "".join(f", {c} string" for c in other)), held

    if passes == 1:
        return one(docs, _part(items, 0, 1))[0]
    # rows are told apart by id and text; a pass is written and its search table released before the next one
    every = None
    for p in range(passes):
        found, held = one(docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), _part(items, p, passes))
        found = keep((found if p == 0 else found.where("size(spans) > 0")).withColumn("rows", F.lit(int(p == 0))))
        held.destroy()
        every = found if every is None else every.unionByName(found)
    lists = F.collect_set("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    grouped = every.groupBy("doc_id", "digest").agg(F.max("n_words").alias("n_words"), F.sum("rows").alias("rows"), *lists)
    merged = grouped.mapInArrow(_merge, f"doc_id {id_type}, n_words long, spans array<long>, items array<string>, rows long")
    return merged.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("row", "rows")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list of spans from those of all passes."""
    for batch in batches:
        merged = []
        for lists in batch.column("spans").to_pylist():
            out: list[int] = []
            for lo, hi in sorted((x[i], x[i + 1]) for x in lists for i in range(0, len(x), 2)):
                if out and lo <= out[-1]:
                    out[-1] = max(out[-1], hi)
                else:
                    out += [lo, hi]
            merged.append(out)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(merged, pa.list_(pa.int64())), batch.column("items"), batch.column("rows")], ["doc_id", "n_words", "spans", "items", "rows"])


def _hit(spans) -> object:
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """The digest of find_benchmark_words: counts, hash of the item ids, and the verdict."""
    found = find_benchmark_words(docs, benchmark, window, pass_words)
    n_hit = _hit(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns.

    Each pass filters on, without a join; of several, each is written before the next one's search table is made.
    """
    items, passes = _items(benchmark, pass_words)
    for p in range(passes):
        held = docs.sparkSession.sparkContext.broadcast(build([r.text for r in _part(items, p, passes)], window))
        docs = _clean(docs, held)
        if passes > 1:
            docs = keep(docs)
            held.destroy()
    return docs


def _clean(docs: DataFrame, held: Broadcast) -> DataFrame:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hit_text = np.zeros(batch.num_rows, bool)
                hit_text[_scan(batch, held.value)[2]] = True
                yield batch.filter(pa.array(~hit_text))

    return docs.mapInArrow(clean, docs.schema)  # each text goes to the task once


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
b AS (SELECT item_id::varchar AS item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM bw),
ms AS (SELECT DISTINCT m FROM pat),
dw AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m),
dg AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM dw),
occ AS (SELECT DISTINCT doc_id, dg.m, i, item_id FROM dg JOIN pat USING (m, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
QUERIES: dict[str, Callable] = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLES = {"op9_benchmark_decontamination": SQL}
