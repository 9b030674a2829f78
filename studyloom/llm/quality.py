"""Quality classifier by co-training: text content and page metadata are two views.

For each target (quality, toxic) two logistic models are fitted on labelled documents:
one sees the text (hashed words and stems, and shares of kinds of characters), the other only the
metadata (language, source, length). In each round a view labels the unlabelled
documents it is sure of, and the other view learns from them. Each view is then
calibrated on held-out labels, and a last logistic model on the calibrated views gives
the score of every document. A document is kept if it is likelier good than bad and
likelier harmless than toxic.

Only labelled documents are sampled: the ``LABELLED`` ones with the smallest hashes of
their ids. Every other document takes part in each round. Tasks score it by both views
and sum, by hashed column, the gradient of its loss and a bound on its curvature; Spark
adds the tasks' sums up, and the driver fits the labelled documents' loss together with
the quadratic that these sums give, which lies nowhere under the true loss. Together, the
documents labelled by a view weigh at most as much as those with labels. Whole texts are
read one batch after another, without a shuffle.

Null text is empty, null metadata is a value of its own. Several labels of a document
count as the worst one, null labels not at all. A target whose labels are all alike (or
missing) is taken as met. Repeated rows get equal scores, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm._store import rows_of
from studyloom.llm._text import ALNUM, Words, byte_class, mix, slices, text_bytes

LABELLED = 6000
#: Features of fewer labelled documents aren't learned.
LEAST_DOCS = 3
ROUNDS = 3
SURE = 0.97
#: First bytes of words that are features of their own, beside whole words.
STEMS = (5, 6, 7)
HELD_OUT = 5
#: Tasks' sums are whole numbers of 1 / UNIT, so that the order in which they are added doesn't matter.
UNIT = 1 << 20
#: Columns in a row of a task's sums.
BLOCK = 256
WORD_BITS, META_BITS = 18, 12
SLICE = 1 << 20
_META = ("lang", "source")
_KINDS = [byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A)), byte_class((0x30, 0x39)), byte_class((0x20, 0x20)), byte_class((0x0A, 0x0A)), byte_class((0x80, 0xFF)), np.isin(np.arange(256), list(b".,;:!?'\"")), np.isin(np.arange(256), list(b"|")), np.isin(np.arange(256), list(b"#$%&*@<>{}[]\\^~"))]
_KIND_OF = np.full(256, len(_KINDS))  # no byte is of two kinds
for _k, _table in enumerate(_KINDS):
    _KIND_OF[_table] = _k
DENSE = len(_KINDS) + 4


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts that begin at the offsets; empty ones are 0."""
    out, full = np.zeros(len(at) - 1), at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full])
    return out


class View:
    """Rows of features that are present (row numbers, ascending, and column numbers) beside dense ones."""

    def __init__(self, row: np.ndarray, column: np.ndarray, dense: np.ndarray, width: int):
        self.row, self.column, self.dense, self.width = row.astype(np.int32), column.astype(np.int32), dense, width
        self.by_column: tuple | None = None
        self.at = np.searchsorted(self.row, np.arange(len(dense) + 1))
        # each row's features share a fixed length, so that long texts don't outweigh short ones
        self.weight = (4 / np.sqrt(np.maximum(np.bincount(row, minlength=len(dense)), 1))[row]).astype(np.float32)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return _sums(self.weight * w.astype(np.float32)[self.column], self.at) + self.dense @ w[self.width : -1] + w[-1]

    def gradient(self, d: np.ndarray) -> np.ndarray:
        if self.by_column is None:
            order = np.argsort(self.column, kind="stable")
            self.by_column = self.row[order], self.weight[order], np.searchsorted(self.column[order], np.arange(self.width + 1))
        row, weight, at = self.by_column
        return np.concatenate([_sums(weight * d.astype(np.float32)[row], at), self.dense.T @ d, [d.sum()]])

    def columns(self, wanted: np.ndarray) -> View:
        """Only the wanted features; the others keep their part in a row's length."""
        on = wanted[self.column]
        out = View(self.row[on], self.column[on], self.dense, self.width)
        out.weight = self.weight[on]
        return out

    def rows(self, which: np.ndarray) -> View:
        number = np.full(len(self.dense), -1)
        number[which] = np.arange(len(which))
        on = number[self.row] >= 0
        row = number[self.row[on]]
        order = np.argsort(row, kind="stable")
        out = View(row[order], self.column[on][order], self.dense[which], self.width)
        out.weight = self.weight[on][order]
        return out

    def sums(self, d: np.ndarray) -> np.ndarray:
        """The gradient for a view that is used once: nothing is sorted."""
        return np.concatenate([np.bincount(self.column, self.weight * d[self.row], self.width), self.dense.T @ d, [d.sum()]])

    def bounds(self, on: np.ndarray) -> np.ndarray:
        """By column, a bound on the curvature of the loss of the rows that are on: no logit's is over 1/4."""
        size = (np.bincount(self.row, self.weight, len(self.dense)) + np.abs(self.dense).sum(1) + 1) * on / 4
        return np.concatenate([np.bincount(self.column, self.weight * size[self.row], self.width), np.abs(self.dense).T @ size, [size.sum()]])


class Pseudo(NamedTuple):
    """What one view learns from the documents that the other is sure of."""

    gradient: np.ndarray
    curvature: np.ndarray
    n: float


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted, each once; sorts in place."""
    numbers.sort()
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def text_view(batch: pa.RecordBatch) -> View:
    data, offsets = text_bytes(batch.column("text"))
    words, n = Words(data, offsets, ALNUM), batch.num_rows
    kind = np.uint32 if n < 1 << (32 - WORD_BITS) else np.uint64  # row and column in one number
    text, mask = np.repeat(np.arange(n, dtype=kind), words.counts()) << kind(WORD_BITS), np.uint64((1 << WORD_BITS) - 1)
    found = [text | (words.hash & mask).astype(kind)]
    for k in STEMS:
        long = words.end - words.start >= k
        found.append(text[long] | (mix(words.span_hash(words.start[long], words.start[long] + k) + np.uint64(k)) & mask).astype(kind))
    pairs = _distinct(np.concatenate(found))
    row, column = (pairs >> kind(WORD_BITS)).astype(np.int64), (pairs & kind((1 << WORD_BITS) - 1)).astype(np.int64)
    size, count = np.maximum(np.diff(offsets), 1), np.maximum(words.counts(), 1)
    kinds = np.bincount(np.repeat(np.arange(n) * (len(_KINDS) + 1), np.diff(offsets)) + _KIND_OF[data], minlength=n * (len(_KINDS) + 1)).reshape(n, -1)
    dense = [kinds[:, k] / size for k in range(len(_KINDS))]
    dense += [np.bincount(row, minlength=n) / count, np.log1p(words.counts()) / 10, size / count / 20, words.counts() == 0]
    return View(row, column, np.stack(dense, 1).astype(float) * 4, 1 << WORD_BITS)


def meta_view(batch: pa.RecordBatch) -> View:
    n, columns = batch.num_rows, []
    for k, name in enumerate(_META):
        code = Words(*text_bytes(pc.fill_null(batch.column(name), "\x00")), np.ones(256, bool))
        value = np.zeros(n, np.uint64)
        value[code.counts() > 0] = code.hash
        columns.append(mix(value + np.uint64(k)))
    size = np.log2(1 + np.maximum(0, pc.fill_null(batch.column("n_chars").cast(pa.float64()), -1).to_numpy(zero_copy_only=False) + 1))
    columns.append(mix(np.floor(size).astype(np.uint64) + np.uint64(1 << 40)))
    column = (np.concatenate(columns) & np.uint64((1 << META_BITS) - 1)).astype(np.int64)
    row = np.tile(np.arange(n), len(columns))
    order = np.argsort(row, kind="stable")
    return View(row[order], column[order], size[:, None] / 16, 1 << META_BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(view: View, y: np.ndarray, start: np.ndarray | None = None, pseudo: Pseudo | None = None, l2: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Adam over all rows; deterministic. From a start, a quarter of the steps will do."""
    w = np.zeros(view.width + view.dense.shape[1] + 1) if start is None else start.copy()
    steps = steps if start is None else steps // 4
    share = min(1.0, len(y) / pseudo.n) if pseudo and pseudo.n else 0.0
    m, v, n = np.zeros_like(w), np.zeros_like(w), len(y) + (share * pseudo.n if share else 0)
    for t in range(1, steps + 1):
        g = view.gradient(_sigmoid(view.logits(w)) - y)
        if share:
            g += share * (pseudo.gradient + pseudo.curvature * (w - start))
        g /= n
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _small_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Newton's method on a few columns and a constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * len(y) * np.eye(len(w)) / 10
        w -= np.linalg.solve(h, x.T @ (p - y) + l2 * len(y) * w / 10)
    return w


class Split:
    """The views of the labelled documents, and the parts to fit and to calibrate on; all targets share them."""

    def __init__(self, views: tuple[View, View]):
        self.views = views
        self.held = np.arange(len(views[0].dense)) % HELD_OUT == 0
        self.fit, self.out = ([v.rows(np.flatnonzero(on)) for v in views] for on in (~self.held, self.held))


class CoTrained:
    """Both views' models of one target, their calibration, and the model that joins them."""

    def __init__(self, split: Split, y: np.ndarray):
        self.models: list[np.ndarray] = []
        #: Unlabelled documents that were scored in each round, and those that each view learned from.
        self.scored: list[int] = []
        self.learned: list[tuple[int, int]] = []
        if len(np.unique(y)) < 2:
            return
        apart = all(len(np.unique(y[on])) == 2 for on in (split.held, ~split.held))
        self.fit, self.out = (split.fit, split.out) if apart else (split.views, split.views)
        self.y, self.y_out = (y[~split.held], y[split.held]) if apart else (y, y)
        self.models = [fit_logistic(v, self.y) for v in self.fit]

    def learn(self, pseudo: tuple[Pseudo, Pseudo]) -> None:
        self.models = [fit_logistic(v, self.y, w, p) for v, w, p in zip(self.fit, self.models, pseudo, strict=True)]

    def calibrate(self) -> None:
        """The last step; the labelled documents aren't needed any more."""
        if not self.models:
            return
        raw = [v.logits(w) for v, w in zip(self.out, self.models, strict=True)]
        self.calibration = [_small_logistic(x[:, None], self.y_out) for x in raw]
        self.joined = _small_logistic(np.stack([a * x + b for x, (a, b) in zip(raw, self.calibration, strict=True)], 1), self.y_out)
        del self.fit, self.out, self.y, self.y_out

    def score(self, views: tuple[View, View]) -> np.ndarray:
        if not self.models:
            return np.full(len(views[0].dense), np.nan)
        x = [a * v.logits(w) + b for v, w, (a, b) in zip(views, self.models, self.calibration, strict=True)]
        return _sigmoid(np.stack(x, 1) @ self.joined[:-1] + self.joined[-1])


def _features(docs: DataFrame) -> list[Column]:
    """The columns that the views read, null where the table has none."""
    have = docs.columns
    meta = [(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in _META]
    return [F.col("text").cast("string").alias("text"), *meta, (F.col("n_chars").cast("long") if "n_chars" in have else F.length("text").cast("long")).alias("n_chars")]


def _arrow_features(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The same columns of a batch that holds whole documents."""
    text = batch.column("text").cast(pa.string())
    meta = [batch.column(c).cast(pa.string()) if c in batch.schema.names else pa.nulls(batch.num_rows, pa.string()) for c in _META]
    size = batch.column("n_chars").cast(pa.int64()) if "n_chars" in batch.schema.names else pc.utf8_length(text).cast(pa.int64())
    return pa.RecordBatch.from_arrays([text, *meta, size], ["text", *_META, "n_chars"])


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *_features(docs))


def _views(rows: DataFrame) -> tuple[np.ndarray, tuple[View, View]]:
    """Ids and views of a bounded table, made by its tasks; only hashed features come to the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                views = [text_view(batch), meta_view(batch)]
                lists = []
                for v in views:
                    at, ones = np.searchsorted(v.row, np.arange(batch.num_rows + 1)), v.column.astype(np.int32)
                    lists += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ones)), pa.array(v.dense.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "a", "x", "b", "z"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"doc_id {kind}, a array<int>, x array<double>, b array<int>, z array<double>").toArrow().combine_chunks()
    views = []
    for ones, dense, width, size in (("a", "x", 1 << WORD_BITS, DENSE), ("b", "z", 1 << META_BITS, 1)):
        c = got.column(ones).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
        c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
        flat = got.column(dense).to_pylist()
        views.append(View(np.repeat(np.arange(len(c)), pc.list_value_length(c).to_numpy(zero_copy_only=False)), c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.array(flat, float).reshape(len(c), size), width))
    return got.column("doc_id").to_numpy(), (views[0], views[1])


def _lists(rows: np.ndarray) -> pa.Array:
    """A list a row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def exchange(rest: DataFrame, models: list[list[np.ndarray]], seen: list[np.ndarray]) -> tuple[int, list[tuple[Pseudo, Pseudo]]]:
    """How many unlabelled documents there are, and by target what each view learns from the other.

    ``models`` has both views' weights by target. A task's sums have a row for each ``BLOCK``
    learned columns, whatever its documents, and so has what comes to the driver.
    """
    held = rest.sparkSession.sparkContext.broadcast((models, seen))
    sizes, targets = [(1 << WORD_BITS) + DENSE + 1, (1 << META_BITS) + 2], range(len(models))
    # the learned columns, those that aren't hashed, and the counts of documents learned from and of all
    places = [np.concatenate([np.flatnonzero(k), np.arange(len(k), size + 1)]) for k, size in zip(seen, sizes, strict=True)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, seen = held.value
        total = [np.zeros((2 * len(models), size + 1)) for size in sizes]
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                views = [v.columns(k) for v, k in zip((text_view(batch), meta_view(batch)), seen, strict=True)]
                for t, weights in enumerate(models):
                    p = [_sigmoid(v.logits(w)) for v, w in zip(views, weights, strict=True)]
                    for k, v in enumerate(views):
                        other = p[1 - k]
                        sure = (other > SURE) | (other < 1 - SURE)
                        total[k][2 * t, :-1] += v.sums(np.where(sure, p[k] - (other > 0.5), 0.0))
                        total[k][2 * t + 1, :-1] += v.bounds(sure)
                        total[k][2 * t : 2 * t + 2, -1] += sure.sum(), batch.num_rows
        for k, (sums, at) in enumerate(zip(total, places, strict=True)):
            blocks = -(-len(at) // BLOCK)
            whole = np.zeros((len(sums), blocks * BLOCK), np.int64)
            whole[:, : len(at)] = np.rint(sums[:, at] * UNIT)
            rows = whole.reshape(len(sums), blocks, BLOCK).swapaxes(0, 1).reshape(blocks, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(blocks, k), pa.int32()), pa.array(np.arange(blocks), pa.int32()), _lists(rows)], ["view", "block", "sums"])

    def together(table: pa.Table) -> pa.Table:
        rows = table.column("sums").combine_chunks()
        whole = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(0)
        return pa.table([table.column("view")[:1], table.column("block")[:1], pa.chunked_array([_lists(whole[None])])], names=["view", "block", "sums"])

    schema = "view int, block int, sums array<bigint>"
    got = rest.select("text", *_META, "n_chars").mapInArrow(add_up, schema).groupBy("view", "block").applyInArrow(together, schema).toArrow().sort_by("block")
    total = [np.zeros((2 * len(models), size + 1)) for size in sizes]
    for k, at in enumerate(places):
        mine = got.filter(pc.equal(got.column("view"), k))
        if mine.num_rows:
            rows = pc.list_flatten(mine.column("sums")).to_numpy().reshape(mine.num_rows, -1, BLOCK)
            total[k][:, at] = rows.swapaxes(0, 1).reshape(2 * len(models), -1)[:, : len(at)] / UNIT
    held.destroy()
    return int(total[0][1, -1]), [tuple(Pseudo(s[2 * t, :-1], s[2 * t + 1, :-1], float(s[2 * t, -1])) for s in total) for t in targets]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int | None = None, rounds: int = ROUNDS) -> dict[str, CoTrained]:
    """Models by target. ``pool`` is for trials: it leaves all but so many unlabelled documents out."""
    docs = _inputs(docs).where("doc_id is not null")
    worst = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = worst.orderBy(order, "doc_id").limit(labelled).collect()  # bounded by the parameter
    y = {r.doc_id: (r.quality, r.toxic) for r in chosen}
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    id_rows = F.broadcast(spark.createDataFrame([(k,) for k in y], f"doc_id {kind}"))  # bounded by the parameter
    ids, views = _views(docs.join(id_rows, "doc_id", "left_semi"))
    by_id = np.argsort(ids, kind="stable")  # partitions come in any order
    seen = [np.bincount(v.column, minlength=v.width) >= min(LEAST_DOCS, len(ids)) for v in views]
    split = Split(tuple(v.columns(k).rows(by_id) for v, k in zip(views, seen, strict=True)))
    targets = np.array([y[i] for i in ids[by_id].tolist()], float).reshape(-1, 2)
    del views
    models = {name: CoTrained(split, targets[:, k]) for k, name in enumerate(("quality", "toxic"))}
    del split  # the parts that the models need are theirs
    pa.default_memory_pool().release_unused()
    fitted = [m for m in models.values() if m.models]
    # labels beyond the sample aren't used, so their documents are as good as unlabelled
    rest = docs.join(id_rows, "doc_id", "left_anti")
    if pool is not None:
        first = rest.select("doc_id").distinct().orderBy(order, "doc_id").limit(pool)
        rest = rest.join(F.broadcast(first), "doc_id", "left_semi")
    for _ in range(rounds - 1 if fitted else 0):
        n, pseudo = exchange(rest, [m.models for m in fitted], seen)
        for m, p in zip(fitted, pseudo, strict=True):
            m.scored.append(n)
            m.learned.append((int(p[0].n), int(p[1].n)))
            m.learn(p)
    for m in models.values():
        m.calibrate()
    return models


def _scores(batch: pa.RecordBatch, models: dict[str, CoTrained]) -> tuple[np.ndarray, np.ndarray]:
    views = text_view(batch), meta_view(batch)
    quality, toxic = models["quality"].score(views), models["toxic"].score(views)
    return np.where(np.isnan(quality), 1.0, quality), np.where(np.isnan(toxic), 0.0, toxic)


def score_documents(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """doc_id, p_quality, p_toxic and keep of every document."""
    held = docs.sparkSession.sparkContext.broadcast(models)  # two hashed weight tables a target, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                quality, toxic = _scores(batch, held.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(quality), pa.array(toxic), pa.array((quality >= 0.5) & (toxic < 0.5))], ["doc_id", "p_quality", "p_toxic", "keep"])

    docs = _inputs(docs)
    return docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, p_quality double, p_toxic double, keep boolean")


def keep_good(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """The documents to keep, with all their columns, in one pass over them."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                quality, toxic = _scores(_arrow_features(batch), held.value)
                yield batch.filter(pa.array((quality >= 0.5) & (toxic < 0.5)))

    return docs.mapInArrow(choose, docs.schema)  # each text goes to the task once


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, rows_of(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable] = {"op10_quality_scores": op10_quality_scores}
ORACLES: dict[str, str] = {}
