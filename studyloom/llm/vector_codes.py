"""Vector code compression: product codes from ball k-means, exact and in integers.

A component x becomes floor(1024 * x). Vectors are cut into equal parts; each part position
has a codebook, which starts as that part of the vectors with the smallest ids. A round gives
every part the nearest entry of its codebook (squared distance, ties to the lower index) and
replaces entries by the floored means of their parts; then parts are assigned a last time.

Ball k-means: an entry's parts are a ball, whose radius is the distance of its farthest one.
Only entries within two radii are neighbours. Parts closer to their entry than half the way to
its nearest neighbour (the stable core) stay without further work. The others lie in rings: a
part at distance d compares exactly only the entries within 2d, which stand first in the list
of neighbours by distance. All tests are on squared integers, so nothing is rounded.

Vectors are written once, in buckets of a row key; a round writes codes alone, in the same
buckets, so vectors are never shuffled again. Tasks add up parts by entry before they are
merged; the driver sees one row an entry. A codebook is parts * entries rows and goes to tasks.

Rows whose vector is null, empty or holds null or non-finite components take no part, nor do
those whose length doesn't divide by ``parts`` or isn't that of the smallest id's. Rows with
equal ids or vectors all get their row; rows without an id get codes but start no codebook
unless there are too few others. Scaled components must stay within 2**28, else the job fails
and says so. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm._store import keep_bucketed, rows_of

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 28
#: Rows of a distance matrix at a time.
STRIPE = 2048
_STATE = "row long, id long, label int, codes array<int>, error long, part int, entry int, n long, sums array<long>"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of c, exact in 64 bits."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        out += np.square(x[:, j, None] - c[None, :, j])
    return out


class Balls:
    """A codebook with its entries' neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = squared(entries, entries)
        np.fill_diagonal(apart, -1)  # an entry heads its own list
        self.order = np.argsort(apart, 1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part, from all entries."""
        code, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for at in range(0, len(x), STRIPE):
            d = squared(x[at : at + STRIPE], self.entries)
            code[at : at + STRIPE], best[at : at + STRIPE] = d.argmin(1), d.min(1)
        return code, best

    def reassign(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the parts' entries of the round before."""
        code = code.copy()
        best = np.square(x - self.entries[code]).sum(1)
        if len(self.entries) == 1:
            return code, best
        moving = np.flatnonzero(4 * best >= self.apart[code, 1])  # not in a stable core
        moving = moving[np.argsort(code[moving], kind="stable")]
        balls, first = np.unique(code[moving], return_index=True)
        for ball, members in zip(balls, np.split(moving, first[1:]), strict=True):
            members = members[np.argsort(best[members], kind="stable")]
            reach = np.searchsorted(self.apart[ball], 4 * best[members], "right")  # entries up to each ring
            at = 0
            while at < len(members):
                wide = min(2 * int(reach[at]), int(reach[-1]))  # a stripe of rings, up to the ball's radius
                end = min(int(np.searchsorted(reach, wide, "right")), at + STRIPE)
                near = np.sort(self.order[ball, : int(reach[end - 1])])
                d = squared(x[members[at:end]], self.entries[near])
                code[members[at:end]], best[members[at:end]] = near[d.argmin(1)], d.min(1)
                at = end
        return code, best


def usable(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """id, label and the scaled vector as whole numbers, of the rows that take part."""
    v = F.col("vector")
    sound = (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    most = F.lit(float(MOST))
    whole = lambda x: F.floor(F.greatest(F.least(x * scale, most), -most - 1)).cast("long")
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), v.cast("array<double>").alias("vector"))
    return rows.where(v.isNotNull()).where(sound).withColumn("vector", F.transform("vector", whole))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _step(books: np.ndarray, parts: int, summed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's codes (from those it gets, if any), and the sums of its parts by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int32()), ("codes", pa.list_(pa.int32())), ("error", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        balls = [Balls(b) for b in books]
        size, width = books.shape[1:]
        n, sums, key = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), parts * width)
            if np.abs(x).max() >= MOST:
                raise ValueError(f"scaled components must be less than {MOST}")
            old = _matrix(batch.column("codes"), parts) if "codes" in batch.schema.names else None
            new, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p, ball in enumerate(balls):
                part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                new[:, p], far = ball.assign(part) if old is None else ball.reassign(part, old[:, p])
                error += far
                n[p] += np.bincount(new[:, p], minlength=size)
                np.add.at(sums[p], new[:, p], part)
            key = batch.column("row")[0].as_py()
            none = lambda kind: pa.nulls(len(x), kind)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, parts), pa.int32()), pa.array(new.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), codes, pa.array(error), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], schema=schema)
        if key is None or not summed:
            return
        part, entry = np.nonzero(n)
        none = lambda kind: pa.nulls(len(part), kind)
        total = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * width + 1, width), pa.int32()), pa.array(sums[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), none(pa.int64()), none(pa.int32()), none(pa.list_(pa.int32())), none(pa.int64()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), total], schema=schema)

    return run


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: floored means of each entry's parts; unused entries stay."""
    width = books.shape[2]
    add = [F.sum(F.element_at("sums", j + 1)).alias(f"s{j}") for j in range(width)]
    books = books.copy()
    for r in state.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *add).collect():
        books[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(width)]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vectors: id, vector array, label. A row for each that takes part (id, label, codes array<int>, error) and the codebooks."""
    spark = vectors.sparkSession
    rows = usable(vectors, parts, scale)
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    width = len(first[0].vector) // parts if first else 1
    rows = rows.where(F.size("vector") == width * parts)
    start = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not start:
        return rows.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, width), np.int64)
    books = np.array([r.vector for r in start], np.int64).reshape(len(start), parts, width).swapaxes(0, 1)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = keep_bucketed(rows.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row"), "row")
    state = None
    for turn in range(rounds + 1):
        known = base if state is None else base.join(state.where("part is null").select("row", "codes"), "row")
        step = known.mapInArrow(_step(books, parts, turn < rounds), _STATE)
        state = keep_bucketed(step, "row")
        books = _means(state, books) if turn < rounds else books
    return state.where("part is null").select("id", "label", "codes", "error"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every embedding that takes part."""
    rows = rows_of(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    coded, books = compress(rows)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    both = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return both.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain assignment to all entries, round after round."""
    near = "SELECT vec_id, label, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.vec_id, v.label, v.p, v.x, c.e, list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM v JOIN {c} c USING (p)) GROUP BY vec_id, label, p, x"
    steps = []
    for r in range(ROUNDS):
        mean = f"SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, e, j, floor_div(sum(y), count(*)) AS m FROM (SELECT p, e, unnest(range(len(x))) AS j, unnest(x) AS y FROM a{r}) GROUP BY p, e, j) GROUP BY p, e"
        mean = mean.replace("floor_div(sum(y), count(*))", "((sum(y) - (((sum(y) % count(*)) + count(*)) % count(*))) // count(*))::bigint")
        steps += [f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})", f"m{r} AS ({mean})", f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (p, e))"]
    return f"""
WITH i AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS f FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, p, list_slice(f, p * len(f) // {PARTS} + 1, (p + 1) * len(f) // {PARTS}) AS x FROM i, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM v) WHERE e < {ENTRIES}),
{", ".join(steps)},
z AS MATERIALIZED ({near.format(c=f"c{ROUNDS}")}),
o AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM z GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM o, h
"""


SQL = _sql()
QUERIES: dict[str, Callable] = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": SQL}
