"""Ranked search for a table of queries (query_id, query) over documents (doc_id, text)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import text as fn
from studyloom.operators.text import counted_terms
from studyloom.sources.store import keep

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
#: Rows of the blocks that meet in a task.
BLOCK_QUERIES, BLOCK_VECTORS = 1024, 20_000


def build_index(docs: DataFrame) -> DataFrame:
    """docs: doc_id (its key), text. Postings: doc_id, term, tf, counted in the document's row."""
    return counted_terms(docs).select("doc_id", "term", F.col("n").alias("tf"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, term, n_terms: distinct terms, all of which a hit must have."""
    t = F.array_distinct(F.filter(F.split(fn.norm_key(F.col("query")), " "), lambda w: w != ""))
    return queries.select("query_id", F.explode(t).alias("term"), F.size(t).alias("n_terms"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score: documents with all terms of a query, best first.

    Lengths and document frequencies come from all documents. A posting has its document's
    length with it, and meets the queries by its term; only asked terms go any further.
    """
    asked = query_tokens(queries)
    length = F.size(F.filter(F.split(fn.norm_key(F.coalesce("text", F.lit(""))), " "), lambda w: w != ""))
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg(length).alias("avg_dl"))  # one row
    wanted = asked.select("term").distinct()
    postings = keep(counted_terms(docs).select("doc_id", "term", F.col("n").alias("tf"), F.col("n_words").alias("dl")).join(wanted, "term"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    hits = asked.join(postings, "term").join(df, "term").crossJoin(F.broadcast(totals))
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = hits.groupBy("query_id", "doc_id", "n_terms").agg(F.sum(part).alias("score"), F.count("*").alias("n")).where("n = n_terms")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def fuse(hits: DataFrame, k: int) -> DataFrame:
    """hits: query_id, hit_id, score, source. Best score by hit, sources together, the k first."""
    best = hits.groupBy("query_id", "hit_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def recent(df: DataFrame, ts: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(ts), key).limit(k)


def _nine(x: np.ndarray) -> np.ndarray:
    """Rounded to nine digits as Spark does, halves away from zero."""
    values, at = np.unique(x, return_inverse=True)
    return np.array([v if not np.isfinite(v) else float(Decimal(repr(float(v))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for v in values], float)[at]


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors one after the other, where each begins, and whether it and all its components are there."""
    held = column.combine_chunks()
    n = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = held.flatten()
    at = np.concatenate([[0], np.cumsum(n)])
    lacking = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = held.is_valid().to_numpy(zero_copy_only=False) & (lacking[at[1:]] == lacking[at[:-1]])
    return flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), at, whole


def _nearest_of(k: int):
    def nearest(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """The k first of these vectors for each of these queries: by the score to nine digits, then by id."""
        (q, q_at, q_on), (v, v_at, v_on) = _vectors(queries.column("q")), _vectors(vectors.column("e"))
        q_id, v_id = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
        norm = lambda x, at: np.array([np.sqrt((x[a:b] * x[a:b]).sum()) for a, b in zip(at[:-1], at[1:], strict=True)], float)
        q_norm, v_norm, n = norm(q, q_at), norm(v, v_at), np.diff(v_at)
        of = {m: (i := np.flatnonzero(v_on & (n == m)), v[(v_at[i][:, None] + np.arange(m)).astype(np.int64)]) for m in np.unique(n)}
        out = []
        for x in range(len(q_id)):
            score = np.zeros(len(v_id))
            if q_on[x]:
                both = q_norm[x] * v_norm
                on = v_on & ~(both <= 0)
                score[on] = -np.inf  # vectors of another length have none
                i, rows = of.get(q_at[x + 1] - q_at[x], (np.empty(0, np.int64), None))
                if len(i):
                    with np.errstate(all="ignore"):
                        score[i] = np.where(on[i], rows @ q[q_at[x] : q_at[x + 1]] / both[i], 0.0)
            order = np.where(np.isnan(score), np.inf, score)
            other = np.flatnonzero(v_id != q_id[x])
            if len(other) > k:
                other = other[order[other] >= np.partition(order[other], -k)[-k] - 2e-9]
            best = other[np.lexsort((v_id[other], -_nine(order[other])))[:k]]
            out.append((np.full(len(best), q_id[x]), v_id[best], score[best]))
        a, b, c = map(np.concatenate, zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64(), mask=c == -np.inf)], names=["query_id", "vec_id", "score"])

    return nearest


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """queries and vectors: vec_id, embedding. The k nearest by cosine; 0 where a norm is 0 or unknown.

    Every query meets every vector: both are dealt to blocks, and two blocks give the k first of each query there.
    """
    of_queries, of_vectors = max(1, -(-queries.count() // BLOCK_QUERIES)), max(8, -(-vectors.count() // BLOCK_VECTORS))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"), block("vec_id", of_queries).alias("i"), each(of_vectors).alias("j"))
    v = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"), block("vec_id", of_vectors).alias("j"), each(of_queries).alias("i"))
    found = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(_nearest_of(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
