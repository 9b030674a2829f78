"""Line dedup: later copies of repeated runs of lines go. DataFrame functions only.

A line is deleted if it lies in a run of whole consecutive lines of a document that has
``least_words`` words or more together and occurs earlier as well (in a document with a
smaller doc_id, or further up). So each repeated passage stays where it first stands.

The suffixes of the line-ID sequences are named by prefix doubling: names of 1 line,
then of 2, 4, 8 ... lines, each from two names of the half length, joined by position.
After each round only names that occur twice or more go on, so the tables shrink to the
repeated parts at once. Suffixes with one name are an interval of the suffix array
whose common prefix has that length at least; its smallest position is the original.
A length between two powers of 2 is the two names that overlap in it. Lines shorter than
the word limit make runs of at most ``least_words`` lines, so the rounds are few.

A line's words are its spaces between words plus one, a blank line counts as one. Null
texts have no lines and stay null. Rows without an id stay as they are. Of rows that share
a doc_id with different texts, the smallest text is the document: the others are no source
of copies and stay whole; rows with equal texts get equal results. Names are two 64-bit
hashes. Other columns, of any name, pass through ``dedup_lines``; an empty table stays
empty. A very long text is as many rows as it has lines, and its result one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.llm._store import first_texts, keep, rows_of

LEAST_WORDS = 50
_NAME = ["a", "b"]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, words and the line's name."""
    line = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = F.trim("line")
    words = F.greatest(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1, F.lit(1))
    return line.select("doc_id", "pos", words.cast("long").alias("words"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b"))


def _repeated(named: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose name occurs twice or more; the names are a table of their own, so that the join can split a common one."""
    many = keep(named.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    return named.join(many, names)


def _double(level: DataFrame, length: int) -> DataFrame:
    """Names of twice the length."""
    right = level.select("doc_id", (F.col("pos") - length).alias("pos"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return level.join(right, ["doc_id", "pos"]).select("doc_id", "pos", F.xxhash64("a", "a2").alias("a"), F.xxhash64("b", "b2", F.lit("second")).alias("b"))


def _windows(lines: DataFrame, least_words: int) -> DataFrame:
    """The shortest runs of enough words from each repeated line on, and up to each: doc_id, pos, n (lines)."""
    doc = Window.partitionBy("doc_id").orderBy("pos")
    island = lines.withColumn("island", F.col("pos") - F.row_number().over(doc))
    run = Window.partitionBy("doc_id", "island")
    summed = island.withColumn("upto", F.sum("words").over(run.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
    ahead = F.count("*").over(run.orderBy("before").rangeBetween(0, least_words - 1))
    back = F.count("*").over(run.orderBy("upto").rangeBetween(1 - least_words, 0))
    counted = summed.withColumn("ahead", ahead).withColumn("back", back)
    left = counted.where(F.col("total") - F.col("before") >= least_words).select("doc_id", "pos", F.col("ahead").alias("n"))
    right = counted.where(F.col("upto") >= least_words).select("doc_id", (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("n"))
    return left.unionByName(right).distinct()


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs: one row a doc_id. Later copies as doc_id, first_line, end_line (exclusive): maximal stretches of lines to delete."""
    one = keep(_repeated(_lines(docs.select("doc_id", F.col("text").cast("string").alias("text"))), _NAME))
    windows = keep(_windows(one, least_words))
    longest = windows.agg(F.max("n")).first()[0] or 0
    level, length, found = one.select("doc_id", "pos", "a", "b"), 1, []
    while length <= longest:
        here = windows.where((F.col("n") >= length) & (F.col("n") < 2 * length))
        tail = level.select("doc_id", F.col("pos").alias("end_pos"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        found.append(here.join(level, ["doc_id", "pos"]).withColumn("end_pos", F.col("pos") + F.col("n") - length).join(tail, ["doc_id", "end_pos"]).select("doc_id", "pos", "n", "a", "b", "a2", "b2"))
        length *= 2
        if length <= longest:
            level = keep(_repeated(_double(level, length // 2), _NAME))
    if not found:
        return windows.select("doc_id", F.col("pos").alias("first_line"), F.col("pos").alias("end_line"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    key = ["n", "a", "b", "a2", "b2"]
    every = keep(every)
    first = every.groupBy(*key).agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    later = every.join(first, key).where(F.struct("doc_id", "pos") != F.col("first"))
    doc = Window.partitionBy("doc_id").orderBy("pos", "n")
    reach = F.max(F.col("pos") + F.col("n")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.select("doc_id", "pos", "n", F.when(F.col("pos") <= reach, 0).otherwise(1).alias("opens")).withColumn("run", F.sum("opens").over(doc))
    return marked.groupBy("doc_id", "run").agg(F.min("pos").alias("first_line"), F.max(F.col("pos") + F.col("n")).alias("end_line")).drop("run")


def _kept(lines: Column, runs: Column) -> Column:
    """The lines between the runs, which are in order and apart: each line is looked at once."""
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["end_line"]))
    ends = F.concat(F.transform(runs, lambda r: r["first_line"].cast("long")), F.array(F.size(lines).cast("long")))
    return F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, (a + 1).cast("int"), (b - a).cast("int"))))


def _with_runs(docs: DataFrame, least_words: int) -> DataFrame:
    """doc_id, text, rest (a struct of the other columns, so that no name clashes) and runs, null where there are none."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(None).cast("int").alias("none")]
    one, again = first_texts(docs.where("doc_id is not null").select("doc_id", "text"))
    runs = repeated_runs(one, least_words).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_line", "end_line"))).alias("runs"))
    rows = docs.select("doc_id", "text", F.struct(*rest).alias("rest")).join(runs, "doc_id", "left")
    if again is None:
        return rows
    rows = rows.join(again.select("doc_id", F.struct("text").alias("again")), "doc_id", "left")
    its_own = F.col("again").isNull() | F.col("text").eqNullSafe(F.col("again.text"))
    return rows.withColumn("runs", F.when(its_own, F.col("runs"))).drop("again")


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with later copies taken out of ``text``; everything else as it was."""
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(_kept(F.split("text", "\n", -1), F.col("runs")), "\n"))
    own = {"doc_id": F.col("doc_id"), "text": text.alias("text")}
    return _with_runs(docs, least_words).select(*[own.get(c, F.col(f"rest.`{c}`").alias(c)) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_removed, n_runs, and the hash of the lines that stay."""
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    none = F.expr("cast(array() as array<struct<first_line: int, end_line: bigint>>)")
    split = F.when(F.col("text").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.split("text", "\n", -1))
    df = _with_runs(docs, LEAST_WORDS).withColumn("lines", split).withColumn("runs", F.coalesce(F.col("runs"), none))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end_line"] - r["first_line"])
    kept = F.when(F.size("runs") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(_kept(F.col("lines"), F.col("runs")), "\n"))
    return df.select("doc_id", F.size("lines").cast("long").alias("n_lines"), removed.alias("n_removed"), F.size("runs").cast("long").alias("n_runs"), F.sha2(kept, 256).alias("kept_sha256"))


#: Runs of 50 words or more that are as short as can be, from each line on and up to each, by their text.
SQL = """
WITH l AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM l WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, pos, greatest(len(trim(line)) - len(replace(trim(line), ' ', '')) + 1, 1) AS n FROM x),
c AS (SELECT doc_id, pos, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
f AS (SELECT a.doc_id, a.pos AS s, b.pos AS e FROM (SELECT doc_id, pos, upto - n + 50 AS goal FROM c) a ASOF JOIN c b ON a.doc_id = b.doc_id AND b.upto >= a.goal),
t AS (SELECT a.doc_id, b.pos AS s, a.pos AS e FROM (SELECT doc_id, pos, upto - 50 AS goal FROM c) a ASOF JOIN (SELECT doc_id, pos, upto - n AS before FROM c) b ON a.doc_id = b.doc_id AND b.before <= a.goal),
r AS (SELECT doc_id, s, e, md5(array_to_string(list_slice(ls, s + 1, e + 1), chr(10))) AS g FROM (SELECT * FROM f UNION SELECT * FROM t) JOIN l USING (doc_id)),
o AS (SELECT g, e - s AS m, min((doc_id, s)) AS first FROM r GROUP BY ALL HAVING count(*) > 1),
d AS (SELECT r.doc_id, s, e FROM r JOIN o ON o.g = r.g AND o.m = r.e - r.s WHERE (r.doc_id, r.s) <> first),
k AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
i AS (SELECT doc_id, s, e, sum(CASE WHEN s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM k),
m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, run),
n AS (SELECT doc_id, sum(e - s + 1) AS n_removed, count(*) AS n_runs, list(s) AS ss, list(e) AS es FROM m GROUP BY doc_id),
h AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM x JOIN n ON n.doc_id = x.doc_id WHERE len(list_filter(list_zip(ss, es), lambda p: p[1] <= pos AND pos <= p[2])) = 0 GROUP BY x.doc_id)
SELECT l.doc_id, len(ls)::bigint AS n_lines, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_runs, 0)::bigint AS n_runs,
  sha256(CASE WHEN n.doc_id IS NULL THEN coalesce(text, '') ELSE coalesce(kept, '') END) AS kept_sha256
FROM l LEFT JOIN n ON n.doc_id = l.doc_id LEFT JOIN h ON h.doc_id = l.doc_id
"""
QUERIES: dict[str, Callable] = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": SQL}
