"""Preference formatting: the common turns of two conversations once as the prompt, the rest as masked completions.

DataFrame functions only. Each conversation is one row of sorted turns; the chosen and the
rejected one of a pair meet by their pair, and the longest run of turns from the first on
that are equal in number, role and text is the common prefix. It is rendered once, the
other turns into the two completions. A completion's loss spans are the code points, from
the completion's start, of what the assistant says with its end mark; all else is masked.

Of several rows for one turn the smallest (role, text) counts. Null text is empty, a
null role is ``user``; rows without a pair or turn are skipped, and so are pairs that
lack one side. Pairs that are alike to the end have two empty completions. Other columns
are ignored; empty tables give no rows. Rows of one turn are put together before they
move; a conversation, however long, is one row, as its rendered text is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.llm._store import rows_of

# The template's marks.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


#: A bucket of ids in the search for the next one: ids alike but for their last bits.
BUCKET_BITS = 20


def conversations(turns: DataFrame) -> DataFrame:
    """turns: pair_id, turn, role, text. pair_id and its turns in order, as array<struct<turn, role, text>>."""
    said = F.struct(F.coalesce(F.lower("role"), F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    once = turns.where("pair_id is not null and turn is not null").groupBy("pair_id", "turn").agg(F.min(said).alias("said"))
    return once.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said.role", "said.text"))).alias("turns"))


def _common(a: Column, b: Column) -> Column:
    """How many turns from the first on are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))  # null where one side has ended
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(a).cast("long"))


def _shown(turns: Column) -> Column:
    """Each turn rendered, with the length of its head and whether the model learns it."""

    def one(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE))
        return F.struct(F.concat(head, t["text"], F.lit(CLOSE)).alias("shown"), F.length(head).alias("head"), (t["role"] == LEARNED_ROLE).alias("learned"))

    return F.transform(turns, one)


def _text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["shown"]), "")


def _loss(parts: Column) -> Column:
    """Start and end of what the model learns, in the parts end to end."""
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        span = F.struct((a["at"] + p["head"]).alias("start"), (a["at"] + F.length(p["shown"])).alias("end"))
        return F.struct((a["at"] + F.length(p["shown"])).alias("at"), F.when(p["learned"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(parts, none, step, lambda a: a["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, good and bad (arrays of turns). See preference_pairs; nothing is shuffled."""
    rest = lambda c: F.slice(c, F.col("n_common").cast("int") + 1, F.size(c))
    split = pairs.withColumn("n_common", _common(F.col("good"), F.col("bad")))
    shown = split.select("pair_id", "n_common", _shown(F.slice("good", 1, F.col("n_common").cast("int"))).alias("p"), _shown(rest("good")).alias("c"), _shown(rest("bad")).alias("r"))
    return shown.select("pair_id", "n_common", *[_text(F.col(x)).alias(n) for x, n in (("p", "prompt"), ("c", "chosen"), ("r", "rejected"))], _loss(F.col("c")).alias("chosen_loss"), _loss(F.col("r")).alias("rejected_loss"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen, rejected: pair_id, turn, role, text. pair_id, n_common, prompt, chosen, rejected, and both completions' loss spans."""
    left, right = conversations(chosen).withColumnRenamed("turns", "good"), conversations(rejected).withColumnRenamed("turns", "bad")
    return formatted(left.join(right, "pair_id"))


def _next_ids(ids: DataFrame) -> DataFrame:
    """pair_id (distinct longs) and the next greater one that exists, by buckets of ids and buckets of those."""

    def by(df: DataFrame, bits: int) -> DataFrame:
        return df.withColumn("next", F.lead("pair_id").over(Window.partitionBy(F.shiftright("pair_id", bits)).orderBy("pair_id")))

    level = by(ids.select("pair_id"), BUCKET_BITS)
    firsts = ids.groupBy(F.shiftright("pair_id", BUCKET_BITS).alias("bucket")).agg(F.min("pair_id").alias("pair_id")).select("pair_id")
    firsts = by(firsts, 2 * BUCKET_BITS)
    # one row for each 2^40 ids
    tops = firsts.groupBy(F.shiftright("pair_id", 2 * BUCKET_BITS).alias("top")).agg(F.min("pair_id").alias("pair_id")).select("top", F.lead("pair_id").over(Window.orderBy("pair_id")).alias("beyond"))
    firsts = firsts.join(tops, F.shiftright("pair_id", 2 * BUCKET_BITS) == F.col("top"), "left").select(F.shiftright("pair_id", BUCKET_BITS).alias("bucket"), F.coalesce("next", "beyond").alias("after"))
    return level.join(firsts, F.shiftright("pair_id", BUCKET_BITS) == F.col("bucket"), "left").select("pair_id", F.coalesce("next", "after").alias("next"))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, good and bad (arrays of turns) from plain conversations (conv_id, turn, role, text).

    Chosen is a conversation up to its last assistant turn. The rejected one parts at that turn, or,
    where the id is odd, already at the first assistant turn: there it ends in the last reply of the
    conversation with the next id that exists, or in an empty one.
    """
    whole = conversations(turns.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text"))
    said = F.transform("turns", lambda t: t["role"] == LEARNED_ROLE)
    last = F.size("turns") - F.array_position(F.reverse(said), True).cast("int") + 1
    whole = whole.where(F.array_contains(said, True)).withColumn("good", F.slice("turns", 1, last))
    cut = F.when(F.col("pair_id") % 2 == 0, F.size("good")).otherwise(F.array_position(F.transform("good", lambda t: t["role"] == LEARNED_ROLE), True).cast("int"))
    after = _next_ids(whole).withColumnRenamed("pair_id", "of").where("next is not null")
    other = whole.select(F.col("pair_id").alias("next"), F.element_at("good", -1)["text"].alias("other")).join(after, "next").select(F.col("of").alias("pair_id"), "other")
    ending = F.struct(F.element_at("good", F.col("cut"))["turn"].alias("turn"), F.lit(LEARNED_ROLE).alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    both = whole.select("pair_id", "good", cut.alias("cut")).join(other, "pair_id", "left")
    return both.select("pair_id", "good", F.concat(F.slice("good", 1, F.col("cut") - 1), F.array(ending)).alias("bad"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatted(reply_pairs(rows_of(spark, sf_dir, "conversations")))
    spans = [F.array_join(F.transform(f"{p}_loss", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(f"{p}_loss") for p in ("chosen", "rejected")]
    return found.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", "rejected", *spans)


SQL = """
WITH t AS (SELECT conv_id, turn, min(coalesce(lower(role), 'user') || chr(0) || coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
c AS (SELECT conv_id, turn, split_part(s, chr(0), 1) AS role, split_part(s, chr(0), 2) AS text FROM t),
l AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN max(turn) ELSE min(turn) END AS cut, max(turn) AS last, max_by(text, turn) AS reply FROM c WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT *, coalesce(lead(reply) OVER (ORDER BY conv_id), '') AS other FROM l),
g AS (SELECT c.*, cut, last, other, c.turn = cut AND c.text = other AS same FROM c JOIN p USING (conv_id) WHERE turn <= last),
e AS (SELECT conv_id, max(CASE WHEN same THEN 1 ELSE 0 END) AS same FROM g GROUP BY conv_id),
x AS (SELECT g.conv_id, turn, cut, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, length(role) + 5 AS head, role = 'assistant' AS learned, turn < cut OR (turn = cut AND e.same = 1) AS common FROM g JOIN e USING (conv_id)),
y AS (SELECT *, coalesce(sum(CASE WHEN common THEN 0 ELSE length(shown) END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM x),
z AS (SELECT conv_id, count(*) FILTER (common) AS n_common, coalesce(string_agg(shown, '' ORDER BY turn) FILTER (common), '') AS prompt, coalesce(string_agg(shown, '' ORDER BY turn) FILTER (NOT common), '') AS chosen,
  coalesce(string_agg((place + head)::bigint || ':' || (place + length(shown))::bigint, ',' ORDER BY turn) FILTER (NOT common AND learned), '') AS chosen_loss FROM y GROUP BY conv_id),
b AS (SELECT p.conv_id, CASE WHEN e.same = 1 THEN '' ELSE '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) END AS rejected FROM p JOIN e USING (conv_id))
SELECT conv_id, n_common, prompt, chosen, rejected, chosen_loss, CASE WHEN rejected = '' THEN '' ELSE '14:' || length(rejected) END AS rejected_loss FROM z JOIN b USING (conv_id)
"""
QUERIES: dict[str, Callable] = {"op6_preference_format": op6_preference_format}
ORACLES = {"op6_preference_format": SQL}
