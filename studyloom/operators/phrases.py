"""Phrases of source texts: runs of concept words, scored by form, place and repetition, and merged by key."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from studyloom.functions.text import key_of

# Words that part phrases.
STOP = """a an and are as at be because but by can could did do does for from has have if in into is it its of on or our the their then there these this those
to was we were with you your when where which while about over under between""".split()
# Words of a line that speaks of a picture.
PICTURES = "diagram figure chart workflow architecture pipeline graph table flowchart visual illustration screenshot whiteboard".split()
# The longest run, and what a line's bullet, shortness and picture add.
RUN, BULLET, HEADING, PICTURE = 5, 0.25, 0.2, 0.25
PER_SOURCE = 18
#: Sources of a batch that goes back to Spark.
SOURCES = 2_000


def _in(c: str, kinds: str) -> bool:
    return unicodedata.category(c).startswith(kinds)


# of a line: sentence ends part fragments, other punctuation and white space parts tokens
_MARKS = str.maketrans({c: " " for c in map(chr, range(sys.maxunicode + 1)) if c in "\t\x0b\f" or _in(c, "P")} | dict.fromkeys(".!?;", "\n"))
_LINE, _PICTURE = re.compile("\r\n|[\n\r]"), re.compile("|".join(PICTURES))
_DIGIT, _NAME = re.compile("[0-9]"), re.compile("[A-Z][a-z]+ [A-Z][a-z]+")


@lru_cache(1 << 16)
def is_concept_token(t: str) -> bool:
    """No stop word, and long, in part a number or a symbol, or with a capital; of two characters or fewer only numbers."""
    if t.lower() in STOP:
        return False
    if len(t) <= 2:
        return all(_in(c, "N") for c in t)
    return len(t) >= 4 or "+" in t or _in(t[0], "Lu") or any(_in(c, "N") for c in t)


def occurrences(text: str, visual: bool) -> Iterator[tuple[int, float, list[str]]]:
    """Line, boost and words of every phrase of a text, in order.

    A line is cut at sentence ends, a fragment at words that are none of a concept, and a run after five words.
    """
    for line, raw in enumerate(_LINE.split(text)):
        raw = raw.strip(" \t")
        if not raw:
            continue
        short = len(raw) <= 60 and sum(w != "" for w in raw.split(" ")) <= 8
        shown = visual and _PICTURE.search(raw.lower())
        boost = (BULLET if raw[0] in "•-*" else 0.0) + (HEADING if short else 0.0) + (PICTURE if shown else 0.0) + max(0, 6 - line) * 0.01
        for said in raw.translate(_MARKS).split("\n"):
            run: list[str] = []
            for t in said.split(" "):
                if t and is_concept_token(t):
                    run.append(t)
                    if len(run) == RUN:
                        yield line, boost, run
                        run = []
                elif t and run:
                    yield line, boost, run
                    run = []
            if run:
                yield line, boost, run


def _form(title: str, ts: list[str]) -> tuple[float, float]:
    """What the form of a phrase gives for its base and its detail."""
    n = len(ts)
    digit = _DIGIT.search(title)
    number = digit or (not title.isascii() and any(_in(c, "N") for c in title))
    capital = any(len(t) > 1 and t.isupper() and all(_in(c, "Lu") for c in t) for t in ts)
    base = 0.6 + (0.35 if n > 1 else 0.0) + (0.15 if n > 2 else 0.0) + (0.2 if number else 0.0) + (0.2 if capital else 0.0) + (0.05 if len(title) <= 24 else 0.0)
    detail = 0.15 + (0.15 if n > 1 else 0.0) + (0.1 if digit else 0.0) + (0.15 if _NAME.search(title) else 0.0)
    return base, detail


def _scored(text: str | None, weight: float | None, visual: bool | None, k: int) -> list[tuple]:
    """key, title, n_tokens, score, detail and lines of the phrases of a text that can be among the k first."""
    found: dict[str, list] = {}
    titled: dict[str, list] = {}
    for line, boost, ts in occurrences(text, bool(visual)) if text is not None else ():
        title = " ".join(ts)
        one = titled.get(title)
        if one is None:
            one = titled[title] = found.setdefault(key_of(title), [title, ts, 0.0, 0, []])
        one[2] += boost
        one[3] += 1
        if not one[4] or one[4][-1] != line:
            one[4].append(line)
    found.pop("", None)
    rows = []
    for key, (title, ts, boost, n, lines) in found.items():
        if len(title) >= 2:
            base, detail = _form(title, ts)
            again = (n * (n - 1) / 2 if n <= 4 else 6 + 3 * (n - 4)) * 0.08
            rows.append((key, title, len(ts), None if weight is None else (base + boost + again) * weight, detail, lines))
    if weight is None or len(rows) <= k:
        return rows
    # scores are ranked by nine digits; what is less than the k-th by more than that can't be among the first
    least = nlargest(k, (r[3] for r in rows))[-1] - 1e-8
    return [r for r in rows if r[3] >= least]


_FOUND = "array<struct<key: string, title: string, n_tokens: int, score: double, detail: double, lines: array<int>>>"


def phrases(sources: DataFrame, k: int = PER_SOURCE) -> DataFrame:
    """sources: source_id (its key), kind, text, weight, visual. Of each source the k most important phrases.

    source_id, rank, key, title, n_tokens, importance, detail, kind, lines. A phrase has the form's score of its first
    occurrence, the boosts of all, and .08 more for each repetition, up to .24. Ties by title. All is found in the
    source's row: nothing is shuffled.
    """
    known = sources.select("source_id", "kind")
    schema = T.StructType([*known.schema, T.StructField("found", T._parse_datatype_string(_FOUND))])
    kind = to_arrow_schema(schema).field("found").type

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, SOURCES) for i in range(0, whole.num_rows, SOURCES)):
                found = [_scored(*source, k) for source in zip(*[batch.column(c).to_pylist() for c in ("text", "weight", "visual")], strict=True)]
                at = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                fields = list(zip(*[r for f in found for r in f], strict=True)) or [()] * kind.value_type.num_fields
                arrays = [pa.array(list(v), f.type) for v, f in zip(fields, kind.value_type, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("kind"), lists.cast(kind)], names=["source_id", "kind", "found"])

    found = sources.select("source_id", "kind", "text", "weight", "visual").mapInArrow(rows, schema)
    placed = F.transform("found", lambda x: F.struct((-F.round(x["score"], 9)).alias("last"), F.lower(x["title"]).alias("lower"), x["title"].alias("title"), x.alias("x")))
    first = found.select("source_id", "kind", F.posexplode(F.slice(F.array_sort(placed), 1, k)).alias("nth", "p"))
    return first.select("source_id", (F.col("nth") + 1).alias("rank"), "p.x.key", "p.title", "p.x.n_tokens", F.round("p.x.score", 9).alias("importance"), "p.x.detail", "kind", "p.x.lines")


def merge_phrases(found: DataFrame, group: str) -> DataFrame:
    """found: rows of ``phrases`` with a column that groups sources. One row a group and key: best scores, longest title (first source of equals), kinds and sources."""
    longest = F.max_by("title", F.struct(F.length("title"), (-F.col("source_id")).alias("s")))
    one = found.groupBy(group, "key").agg(longest.alias("title"), F.max("n_tokens").alias("n_tokens"), F.max("importance").alias("importance"), F.max("detail").alias("detail"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("importance"), F.lower("title"), "title")))
