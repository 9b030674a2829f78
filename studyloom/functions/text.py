"""Column functions over text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOP_WORDS = (
    "a an and are as at be because but by can could did do does for from had has have how i if in into is it its may might of on or our so "
    "than that the their there these this those to was were what when where which who why with you your"
).split()


def norm_key(c: Column) -> Column:
    """Lower case; everything but letters and digits is one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


_NO_KEY = re.compile(r"[\W_]+")  # letters and digits are the same characters as in norm_key


def key_of(text: str) -> str:
    """norm_key of a string in a task's batch."""
    lower = text.lower()
    return lower if lower.isalnum() else _NO_KEY.sub(" ", lower).strip(" ")


def spaced(text: str) -> str:
    """A string's letters and digits as they are, everything else one space."""
    return _NO_KEY.sub(" ", text).strip(" ")


def words(c: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def sentence_array(c: Column) -> Column:
    """Trimmed, non-empty pieces between full stops, marks and line ends."""
    return F.filter(F.transform(F.split(c, r"[.!?\n]"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def content_hash(title: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.trim(F.coalesce(title, F.lit(""))), F.lit("␞"), F.coalesce(text, F.lit(""))), 256)


def token_estimate(text: Column, kind: Column | None = None, rows: Column | None = None, counted: Column | None = None) -> Column:
    """The larger of a quarter of the characters and 1.25 a word, at least 1; with a factor by block kind. counted: its words, where they are known."""
    base = F.greatest(F.ceil(F.length(text) / 4.0), F.ceil((n_words(text) if counted is None else counted) * 1.25), F.lit(1))
    if kind is None:
        return base
    by_kind = F.when(kind == "codeBlock", F.ceil(F.length(text) / 3.2)).when(kind == "table", F.ceil(base * 1.2 + F.greatest(F.lit(1), rows if rows is not None else F.lit(1)) * 2.0))
    by_kind = by_kind.when(kind == "heading", base + 2).when(kind.isin("bulletedList", "numberedList"), F.ceil(base * 1.1)).when(kind == "equation", F.ceil(base * 1.15)).when(kind == "quote", F.ceil(base * 1.05))
    return F.greatest(F.lit(1), by_kind.otherwise(base))


def approx_tokens(text: Column, mode: str = "words") -> Column:
    """Three quarters of the words, or at least one for each four words."""
    n = n_words(text)
    return F.floor(n * 3 / 4) if mode == "words" else F.greatest(F.lit(1), F.floor(n / 4))


def difficulty(sentence_length: Column, density: Column, n: Column) -> Column:
    score = sentence_length / 18.0 + density * 1.75 + F.least(F.lit(0.45), F.greatest(n, F.lit(0)) / 300.0)
    return F.when(score < 1.0, "easy").when(score < 1.8, "moderate").when(score < 2.6, "challenging").otherwise("advanced")


def strip_marks(c: Column) -> Column:
    """Without [n] citation marks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\[\d+\]", ""), r"\s+", " "))


def fragment(c: Column, most: int = 120) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def snippet(text: Column, query: Column) -> Column:
    """The first 180 characters, or 48 before to 132 after the first hit; dots where cut."""
    flat = F.trim(F.translate(text, "\n", " "))
    hit = F.instr(F.lower(flat), F.lower(query)) - 1
    start = F.greatest(F.lit(0), hit - 48)
    end = F.least(F.length(flat), hit + 132)
    head = F.concat(F.substring(flat, 1, 180), F.when(F.length(flat) > 180, "...").otherwise(""))
    middle = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(flat, start + 1, end - start), F.when(end < F.length(flat), "...").otherwise(""))
    return F.when(flat == "", "Empty result").when((query == "") | (hit < 0), head).otherwise(middle)


def jaccard(a: Column, b: Column) -> Column:
    """Of the token sets of two normalised keys; .82 at least where one key contains the other."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    score = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), F.greatest(score, F.lit(0.82))).otherwise(score)


def max_overlap(a: Column, b: Column) -> Column:
    """Shared terms over the larger set."""
    x, y = F.array_distinct(F.split(norm_key(a), " ")), F.array_distinct(F.split(norm_key(b), " "))
    return F.when((norm_key(a) == "") | (norm_key(b) == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def edit_class(a: Column, b: Column) -> Column:
    """Null where equal; lightlyEdited up to a quarter of the longer text, else heavilyEdited."""
    a, b = F.trim(a), F.trim(b)
    ratio = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a != b, F.when(ratio <= 0.25, "lightlyEdited").otherwise("heavilyEdited"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    step = lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step)).otherwise(0)
