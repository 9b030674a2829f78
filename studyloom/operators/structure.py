"""Blocks of documents (doc_id, text): line kinds, then runs of lines of one kind (gaps and islands).

A document's lines are one row's text, so its lines' kinds and its islands are found in the
row, in one pass, and no line is shuffled; windows over blocks or headings partition by document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from studyloom.functions.text import n_words, norm_key, sentence_array, token_estimate
from studyloom.operators.text import from_text
from studyloom.sources.store import keep

_NUMBERED = r"^\d+(?:\.\d+)*[.)]?\s+"
# as Spark's expressions have them: digits and white space of ASCII, and an end before a last line end
_NUMBER, _WORD, _BULLET, _LISTED = (re.compile(p, re.ASCII) for p in (_NUMBERED, r"\S+", r"[-*+]\s", r"\d+[.)]\s"))
_OPERATOR, _CLOSED = re.compile("[=→⇒+−×÷^]"), re.compile("[.?!](?:\r|\x85|\u2028|\u2029)?\\Z")


def _of(c: str, kinds: str) -> bool:
    return unicodedata.category(c).startswith(kinds)


def heading_level(t: str) -> int | None:
    """Level of a heading line, None for others; line without outer blanks."""
    if t.startswith("#"):
        return len(t) - len(t.lstrip("#")) if t.lstrip("# ") else None
    if number := _NUMBER.match(t):
        rest = t[number.end() :].strip(" ")
        parts = sum(p != "" for p in number[0].strip(" ").split("."))
        return max(1, parts) if rest and _of(rest[0], "Lu") else None
    if t == "" or not _of(t[0], "Lu"):
        return None
    if t.endswith(":") and len(t) <= 80:
        return 1
    short = len(t) <= 72 and word_count(t) <= 8 and not any(_of(c, "P") for c in t)
    return 1 if short else None


def heading_title(line: Column) -> Column:
    """Of a heading line."""
    return F.trim(F.when(line.startswith("#"), F.regexp_replace(line, "^[# ]+", "")).when(line.rlike(_NUMBERED), F.regexp_replace(line, _NUMBERED, "")).when(line.endswith(":"), F.regexp_replace(line, ":$", "")).otherwise(line))


def word_count(text: str) -> int:
    """n_words of a string in a task's batch."""
    return len(_WORD.findall(text))


def is_table_row(t: str) -> bool:
    return t.count("|") >= 2 and sum(c != "" for c in t.split("|")) >= 3


def is_equation(t: str) -> bool:
    if t.startswith(("$", "\\[")):
        return True
    operators = len(_OPERATOR.findall(t))
    return operators > 0 and not _CLOSED.search(t) and (operators >= 2 or word_count(t) <= 12)


def line_kind(t: str) -> str:
    """Of a line without outer blanks outside code fences: equation, heading, quote, lists, table, paragraph or blank."""
    if t == "":
        return "blank"
    if is_equation(t):
        return "equation"
    if heading_level(t) is not None:
        return "heading"
    if t[0] == ">":
        return "quote"
    if _BULLET.match(t):
        return "bulletedList"
    if _LISTED.match(t):
        return "numberedList"
    return "table" if is_table_row(t) else "paragraph"


def lines_of(text: str) -> Iterator[tuple[int, str, str, int | None]]:
    """Number, line, kind and code fence of each line: a fold, since a fence's marks tell what is code."""
    marks = 0
    for i, line in enumerate(text.split("\n")):
        t = line.strip(" ")
        if mark := t.startswith("```"):
            marks += 1
        code = mark or marks % 2 == 1
        yield i, line, "codeBlock" if code else line_kind(t), (marks + 1) // 2 if code else None


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line and kind; lines of a code fence, its marks too, are codeBlock."""
    return from_text(docs.where("text is not null"), F.col("text"), lines_of, "line_no int, line string, kind string, fence long")


def _blocks_of(text: str) -> Iterator[tuple[str, int, int, str, int]]:
    """Kind, first and last line, content and number of words of each run of lines of one kind."""
    for (kind, _, _), run in groupby(lines_of(text), lambda x: (x[2], x[3], x[0] if x[2] == "heading" else None)):
        if kind != "blank":
            held = list(run)
            content = "\n".join(x[1] for x in held)
            yield kind, held[0][0], held[-1][0], content, word_count(content)


def detect_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_id, kind, start_line, end_line, content, tokens; headings stand alone, blank lines part blocks."""
    found = from_text(docs.where("text is not null"), F.col("text"), _blocks_of, "kind string, start_line int, end_line int, content string, n_words int")
    tokens = token_estimate(F.col("content"), F.col("kind"), F.col("end_line") - F.col("start_line") + 1, F.col("n_words"))
    return found.select("doc_id", F.concat_ws("-", "kind", "start_line", "end_line").alias("block_id"), "kind", "start_line", "end_line", "content", tokens.alias("tokens"))


def split_sections(blocks: DataFrame) -> DataFrame:
    """Each block with the line of the heading that it stands under, -1 before the first."""
    order = Window.partitionBy("doc_id").orderBy("start_line")
    return blocks.withColumn("section_line", F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("start_line")), ignorenulls=True).over(order), F.lit(-1)))


def section_tokens(sectioned: DataFrame) -> DataFrame:
    return sectioned.groupBy("doc_id", "section_line").agg(F.count("*").alias("n_blocks"), F.sum("tokens").alias("tokens"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def chunk_boundaries(blocks: DataFrame, target: int) -> DataFrame:
    """Chunk number of each block: a new one at a heading, or where the running tokens would pass the target.

    The sum starts anew at each cut, so it is a fold over the document's own blocks.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "block_id", "kind", "tokens")))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("chunk"), F.expr("cast(array() as array<struct<block_id: string, chunk: int, hard: boolean>>)").alias("out"))

    def step(a: Column, b: Column) -> Column:
        hard = b["kind"] == "heading"
        cut = (F.size(a["out"]) > 0) & (hard | (a["sum"] + b["tokens"] > target))
        chunk = a["chunk"] + F.when(cut, 1).otherwise(0)
        return F.struct(F.when(cut, b["tokens"]).otherwise(a["sum"] + b["tokens"]).cast("long").alias("sum"), chunk.alias("chunk"), F.concat(a["out"], F.array(F.struct(b["block_id"].alias("block_id"), chunk.alias("chunk"), (cut & hard).alias("hard")))).alias("out"))

    folded = blocks.groupBy("doc_id").agg(ordered.alias("bs")).select("doc_id", F.aggregate("bs", start, step, lambda a: a["out"]).alias("out"))
    return folded.select("doc_id", F.explode("out").alias("o")).select("doc_id", "o.*")


def changed_only(docs: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents whose content hash isn't among the processed ones."""
    return docs.join(processed.select("content_hash").distinct(), "content_hash", "left_anti")


@F.pandas_udf(StringType())
def fold_diacritics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower case without accents."""
    for series in texts:
        yield series.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)))


def fold_key(c: Column) -> Column:
    """The normalised key of a text without accents."""
    return norm_key(fold_diacritics(c))


# Characters of prose and their plain forms.
PLAIN = str.maketrans({" ": " ", "\t": " ", "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "…": "...", "•": "-", "·": "-"})
CODE = str.maketrans({" ": " ", "\t": "    "})


def normalized(text: str) -> str:
    """One text: a fold over its lines, since a fence's marks tell what is code."""
    out: list[str] = []
    code = False
    for line in unicodedata.normalize("NFKC", re.sub("\r\n?", "\n", text)).split("\n"):
        if line.strip().startswith("```"):
            out.append(line.strip())
            code = not code
            continue
        line = line.translate(CODE).strip() if code else re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", line.translate(PLAIN))).strip()
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out).strip("\n")


@F.pandas_udf(StringType())
def normalize_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Line ends, quotes, dashes, dots and bullets in ASCII, single spaces, no space before a mark, no runs of blank lines.

    A line that begins with three backticks opens or closes code, where only tabs (four spaces) and outer spaces change.
    """
    for series in texts:
        yield series.map(lambda t: None if t is None else normalized(t))


def section_slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def _headings_of(text: str) -> Iterator[tuple[int, str, int]]:
    for i, line, kind, _ in lines_of(text):
        if kind == "heading":
            t = line.strip(" ")
            yield i, t, heading_level(t)


def section_tree(docs: DataFrame) -> DataFrame:
    """doc_id, section_id, line, level, title, parent_line: headings as a tree; the parent is the last one before of a smaller level (-1: none)."""
    heads = from_text(docs.where("text is not null"), F.col("text"), _headings_of, "line int, t string, level int")
    heads = heads.select("doc_id", "line", F.least(F.lit(6), "level").alias("level"), heading_title(F.col("t")).alias("title"))
    doc = Window.partitionBy("doc_id").orderBy("line")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    # of each level the last heading so far; the nearest of those above is the parent
    last = [F.last(F.when(F.col("level") == k, F.col("line")), ignorenulls=True).over(before) for k in range(1, 6)]
    parent = F.array_max(F.array(*[F.when(F.col("level") > k, F.coalesce(at, F.lit(-1))).otherwise(-1) for k, at in enumerate(last, 1)]))
    named = F.concat_ws("-", F.lit("section"), "level", F.row_number().over(doc), section_slug(F.col("title")))
    return heads.select("doc_id", named.alias("section_id"), "line", "level", "title", parent.alias("parent_line"))


def block_views(docs: DataFrame) -> DataFrame:
    """doc_id, view, line, text: each heading, list item, equation, quote, table row and code line by itself."""
    kept = F.col("kind").isin("heading", "bulletedList", "numberedList", "codeBlock", "equation", "table", "quote")
    return lines(docs).where(kept & ~F.trim("line").startswith("```")).select("doc_id", F.col("kind").alias("view"), F.col("line_no").alias("line"), F.trim("line").alias("text"))


def section_complexity(sectioned: DataFrame) -> DataFrame:
    """sectioned: that of split_sections. Words, sentences, tokens, share of structured blocks and minutes of each section."""
    signal = F.col("kind") != "paragraph"
    sums = sectioned.groupBy("doc_id", "section_line").agg(F.sum(n_words(F.col("content"))).alias("n_words"), F.sum(F.size(sentence_array(F.col("content")))).alias("n_sentences"), F.sum("tokens").alias("tokens"), F.count_if(signal).alias("n_signals"), F.count("*").alias("n_blocks"))
    return sums.withColumn("density", F.least(F.lit(1.0), F.col("n_signals") / F.greatest(F.lit(1), F.col("n_sentences")))).withColumn("minutes", F.greatest(F.lit(1), F.ceil(F.col("n_words") / 180.0)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, first_line, last_line: runs of lines between blank ones; a speaker's name with a colon begins a new one."""
    df = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    t = F.trim("line")
    speaker = t.rlike(r"^\p{Lu}[^:]*:") & (F.length(t) < 80)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    opens = (t == "") | speaker | (F.trim(F.lag("line").over(order)) == "")
    marked = df.withColumn("run", F.sum(F.coalesce(opens, F.lit(True)).cast("int")).over(order)).where(F.trim("line") != "")
    return marked.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).drop("run")


def validate_structure(blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """blocks: doc_id, block_id, start_line, end_line, tokens. tree: that of section_tree. doc_id, rule, n of each breach."""
    count = lambda df, rule: df.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(rule).alias("rule"), "n")
    order = Window.partitionBy("doc_id").orderBy("start_line", "block_id")
    same = Window.partitionBy("doc_id", "block_id").orderBy("start_line")
    blocks = blocks.select("doc_id", "block_id", "start_line", "end_line", "tokens")
    marked = blocks.withColumn("before", F.lag("end_line").over(order)).withColumn("nth", F.row_number().over(same))
    # all rules of blocks in one pass; a repeated block counts once, with its second row
    breaches = {"repeated block": F.col("nth") == 2, "lines out of order": F.col("end_line") < F.col("start_line"), "overlapping blocks": F.col("before") >= F.col("start_line"), "no tokens": (F.col("tokens") < 1) | F.col("tokens").isNull()}
    counted = marked.groupBy("doc_id").agg(F.array(*[F.struct(F.lit(rule).alias("rule"), F.count_if(c).alias("n")) for rule, c in breaches.items()]).alias("found"))
    tree = keep(tree)
    parents = tree.select("doc_id", F.col("line").alias("parent_line"), F.col("level").alias("above"))
    linked = tree.where("parent_line >= 0").join(parents, ["doc_id", "parent_line"], "left")
    rules = [
        counted.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.rule", "f.n").where("n > 0"),
        count(linked.where("above is null"), "unknown parent"),
        count(linked.where("above >= level"), "parent not above"),
        count(tree.groupBy("doc_id", "section_id").count().where("count > 1"), "repeated section"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out
