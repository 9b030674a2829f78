"""Generated text as rows: repair of nearly valid JSON, and cards, quiz and tutor questions and insights from any of its forms.

A response is JSON (an array of one kind, or an object of all), JSON in a code fence or between
other words, JSON under a section's heading, or blocks of "key: value" lines between dashes or
blank lines. Whatever of it can be read gives rows; ``failed`` tells where nothing could.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from studyloom.functions.text import norm_key

CARD = "struct<type: string, front: string, back: string, whyItMatters: string>"
QUIZ = "struct<type: string, prompt: string, options: array<string>, correctAnswer: string, explanation: string, keywords: array<string>>"
TUTOR = "struct<prompt: string, expectedAnswer: string, keyPoints: array<string>, explanation: string, concept: string>"
INSIGHTS = "struct<keyConcepts: array<string>, importantConcepts: array<string>, potentialExamTopics: array<string>, knowledgeGaps: array<string>>"
# Where each kind stands in an object of all, and the headings of its section.
KINDS = {
    "cards": ("flashcards", CARD, ["flashcards", "cards"]),
    "quiz": ("quizQuestions", QUIZ, ["mcqs", "multiple choice questions", "multiple choice", "quiz questions", "short answer questions", "short answer", "free response questions"]),
    "tutor": ("tutorQuestions", TUTOR, ["short answer questions", "short answer", "free response questions"]),
}
# Sections of insights, by the name of their column; keys that don't end a section.
INSIGHT_TITLES = {"keyConcepts": "key concepts", "importantConcepts": "important concepts", "potentialExamTopics": "potential exam topics", "knowledgeGaps": "knowledge gaps"}
_SCAN = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|[{}\[\]]', re.S)  # a string that doesn't end goes on to the text's end


def _balanced(text: str) -> str | None:
    """From the first bracket to the one that closes it; brackets in strings don't count."""
    depth = start = 0
    for m in _SCAN.finditer(text):
        c = m[0]
        if c in "{[":
            start = start if depth else m.start()
            depth += 1
        elif c in "}]" and depth:
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
    return None


@F.pandas_udf(StringType())
def balanced(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first balanced object or array of a text; a lone quote before it doesn't hide it."""
    for series in texts:
        yield series.map(lambda t: None if t is None else _balanced(t[min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=len(t)) :]))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n"))


def _lines_of(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def repair_json(text: Column) -> Column:
    """Near-JSON made valid: without fences, words around it, commas before a closing bracket, and NULs; null where no bracket closes."""
    bare = F.regexp_replace(text, "```(?:json|JSON)?", "")
    outer = lambda a, b: F.nullif(F.regexp_extract(bare, rf"(?s)\{a}.*\{b}", 0), F.lit(""))
    cut = F.coalesce(balanced(bare), outer("{", "}"), outer("[", "]"))
    return trimmed(F.replace(F.regexp_replace(cut, r'("(?s:[^"\\]++|\\.)*+(?:"|\\?\z))|,(?=\s*[}\]])', "$1"), F.lit("\x00"), F.lit("")))


def repaired(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds json (null where it can't be made valid) and failed."""
    df = df.withColumn("json", repair_json(F.col(text)))
    good = F.expr("try_parse_json(json) is not null")
    return df.withColumn("json", F.when(good, F.col("json"))).withColumn("failed", F.col("json").isNull())


def _fenced(norm: Column) -> Column:
    return F.nullif(F.regexp_extract(norm, r"(?is)(?:^|\n)[ \t]*```(?:json[^\n]*|[ \t]*)\n(.*?)\n?[ \t]*```[ \t]*(?:\n|$)", 1), F.lit(""))


def _heading(line: Column) -> Column:
    return F.lower(trimmed(F.replace(F.regexp_replace(trimmed(line), r"^[#>\-\s]+", ""), F.lit(":"), F.lit(""))))


def _section(norm: Column, titles: list[str]) -> Column:
    """What stands under the first heading of these names."""
    lines = F.split(norm, "\n", -1)
    first = F.array_position(F.transform(lines, lambda x: _heading(x).isin(titles)), True)
    return F.when(first > 0, F.array_join(F.slice(lines, (first + 1).cast("int"), F.size(lines)), "\n"))


def _items(payload: Column, field: str, schema: str) -> Column:
    """Items of an array, or of the field of an object; null where neither can be read."""
    whole = F.from_json(payload, f"struct<{field}: array<{schema}>>")[field]
    return F.when(payload.startswith("["), F.from_json(payload, f"array<{schema}>")).when(payload.startswith("{"), whole)


def _blocks(norm: Column) -> Column:
    """Parts between dashes, or else between blank lines, as arrays of key and value."""
    full = lambda c: F.filter(F.transform(c, trimmed), lambda b: b != "")
    parts = _once(full(F.split(norm, "---", -1)), lambda dashed: F.when(F.size(dashed) > 1, dashed).otherwise(full(F.split(norm, "\n\n", -1))))

    def fields(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n", -1), lambda x: x.contains(":"))
        return F.transform(lines, lambda x: F.struct(F.lower(trimmed(F.substring_index(x, ":", 1))).alias("k"), trimmed(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))

    return F.transform(parts, fields)


def _field(block: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(block, lambda e: e["k"] == key), F.lit(-1))["v"], F.lit(""))


def _listed(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), trimmed), lambda x: x != "")


def card_type(c: Column) -> Column:
    c = F.lower(c)
    return F.when(c.contains("definition"), "definition").when(c.contains("cloze"), "cloze").when(c.contains("concept"), "concept").otherwise("question_answer")


def quiz_type(c: Column) -> Column:
    c = F.lower(c)
    return F.when(c.rlike("multiple|choice|mcq"), "multiple_choice").when(c.rlike("true|false"), "true_false").otherwise("short_answer")


def resolve_answer(answer: Column, options: Column, kind: Column) -> Column:
    """An option by itself, by its letter or by its key; true or false by the word; else the answer as it is."""
    letter = F.ascii(F.upper(answer)) - F.ascii(F.lit("A"))
    by_letter = F.when((letter >= 0) & (letter < F.least(F.lit(26), F.size(options))), F.get(options, letter))
    by_key = F.get(F.filter(options, lambda o: norm_key(o) == norm_key(answer)), F.lit(0))
    choice = F.when(F.array_contains(options, answer), answer).otherwise(F.coalesce(by_letter, by_key, answer))
    truth = F.when(F.lower(answer).contains("true"), "True").when(F.lower(answer).contains("false"), "False").otherwise(answer)
    return F.when(kind == "multiple_choice", choice).when(kind == "true_false", truth).otherwise(answer)


def _card(b: Column) -> Column:
    return F.struct(_once(_field(b, "type"), card_type).alias("type"), _field(b, "front").alias("front"), _field(b, "back").alias("back"), _field(b, "why").alias("whyItMatters"))


def _quiz(b: Column) -> Column:
    options = F.filter(F.array(*[_field(b, f"option{x}") for x in "abcd"]), lambda o: o != "")
    asked = F.struct(_once(_field(b, "type"), quiz_type).alias("kind"), options.alias("options"), _field(b, "answer").alias("answer"))

    def item(x: Column) -> Column:
        kind, options = x["kind"], x["options"]
        shown = F.when((kind == "true_false") & (F.size(options) == 0), F.array(F.lit("True"), F.lit("False"))).otherwise(options)
        answer = resolve_answer(x["answer"], options, kind)
        return F.struct(kind.alias("type"), _field(b, "prompt").alias("prompt"), shown.alias("options"), answer.alias("correctAnswer"), _field(b, "explanation").alias("explanation"), _listed(_field(b, "keywords")).alias("keywords"))

    return _once(asked, item)


def _tutor(b: Column) -> Column:
    return F.struct(_field(b, "prompt").alias("prompt"), _field(b, "expectedanswer").alias("expectedAnswer"), _listed(_field(b, "keypoints")).alias("keyPoints"), _field(b, "explanation").alias("explanation"), _field(b, "concept").alias("concept"))


_FROM_BLOCK = {"cards": _card, "quiz": _quiz, "tutor": _tutor}
#: Without these an item is none.
NEEDED = {"cards": ["front", "back"], "quiz": ["prompt", "correctAnswer"], "tutor": ["prompt", "expectedAnswer"]}


def parse_items(responses: DataFrame, kind: str) -> DataFrame:
    """responses: id, text. id, failed and items, an array of cards, quiz or tutor questions."""
    field, schema, titles = KINDS[kind]
    norm = responses.select("id", _lines_of(F.coalesce("text", F.lit(""))).alias("norm"))
    # the repaired whole, and only where that gives nothing its section
    whole = norm.withColumn("payload", repair_json(F.coalesce(_fenced(F.col("norm")), F.col("norm")))).withColumn("section", repair_json(_section(F.col("norm"), titles)))
    items_of = lambda c: _once(F.col(c), lambda x: _items(x, field, schema))
    asked = NEEDED[kind]
    sound = lambda items: F.filter(items, lambda x: F.reduce(F.array(*[trimmed(F.coalesce(x[a], F.lit(""))) != "" for a in asked]), F.lit(True), lambda a, b: a & b))
    read = F.coalesce(sound(F.coalesce(items_of("payload"), items_of("section"))), F.expr(f"cast(array() as array<{schema}>)"))
    blocks = F.transform(_blocks(F.col("norm")), _FROM_BLOCK[kind]).cast(f"array<{schema}>")
    found = _once(read, lambda x: F.when(F.size(x) > 0, x).otherwise(sound(blocks)))
    return whole.select("id", found.alias("items")).withColumn("failed", F.size("items") == 0)


def item_rows(parsed: DataFrame) -> DataFrame:
    """id, nth (from 0) and the fields of each item."""
    return parsed.select("id", F.posexplode("items").alias("nth", "item")).select("id", "nth", "item.*")


def parse_insights(responses: DataFrame) -> DataFrame:
    """responses: id, text. id, failed and the four lists, from JSON or from dashed lines under their headings."""
    norm = responses.select("id", _lines_of(F.coalesce("text", F.lit(""))).alias("norm"))
    json = norm.withColumn("payload", repair_json(F.coalesce(_fenced(F.col("norm")), F.col("norm"))))
    given = F.coalesce(F.from_json("payload", f"struct<insights: {INSIGHTS}>")["insights"], F.from_json("payload", INSIGHTS))
    json = json.withColumn("given", F.when(F.col("payload").startswith("{"), given)).withColumn("lines", F.transform(F.split("norm", "\n", -1), trimmed))

    def listed(title: str) -> Column:
        bare = F.transform("lines", lambda x: F.lower(F.regexp_replace(x, r"^[#>\-\s]+", "")))
        first = F.array_position(F.transform(bare, lambda x: x.startswith(title)), True)
        after = F.slice("lines", (first + 1).cast("int"), F.size("lines"))
        names = F.slice(bare, (first + 1).cast("int"), F.size("lines"))
        end = F.array_position(F.transform(names, lambda x: x.endswith(":") & ~x.startswith(title)), True)
        mine = F.when(end > 0, F.slice(after, 1, (end - 1).cast("int"))).otherwise(after)
        items = F.filter(F.transform(F.filter(mine, lambda x: x.startswith("-")), lambda x: trimmed(F.substr(x, F.lit(2)))), lambda x: x != "")
        return F.when(first > 0, items).otherwise(F.expr("cast(array() as array<string>)"))

    lists = [F.coalesce(F.col(f"given.{c}"), listed(t)).alias(c) for c, t in INSIGHT_TITLES.items()]
    out = json.select("id", *lists)
    return out.withColumn("failed", F.size(F.concat(*INSIGHT_TITLES)) == 0)
