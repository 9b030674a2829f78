"""Line repair of texts: wrapped lines joined again, generated text without leftovers of its prompt.

Both judge a line by the last one kept or merged, so they are folds over a text's lines; each is
one pass in a task, linear in the text. Null stays null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What ends a line that isn't to be continued, and marks that continue one.
ENDS, CONTINUES = ".!?;:", (")", "•")
# Phrases of prompts, and headings by their plain names.
ARTIFACTS = [
    "student response", "avoid repetition", "final sentence", "generated:", "you are helping edit a student note", "note context:", "selected text:", "instruction:",
    "please provide your answer clearly", "do not use the exact words", "to be clear,", "the selected passage", "you are not editing the note", "note:", "notes:",
]
HEADINGS = {
    "question": "Question", "questions": "Question", "answer": "Answer", "answers": "Answer", "explanation": "Explanation", "explanations": "Explanation",
    "summary": "Summary", "summaries": "Summary", "key point": "Key Points", "key points": "Key Points", "keypoints": "Key Points", "flashcard": "Flashcards",
    "flashcards": "Flashcards", "quiz": "Quiz", "review": "Review", "reviews": "Review", "example": "Example", "examples": "Example", "notes": "Notes", "note": "Notes",
}
#: Texts of a batch that are strings of Python at a time.
TEXTS = 64
_NEWLINE = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")


def _lower(c: str) -> bool:
    return unicodedata.category(c) == "Ll"


def _continues(last: str, line: str) -> bool:
    if not last or last[-1] in ENDS:
        return False
    return _lower(line[0]) or unicodedata.category(line[0])[0] == "N" or line.startswith(CONTINUES)


def reflow_text(text: str) -> str:
    done: list[str] = []
    last: list[str] | None = None  # the pieces of the last line
    for line in map(str.strip, _NEWLINE.split(text)):
        end = last[-1] if last else None
        if not line:
            if last != [""]:
                done += ["".join(last)] if last else []
                last = [""]
        elif end and end.endswith("-") and _lower(line[0]):
            last[-1:] = [end[:-1], line]
        elif last and _continues(end, line):
            last += [" ", line]
        elif last is None or "".join(last) != line:
            done += ["".join(last)] if last else []
            last = [line]
    return "\n".join([*done, "".join(last)] if last else done)


def clean_text(text: str) -> str:
    kept: list[str] = []
    blank, said, section = False, None, None
    for line in map(str.strip, re.split("\r\n?|\n", text)):
        if not line:
            if not blank and kept:
                kept.append("")
                blank = True
            continue
        blank, lower = False, line.lower()
        if any(a in lower for a in ARTIFACTS):
            continue
        title = HEADINGS.get(lower.replace(":", "").replace("-", " ").replace("  ", " "))
        if title is None and line != said:
            kept.append(line)
            said, section = line, None
        elif title is not None and title != section:
            kept.append(f"## {title}")
            said = section = title
    return "\n".join(kept).strip()


def _each(texts: pa.Array, made: Callable[[str], str]) -> pa.Array:
    """What is made of each text; only a few of a batch are strings of Python at a time."""
    parts = [pa.array([None if t is None else made(t) for t in texts.slice(i, TEXTS).to_pylist()], pa.string()) for i in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def reflow(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Wrapped lines joined: a hyphen before a small letter goes; a line that begins with a small letter, a number, a bracket or a bullet continues an unfinished one; a line like the last goes."""
    for batch in texts:
        yield _each(batch, reflow_text)


@F.arrow_udf(StringType())
def clean_generated(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Without lines of the prompt, lines and headings like the last kept one, and runs of blank lines; known headings get one form."""
    for batch in texts:
        yield _each(batch, clean_text)
