"""Semantic chunks: the paragraphs of a section packed up to a budget, neighbours overlapping."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.operators.structure import lines_of, word_count
from studyloom.operators.text import from_text

# The share of the context that a chunk may fill, its least budget, and the overlap of paragraphs and of lines.
FILL, LEAST, OVERLAP, LINE_OVERLAP = 0.85, 64, 0.15, 0.10


def pack_ranges(tokens: np.ndarray, budget: int, share: float, cut_long: bool) -> list[tuple[int, int, bool]]:
    """Consecutive items as ranges within the budget; each begins with the last ones of the range before. cut: one item over the budget, to be cut itself."""
    out, start, held = [], 0, 0
    keep = max(1, int(np.ceil(len(tokens) * share)))
    upto = np.concatenate([[0], np.cumsum(tokens)])
    for i, n in enumerate(tokens):
        if held + n > budget and start < i:
            out.append((start, i - 1, False))
            start = max(start, i - keep)
            held = int(upto[i] - upto[start])
        if cut_long and n > budget:
            if start < i:
                out.append((start, i - 1, False))
            out.append((i, i, True))
            start, held = i + 1, 0
            continue
        held += n
    if start < len(tokens):
        out.append((start, len(tokens) - 1, False))
    return out


def _quarter(words: int) -> int:
    """Three quarters of the words, at least 1."""
    return max(1, words * 3 // 4)


def _paragraphs_of(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Section line (of the heading, -1 before the first), first line and lines (trimmed) of each paragraph.

    Blank lines and headings part paragraphs, and a line that begins with a speaker's name opens one.
    """
    section, first, held = -1, 0, []
    for i, line, kind, _ in lines_of(text):
        t = line.strip(" ")
        ends = t == "" or kind == "heading"
        speaker = not ends and len(t) < 80 and ":" in t and unicodedata.category(t[0]) == "Lu"
        if held and (ends or speaker):
            yield section, first, held
            held = []
        if kind == "heading":
            section = i
        elif t:
            first = first if held else i
            held.append(t)
    if held:
        yield section, first, held


def _chunks_of(text: str, budget: int) -> Iterator[tuple[int, int, int, str]]:
    """Section line, first and last line and content of each chunk."""
    empty = True
    for section, found in groupby(_paragraphs_of(text), lambda p: p[0]):
        empty, ps = False, [(first, held, [word_count(t) for t in held]) for _, first, held in found]
        counts = [sum(words) for _, _, words in ps]
        fits = _quarter(sum(counts)) <= budget
        for a, b, cut in [(0, len(ps) - 1, False)] if fits else pack_ranges(np.array([_quarter(n) for n in counts]), budget, OVERLAP, True):
            first, last = ps[a][0], ps[b][0] + len(ps[b][1]) - 1
            if not cut:
                yield section, first, last, "\n\n".join("\n".join(held) for _, held, _ in ps[a : b + 1])
                continue
            _, held, words = ps[a]
            for x, y, _ in pack_ranges(np.array([_quarter(n) for n in words]), budget, LINE_OVERLAP, False):
                yield section, first, last, "\n".join(held[x : y + 1])
    if empty:
        yield -1, 0, 0, ""


def semantic_chunks(docs: DataFrame, context_limit: int) -> DataFrame:
    """docs: doc_id, text. doc_id, chunk, section_line, first_line, last_line, content; chunk counts from 0 in a document.

    A section that fits is one chunk. Else paragraphs are packed, 15 % of them repeated from chunk to chunk;
    one that doesn't fit is cut by lines, 10 % of them repeated. A document without a paragraph is one empty chunk.
    All is found in the document's row.
    """
    budget = max(LEAST, int(max(1, context_limit) * FILL))
    numbered = lambda text: ((i, *c) for i, c in enumerate(_chunks_of(text, budget)))
    return from_text(docs.where("text is not null"), F.col("text"), numbered, "chunk int, section_line int, first_line int, last_line int, content string")
