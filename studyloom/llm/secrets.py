"""Secret scans: three base patterns, and sliding-window entropy over candidate strings.

Candidates are runs of 20 or more base64 or URL-safe characters. A window of 20
characters moves over each; counts by character change by one in and one out, and the
Shannon entropy follows from the sum of c * log2(c). The threshold depends on the
window's character class. An allow-list silences words, identifiers and well-known
dummies, each part between separators by itself; runs of good windows that no base span covers become spans of their own.

A null text is empty: no spans. Documents without an id are skipped, repeated rows give
a row each, other columns are ignored. Offsets are code points, ends exclusive. Time
follows the text's length, however long it is and however many spans it has.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm._store import rows_of
from studyloom.llm._text import byte_class, byte_runs, slices, spread, text_bytes

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_lower", "entropy_upper")
BASE_KINDS = KINDS[:3]

WINDOW = 20
#: Least bits a character by class: a random window of 20 has about 3.5 of hex digits, 3.8 of letters of one case and digits, and 4.1 of mixed ones.
LEAST_BITS = {"entropy_hex": 3.0, "entropy_mixed": 3.7, "entropy_lower": 3.4, "entropy_upper": 3.4}

# Strings that look random and are none. UUIDs and a key of the manuals, wherever they stand
ALLOWED = re.compile(rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", re.I)
WORDS = re.compile(rb"[a-z]+(?:[-_/][a-z]+)*[0-9]{0,4}", re.I)  # words, paths and slugs
PART = re.compile(rb"[^+/_=-]+")
DUMMY = re.compile(rb"example|sample|dummy|placeholder|changeme|0123456789|abcdefghij|xxxxxx", re.I)

_HEX = byte_class((0x30, 0x39), (0x61, 0x66))
_ACCESS = byte_class((0x30, 0x39), (0x41, 0x5A))
_CANDIDATE = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)) | np.isin(np.arange(256), list(b"+/_=-"))
_SIGN = byte_class((0x3A, 0x3A), (0x3D, 0x3D))
_DIGIT, _UPPER, _LOWER = byte_class((0x30, 0x39)), byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A))
_HEX_DIGIT = byte_class((0x30, 0x39), (0x41, 0x46), (0x61, 0x66))
_ENTROPY = tuple(LEAST_BITS)
#: Windows of a candidate that are counted one after another; longer ones are cut.
LANE = 256


def _silent(text: bytes) -> np.ndarray:
    """Whether a character belongs to an allowed part: the parts between separators count by themselves."""
    out = np.zeros(len(text), bool)
    for m in ALLOWED.finditer(text):
        out[m.start() : m.end()] = True
    for m in PART.finditer(text):
        if DUMMY.search(m[0]) or (len(m[0]) >= WINDOW and WORDS.fullmatch(m[0])):
            out[m.start() : m.end()] = True
    return out


def window_bits(data: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Entropy in bits a character of the n windows from each start on, end to end.

    Candidates are cut into lanes of at most ``LANE`` windows that move on together: a step takes
    one character out of each lane's counts and another one in.
    """
    terms = np.array([0.0] + [c * log2(c) for c in range(1, window + 1)])
    lanes = -(-n // LANE)
    part = spread(np.zeros(len(n), np.int64), lanes)
    first = np.repeat(start, lanes) + part * LANE
    size = np.minimum(LANE, np.repeat(n, lanes) - part * LANE)
    place = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    first, size, place = first[order], size[order], place[order]
    counts, total, row = np.zeros((len(first), 256), np.uint8 if window < 256 else np.int32), np.zeros(len(first)), np.arange(len(first))
    out = np.empty(int(n.sum()))

    def count(at: np.ndarray, step: int) -> None:
        on = row[: len(at)]
        symbol = data[at]
        c = counts[on, symbol].astype(np.int64)
        total[: len(at)] += terms[c + step] - terms[c]
        counts[on, symbol] = c + step

    for j in range(window):
        count(first + j, 1)
    out[place] = total
    for t in range(1, int(size.max(initial=0))):
        on = int(np.searchsorted(-size, -t, "left"))  # lanes with more than t windows
        count(first[:on] + t - 1, -1)
        count(first[:on] + t + window - 1, 1)
        out[place[:on] + t] = total[:on]
    return log2(window) - out / window


def entropy_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = WINDOW) -> list[tuple[str, int, int]]:
    """Kind, start and end of the maximal stretches of candidates (byte spans) whose windows pass their class's threshold."""
    on = end - start >= window
    start, end = start[on], end[on]
    if not len(start):
        return []
    n = end - start - window + 1
    bits, at, of = window_bits(data, start, n, window), spread(start, n), np.repeat(np.arange(len(start)), n)

    def within(table: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return upto[at + window] - upto[at]

    n_hex, n_digit, n_upper, n_lower = (within(t) for t in (_HEX_DIGIT, _DIGIT, _UPPER, _LOWER))
    kind = np.where(n_hex == window, 0, np.where((n_upper > 0) & (n_lower > 0), 1, np.where(n_digit + n_lower + n_upper == window, np.where(n_lower > 0, 2, 3), -1)))
    least = np.array([*LEAST_BITS.values(), np.inf])
    passed = np.flatnonzero((n_digit > 0) & (n_digit < window) & (bits >= least[kind]))
    out: list[tuple[str, int, int]] = []
    cuts = np.flatnonzero(np.append(True, of[passed][1:] != of[passed][:-1])) if len(passed) else []
    for mine in np.split(passed, cuts[1:]) if len(passed) else []:  # by candidate that has any
        lo, hi = int(start[of[mine[0]]]), int(end[of[mine[0]]])
        text = data[lo:hi].tobytes()
        if WORDS.fullmatch(text):
            continue
        silent = np.concatenate([[0], np.cumsum(_silent(text))])
        mine = mine[silent[at[mine] - lo + window] == silent[at[mine] - lo]]
        begin = len(out)
        for p, k in zip(at[mine].tolist(), kind[mine].tolist(), strict=True):
            if len(out) > begin and out[-1][0] == _ENTROPY[k] and out[-1][2] >= p:
                out[-1] = (out[-1][0], out[-1][1], p + window)
            else:
                out.append((_ENTROPY[k], p, p + window))
    return out


def entropy_runs(text: bytes, window: int = WINDOW) -> list[tuple[str, int, int]]:
    """The spans of one candidate."""
    return entropy_spans(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]), window)


def scan_bytes(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, str, int]]]:
    """By text, the spans (start, kind, end) in bytes of all texts end to end, in order."""
    found: list[list[tuple[int, str, int]]] = [[] for _ in range(len(offsets) - 1)]

    def owner(at: np.ndarray) -> list[int]:
        return (np.searchsorted(offsets, at, "right") - 1).tolist()

    def long_runs(table: np.ndarray, least: int) -> list[tuple[int, int, int]]:
        start, end = byte_runs(data, offsets, table)
        on = end - start >= least
        return list(zip(owner(start[on]), start[on].tolist(), end[on].tolist(), strict=True))

    for t in sorted(set(owner(np.flatnonzero(_SIGN[data])))):
        for m in ASSIGN.finditer(data[offsets[t] : offsets[t + 1]].tobytes()):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found[t].append((int(offsets[t]) + m.start(), "assign", int(offsets[t]) + m.end()))
    for t, lo, hi in long_runs(_ACCESS, ACCESS_LEAST):
        at = data[lo:hi].tobytes().find(b"AKIA")
        if at >= 0 and hi - lo - at >= ACCESS_LEAST:
            found[t].append((lo + at, "access", hi))
    for t, lo, hi in long_runs(_HEX, HEX_LEAST):
        found[t].append((lo, "hex", hi))
    base: dict[int, tuple[list[int], list[int]]] = {}  # by text: starts in order, and the farthest end up to each
    spans = entropy_spans(data, *byte_runs(data, offsets, _CANDIDATE))
    for t, (kind, lo, hi) in zip(owner(np.array([s[1] for s in spans], np.int64)), spans, strict=True):
        if t not in base:
            known = sorted((a, b) for a, _, b in found[t])
            base[t] = [a for a, _ in known], list(accumulate((b for _, b in known), max))
        at = bisect_right(base[t][0], lo)
        if not at or base[t][1][at - 1] < hi:
            found[t].append((lo, kind, hi))
    for spans in found:
        spans.sort(key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = text_bytes(batch.column("text"))
            rows = []
            for t, spans in enumerate(scan_bytes(data, offsets)):
                if spans:
                    point = np.concatenate([[0], np.cumsum((data[offsets[t] : offsets[t + 1]] & 0xC0) != 0x80)])
                    spans = [{"kind": k, "start": int(point[a - offsets[t]]), "end": int(point[b - offsets[t]])} for a, k, b in spans]
                rows.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> by start, then kind, for every document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return docs.mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return find_secrets(docs).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(rows_of(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op4_secret_scan": op4_secret_scan}
ORACLES: dict[str, str] = {}
