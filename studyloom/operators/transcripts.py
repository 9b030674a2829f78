"""Transcripts that are refined while they come: each text replaces what stands, or goes on after a pause."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A text that is shorter by more than so many characters, and shares less than so much, is a new phrase.
SHORTER_BY, SHARED = 2, 0.35


def overlap(a: str, b: str) -> float:
    """Words of both over those of the larger set; 1 where neither has any."""
    x, y = set(a.lower().split(" ")) - {""}, set(b.lower().split(" ")) - {""}
    return len(x & y) / max(len(x), len(y)) if x or y else 1.0


def refine(stable: str, text: str | None) -> str:
    text = (text or "").strip()
    if not text or not stable:
        return text or stable
    if len(text) + SHORTER_BY < len(stable) and overlap(stable, text) < SHARED:
        return f"{stable} {text}"
    return text


def merge_partials(turns: DataFrame) -> DataFrame:
    """turns: session_id, ts, turn_id, text. session_id, text and n_turns of each session.

    A fold in order that doesn't compose. Sessions are sorted through a task and hold only
    the text that stands, so a long one needs no more memory than a short one.
    """
    schema = T.StructType([turns.schema["session_id"], T.StructField("text", T.StringType()), T.StructField("n_turns", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, stable, n = None, "", 0
        for rows in batches:
            done = []
            for key, text in zip(rows["session_id"], rows["text"], strict=True):
                if n and key != session:
                    done.append((session, stable, n))
                    stable, n = "", 0
                session, stable, n = key, refine(stable, text), n + 1
            if done:
                yield pd.DataFrame(done, columns=schema.names)
        if n:
            yield pd.DataFrame([(session, stable, n)], columns=schema.names)

    rows = turns.where("session_id is not null").select("session_id", "ts", "turn_id", "text")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "ts", "turn_id").mapInPandas(fold, schema)
