"""Transcripts refined in a stream: the fold of ``transcripts.merge_partials`` with its state by session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from studyloom.operators.transcripts import refine
from studyloom.streaming.events import LATE


def merged_partials(turns: DataFrame, late: str = LATE) -> DataFrame:
    """turns: a stream of session_id, ts, turn_id, text. Of each session that got turns its text so far.

    Turns wait until the watermark has passed them; what is settled is one text. Later ones are dropped by Spark.
    """
    out = T.StructType([turns.schema["session_id"], T.StructField("text", T.StringType()), T.StructField("n_turns", T.LongType())])

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stable, n, waiting = state.get if state.exists else ("", 0, "[]")
        waiting, mark, got = json.loads(waiting), state.getCurrentWatermarkMs() * 1000, False
        if not state.hasTimedOut:
            for rows in batches:
                got = True
                waiting += [[int(a), int(i), t if isinstance(t, str) else None] for a, i, t in zip(rows["at"], rows["turn_id"], rows["text"], strict=True)]
        waiting.sort(key=lambda w: w[:2])
        ready = [w for w in waiting if w[0] <= mark]
        for _, _, text in ready:
            stable = refine(stable, text)
        n, waiting = n + len(ready), waiting[len(ready) :]
        state.update((stable, n, json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if got:
            for _, _, text in waiting:  # for this row only: earlier turns may still come
                stable = refine(stable, text)
            yield pd.DataFrame([(key[0], stable, n + len(waiting))], columns=out.names)

    rows = turns.withWatermark("ts", late).select("session_id", "ts", F.unix_micros("ts").alias("at"), F.col("turn_id").cast("long").alias("turn_id"), "text")
    return rows.groupBy("session_id").applyInPandasWithState(fold, out, "stable string, n long, waiting string", "update", GroupStateTimeout.EventTimeTimeout)
