"""Learner state kept by key in a stream: running mastery and due-review alerts.

Clamped steps depend on their order, so events wait until the watermark has passed them and are
folded in order of time. A key's state is what is settled, and the events that still wait:
its size follows from the lateness, not from the history. Events later than the watermark are
dropped by Spark. State and watermark are in the query's checkpoint, so a restart goes on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from studyloom.operators.learner import CONFIDENCE_STEP, FORGETTING_THRESHOLD, MASTERY_STEP, START_CONFIDENCE, START_MASTERY
from studyloom.streaming.events import LATE

KEY = ["note_id", "concept_id"]
OUTCOMES = sorted(MASTERY_STEP)
INCORRECT = OUTCOMES.index("incorrect")
#: What mastery and confidence gain by the number of an outcome; the last one is that of any other.
STEPS = [(MASTERY_STEP[o], CONFIDENCE_STEP.get(o, 0.0)) for o in OUTCOMES] + [(0.0, 0.0)]
DAY = 86_400_000_000
_STATE = "mastery double, confidence double, reviews long, mistakes long, last long, due long, waiting binary"
_WAITING = np.dtype([("at", "<i8"), ("id", "<i8"), ("outcome", "<i4")])


def due_at(mastery: float, confidence: float, reviews: int, mistakes: int, last: int) -> int:
    """The predicted forgetting date in microseconds, as ``learner.retention`` has it."""
    unit = lambda x: min(1.0, max(0.0, x))
    stability = max(2.0, 5.0 + math.log(max(1, reviews) + 1.0) * 4.0 + unit(confidence) * 8.0 + unit(mastery) * 10.0 - min(8.0, mistakes * 1.5))
    base = unit(mastery) * 0.7 + unit(confidence) * 0.3
    return last + math.floor(max(0.0, stability * math.log(max(0.05, base) / FORGETTING_THRESHOLD))) * DAY


class Learner:
    """A key's settled values and its waiting events; due is None once its alert is out."""

    def __init__(self, state: GroupState):
        values = state.get if state.exists else (START_MASTERY, START_CONFIDENCE, 0, 0, None, None, b"")
        self.mastery, self.confidence, self.reviews, self.mistakes, self.last, self.due, waiting = values
        self.waiting = np.frombuffer(waiting, _WAITING)

    def add(self, rows: pd.DataFrame) -> None:
        new = np.empty(len(rows), _WAITING)
        new["at"], new["id"], new["outcome"] = (rows[c].to_numpy() for c in ("at", "event_id", "outcome"))
        self.waiting = np.concatenate([self.waiting, new])

    def settle(self, upto: float, alarm: bool) -> list[int]:
        """Folds what happened up to then; with alarm, the dates that passed without a review before, which no one else asks for."""
        passed = []
        ready = self.waiting["at"] <= upto
        events = self.waiting[ready]
        self.waiting = self.waiting[~ready]
        order = np.lexsort((events["id"], events["at"]))
        for at, outcome in zip(events["at"][order].tolist(), events["outcome"][order].tolist(), strict=True):
            if self.due is not None and self.due < at:
                passed.append(self.due)
            more, surer = STEPS[outcome]
            self.mastery = min(1.0, max(0.0, self.mastery + more))
            self.confidence = min(1.0, max(0.0, self.confidence + surer))
            self.reviews += 1
            self.mistakes += outcome == INCORRECT
            self.last = at
            if alarm:
                self.due = due_at(self.mastery, self.confidence, self.reviews, self.mistakes, at)
        if self.due is not None and self.due < upto:
            passed.append(self.due)
            self.due = None
        return passed

    def save(self, state: GroupState, alarm: bool) -> None:
        state.update((self.mastery, self.confidence, self.reviews, self.mistakes, self.last, self.due, self.waiting.tobytes()))
        next_at = [int(self.waiting["at"].min())] if len(self.waiting) else []
        next_at += [self.due] if alarm and self.due is not None else []
        if next_at:
            state.setTimeoutTimestamp(max(min(next_at) // 1000, state.getCurrentWatermarkMs()) + 1)


def _events(events: DataFrame, late: str) -> DataFrame:
    known = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")).cast("int") - 1
    return events.withWatermark("ts", late).select(*KEY, "ts", F.unix_micros("ts").alias("at"), "event_id", F.coalesce(known, F.lit(-1)).alias("outcome"))


def _keyed(events: DataFrame, more: str) -> T.StructType:
    return T.StructType([events.schema[k] for k in KEY] + list(T._parse_datatype_string(more)))


def _settled_upto(state: GroupState) -> int:
    return state.getCurrentWatermarkMs() * 1000


def running_mastery(events: DataFrame, late: str = LATE) -> DataFrame:
    """events: a stream of note_id, concept_id, outcome, ts, event_id. Of each key that got events its row of ``fold_reviews`` so far."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        learner, got = Learner(state), False
        if not state.hasTimedOut:
            for rows in batches:
                learner.add(rows)
                got = True
        learner.settle(_settled_upto(state), alarm=False)
        learner.save(state, alarm=False)
        if got:
            learner.settle(math.inf, alarm=False)  # for this row only: what waits may still get earlier events
            yield pd.DataFrame({**{k: [v] for k, v in zip(KEY, key, strict=True)}, "mastery": [learner.mastery], "confidence": [learner.confidence], "review_count": [learner.reviews], "mistake_count": [learner.mistakes], "last_reviewed": [pd.Timestamp(learner.last, unit="us", tz="UTC")]})

    return _stateful(events, fold, "mastery double, confidence double, review_count long, mistake_count long, last_reviewed timestamp", "update", late)


def due_alerts(events: DataFrame, late: str = LATE) -> DataFrame:
    """One row (due) of each key and predicted forgetting date that the watermark passes without a review since."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        learner = Learner(state)
        if not state.hasTimedOut:
            for rows in batches:
                learner.add(rows)
        passed = learner.settle(_settled_upto(state), alarm=True)
        learner.save(state, alarm=True)
        if passed:
            yield pd.DataFrame({**{k: [v] * len(passed) for k, v in zip(KEY, key, strict=True)}, "due": pd.to_datetime(passed, unit="us", utc=True)})

    return _stateful(events, watch, "due timestamp", "append", late)


def _stateful(events: DataFrame, step: Callable, columns: str, mode: str, late: str) -> DataFrame:
    return _events(events, late).groupBy(*KEY).applyInPandasWithState(step, _keyed(events, columns), _STATE, mode, GroupStateTimeout.EventTimeTimeout)
