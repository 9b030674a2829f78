"""Stateful streams against plain loops, over several files, with late and unordered events and restarts."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.operators import learner as batch
from studyloom.operators.transcripts import merge_partials
from studyloom.streaming import learner
from studyloom.streaming.events import drain, latest, windowed_counts
from studyloom.streaming.ingest import NoteStore
from studyloom.streaming.transcripts import merged_partials

SCHEMA = "event_id long, note_id long, concept_id string, outcome string, ts timestamp"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def reviews(seed, n=120):
    rng = random.Random(seed)
    hours = sorted(rng.uniform(0, 900) for _ in range(n))
    return [(i, rng.randrange(2), rng.choice("ab"), rng.choice([*batch.MASTERY_STEP, "other"]), START + datetime.timedelta(hours=h)) for i, h in enumerate(hours)]


def shuffled(rows, seed, hours):
    """In an order of arrival that is off by less than so many hours."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[4] + datetime.timedelta(hours=rng.uniform(0, hours)))


def files(spark, rows, folder, parts, first=0):
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.parquet(f"{folder}/part{first + k:03d}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def plain_alerts(rows, mark):
    out = []
    for key in sorted({(r[1], r[2]) for r in rows}):
        mine = sorted((r for r in rows if (r[1], r[2]) == key and r[4] <= mark), key=lambda r: (r[4], r[0]))
        m, c, bad = batch.START_MASTERY, batch.START_CONFIDENCE, 0
        for i, (_, _, _, outcome, ts) in enumerate(mine):
            m = min(1.0, max(0.0, m + batch.MASTERY_STEP.get(outcome, 0.0)))
            c = min(1.0, max(0.0, c + batch.CONFIDENCE_STEP.get(outcome, 0.0)))
            bad += outcome == "incorrect"
            stability = max(2.0, 5 + math.log(i + 2) * 4 + c * 8 + m * 10 - min(8, bad * 1.5))
            due = ts + datetime.timedelta(days=math.floor(max(0.0, stability * math.log(max(0.05, 0.7 * m + 0.3 * c) / 0.5))))
            if due < (mine[i + 1][4] if i + 1 < len(mine) else mark):
                out.append((*key, due))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 6])
def test_running_mastery_is_the_batch_fold(spark, tmp_path, parts):
    rows = reviews(parts)
    files(spark, shuffled(rows, 9, 20), str(tmp_path / "in"), parts)
    got = latest(drain(learner.running_mastery(stream(spark, str(tmp_path / "in")), "24 hours"), "update"), learner.KEY)
    want = batch.fold_reviews(spark.createDataFrame(rows, SCHEMA))
    plain = lambda df: sorted((r.note_id, r.concept_id, round(r.mastery, 9), round(r.confidence, 9), r.review_count, r.mistake_count, r.last_reviewed) for r in df.collect())
    assert plain(got) == plain(want)


def test_restart_goes_on_and_alerts_come_once(spark, tmp_path):
    rows = reviews(3)
    arrived = shuffled(rows, 4, 20)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    alerts = lambda: drain(learner.due_alerts(stream(spark, folder), "24 hours"), "append", out, state)
    files(spark, arrived[:60], folder, 2)
    early = alerts().count()
    files(spark, arrived[60:], folder, 2, first=2)
    done = alerts()
    assert 0 < early < done.count()
    got = sorted((r.note_id, r.concept_id, r.due.replace(tzinfo=datetime.UTC)) for r in done.collect())
    mark = max(r[4] for r in rows) - datetime.timedelta(hours=24)
    mark -= datetime.timedelta(microseconds=mark.microsecond % 1000)
    assert got == plain_alerts(rows, mark)
    assert alerts().count() == len(got)  # nothing new, nothing twice
    # an alert that nothing cancelled is the date of the batch form
    last = {(r.note_id, r.concept_id): r.due for r in batch.retention(batch.fold_reviews(spark.createDataFrame([r for r in rows if r[4] <= mark], SCHEMA)), "2024-03-01").collect()}
    assert all(due.replace(tzinfo=datetime.UTC) in [g[2] for g in got if g[:2] == k] for k, due in last.items() if due.replace(tzinfo=datetime.UTC) < mark)


def test_sliding_windows(spark, tmp_path):
    rows = reviews(5, 60)
    files(spark, rows, str(tmp_path), 3)
    events = stream(spark, str(tmp_path)).select("ts", F.col("outcome").alias("event_type"), F.lit(1.0).alias("value"))
    got = drain(windowed_counts(events, "2 days", "1 day"))
    want = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("ts", "2 days", "1 day").alias("w"), F.col("outcome").alias("event_type")).agg(F.count("*").alias("n"))
    assert sorted(map(str, got.select("w", "event_type", "n").collect())) == sorted(map(str, want.collect())) and got.agg(F.sum("n")).first()[0] == 120


def test_partials_by_session(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for s in range(12):
        said = []
        for t in range(rng.randint(1, 9)):
            said = said[: rng.randint(0, len(said))] + [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))]
            rows.append((s, START + datetime.timedelta(minutes=t), t, rng.choice([" ".join(said), " ".join(said[-2:]) + " ", "", None, "new words"])))
    schema = "session_id long, ts timestamp, turn_id long, text string"
    want = {}
    for s in range(12):
        stable = ""
        for _, _, _, text in [r for r in rows if r[0] == s]:
            text = (text or "").strip()
            a, b = set(stable.split()), set(text.split())
            if text:
                stable = f"{stable} {text}" if stable and len(text) + 2 < len(stable) and len(a & b) / max(len(a), len(b)) < 0.35 else text
        want[s] = (stable, sum(r[0] == s for r in rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, schema)
    assert {r.session_id: (r.text, r.n_turns) for r in merge_partials(df).collect()} == want
    arrived = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rng.uniform(0, 3)))
    for k in range(4):
        spark.createDataFrame(arrived[k * len(rows) // 4 : (k + 1) * len(rows) // 4], schema).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    got = latest(drain(merged_partials(turns, "5 minutes"), "update"), ["session_id"])
    assert {r.session_id: (r.text, r.n_turns) for r in got.collect()} == want
    assert merge_partials(df.limit(0)).count() == 0


CHANGES = "note_id long, version long, deleted boolean, title string, text string"


def words(notes):
    return notes.select("note_id", F.explode(F.split("text", " ")).alias("word")).groupBy("note_id", "word").agg(F.count("*").alias("n"))


def rows_of(store):
    notes = store.table("notes", T.LongType()).where("content_hash is not null")
    return sorted(map(str, notes.select("note_id", "content_hash").collect())), sorted(map(str, store.table("words", T.LongType()).collect()))


def test_three_batches_are_one_over_the_end_state(spark, tmp_path):
    first = [(i, 1, False, f"t{i}", f"a b{i} a") for i in range(30)]
    second = [(i, 2, False, f"t{i}", "edited words") for i in range(0, 30, 4)] + [(7, 2, True, None, None), (40, 1, False, "new", "x y x"), (3, 1, False, "stale", "never seen"), (5, 2, False, "t5", "a b5 a")]
    third = [(8, 3, True, None, None), (7, 3, False, "back", "again here"), (40, 2, False, "new", "older"), (40, 3, False, "new", "newest"), (99, 1, True, None, None), (None, 1, False, "no", "id"), (12, 3, None, None, None)]
    frame = lambda rows: spark.createDataFrame(rows, CHANGES)
    store = NoteStore(spark, str(tmp_path / "store"), {"words": words}, 4)
    kinds = [sorted(r.kind for r in store.ingest(frame(b), n).collect()) for n, b in enumerate((first, second, third))]
    assert kinds[0] == ["added"] * 30 and sorted(set(kinds[1])) == ["added", "changed", "removed", "same"] and "removed" in kinds[2] and "added" in kinds[2]
    at_end = rows_of(store)
    end = {r[0]: r for r in first} | {r[0]: r for r in second if r[3] != "stale"} | {r[0]: r for r in third if r[0] is not None and r[4] != "older"}
    once = NoteStore(spark, str(tmp_path / "once"), {"words": words}, 4)
    once.ingest(frame([(r[0], 1, bool(r[2]), r[3], r[4]) for r in end.values()]), 0)
    assert rows_of(once) == at_end
    store.ingest(frame(third), 2)  # the batch that was last, once more
    assert rows_of(store) == at_end
    assert store.ingest(frame(second + first), 3).count() == 0 and rows_of(store) == at_end  # old changes under a new number
    store.ingest(frame([]), 4)
    assert rows_of(store) == at_end


def test_follow_restarts(spark, tmp_path):
    folder = str(tmp_path / "in")
    changes = lambda: spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    put = lambda k, rows: spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{folder}/{k}")
    store = NoteStore(spark, str(tmp_path / "store"), {"words": words}, 4)
    put("a", [(1, 1, False, "t", "one two"), (2, 1, False, "t", "three")])
    put("b", [(1, 2, False, "t", "one")])
    store.follow(changes(), str(tmp_path / "state"))
    put("c", [(2, 2, True, None, None)])
    store.follow(changes(), str(tmp_path / "state"))
    assert rows_of(store)[1] == ["Row(note_id=1, word='one', n=1)"]
