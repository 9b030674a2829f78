"""Fixtures and properties of the operators that the driver's tables don't reach."""

import datetime as dt
import random

from pyspark.sql import functions as F

from studyloom.functions import text as fn
from studyloom.operators import concepts as concept_rules
from studyloom.operators import graph, learner, planning, search, signals
from studyloom.streaming import events as streaming


def test_fold_equals_a_loop(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3, k % 7, rng.choice(list(learner.MASTERY_STEP)), start + dt.timedelta(hours=rng.randint(0, 200)), k) for k in range(900)]
    df = spark.createDataFrame(rows, "note_id int, concept_id int, outcome string, ts timestamp, event_id int")
    got = {(r.note_id, r.concept_id): r for r in learner.fold_reviews(df).collect()}
    for key, r in got.items():
        m, c = learner.START_MASTERY, learner.START_CONFIDENCE
        mine = sorted((x for x in rows if x[:2] == key), key=lambda x: (x[3], x[4]))
        for x in mine:
            m = max(0, min(1, m + learner.MASTERY_STEP[x[2]]))
            c = max(0, min(1, c + learner.CONFIDENCE_STEP[x[2]]))
        assert abs(r.mastery - m) < 1e-9 and abs(r.confidence - c) < 1e-9 and r.review_count == len(mine)


def test_retention(spark):
    now = "2023-11-14 22:13:20"
    at = dt.datetime(2023, 11, 14, 22, 13, 20)
    rows = [("old", 0.8, 0.8, 1, 0, at - dt.timedelta(days=30)), ("recent", 0.8, 0.8, 8, 0, at - dt.timedelta(days=2)), ("weak", 0.35, 0.35, 1, 2, at), ("strong", 0.9, 0.9, 8, 0, at), ("overdue", 0.3, 0.3, 1, 2, at - dt.timedelta(days=20)), ("today", 0.5, 0.5, 1, 0, at)]
    df = spark.createDataFrame(rows, "concept_id string, mastery double, confidence double, review_count int, mistake_count int, last_reviewed timestamp")
    r = {x.concept_id: x for x in learner.retention(df, now).collect()}
    assert abs(r["old"].stability - 22.1726) < 1e-4
    assert r["old"].retention < r["recent"].retention and r["old"].due < r["recent"].due
    assert r["weak"].due < r["strong"].due and r["weak"].urgency > r["strong"].urgency
    assert r["overdue"].days_until_due < 0 and r["today"].days_until_due == 0
    first = learner.scheduled_reviews(df, now, 1).collect()[0]
    assert first.status.startswith("Overdue") and first.risk == "High Risk"


def atp(spark):
    rows = [(1, "ATP", "Mitochondria", "PART_OF", 0.9), (2, "ATP", "Cellular Respiration", "REQUIRES", 0.9), (3, "ATP", "Energy Production", "PRODUCES", 0.9), (4, "Mitochondria", "Organelle", "PART_OF", 0.9)]
    edges = spark.createDataFrame(rows, "edge_id int, source_id string, target_id string, relation string, confidence double")
    names = [(n,) for n in ("ATP", "Mitochondria", "Cellular Respiration", "Energy Production", "Organelle")]
    return edges, spark.createDataFrame(names, "concept_id string")


def test_graph(spark):
    edges, concepts = atp(spark)
    seed = concepts.where("concept_id = 'ATP'")
    near = {r.node for r in graph.subgraph(edges, seed, 1)[0].collect()}
    assert "Mitochondria" in near and "Organelle" not in near
    assert "Organelle" in {r.node for r in graph.subgraph(edges, seed, 2)[0].collect()}
    pair = spark.createDataFrame([("ATP", "Organelle")], "source string, target string")
    assert graph.shortest_paths(edges, pair).collect()[0].path == ["ATP", "Mitochondria", "Organelle"]
    stats = graph.graph_stats(concepts, edges).collect()[0]
    assert tuple(stats) == (5, 4, 1, 1.6)


def test_chains_and_cycles(spark):
    schema = "edge_id int, source_id string, target_id string, relation string, confidence double"
    line = spark.createDataFrame([(1, "Integrals", "Derivatives", "REQUIRES", 1.0), (2, "Derivatives", "Limits", "requires", 1.0)], schema)
    target = spark.createDataFrame([("Integrals",)], "concept_id string")
    assert [r.node for r in graph.prerequisite_chain(line, target).orderBy("place").collect()] == ["Limits", "Derivatives"]
    cycle = spark.createDataFrame([(1, "a", "b", "depends_on", 1.0), (2, "b", "a", "depends_on", 1.0)], schema)
    assert graph.prerequisite_chain(cycle, spark.createDataFrame([("a",)], "concept_id string")).count() <= 2


def test_gaps(spark):
    schema = "edge_id int, source_id string, target_id string, relation string, confidence double"
    edges = spark.createDataFrame([(1, "strong", "weak", "REQUIRES", 1.0)], schema)
    concepts = spark.createDataFrame([("strong",), ("weak",), ("new",)], "concept_id string")
    mastery = spark.createDataFrame([("strong", 0.9, 0), ("weak", 0.4, 1)], "concept_id string, mastery double, mistake_count int")
    gaps = {r.concept_id: r for r in planning.detect_gaps(concepts, edges, mastery).collect()}
    assert set(gaps) == {"weak"} and gaps["weak"].reason == planning.WEAK_PREREQUISITE and abs(gaps["weak"].severity - 0.6) < 1e-9


def test_profiles_to_mastery(spark):
    def signals_of(kinds):
        return spark.createDataFrame([(i, k, ["c"], dt.datetime(2024, 1, 1), i) for i, k in enumerate(kinds)], "proposal_id int, signal_type string, concept_ids array<string>, ts timestamp, event_id int")

    def score(kinds):
        return signals.profile_mastery(signals.profiles(signals_of(kinds))).collect()[0].mastery

    assert score(["markedHelpful"] * 3 + ["accepted"] * 2 + ["lightlyEdited"]) >= 0.8
    assert abs(score(["markedHelpful", "accepted"]) - 0.70) < 1e-9
    assert score(["markedStillConfused"] * 2 + ["rejected", "heavilyEdited", "requestedAgain"]) < 0.4


def test_export_rows(spark):
    df = spark.createDataFrame([("1", 1, "t", "a,b", 's"q', None, {"b": "2", "a": "1"})], "id string, schema_version int, timestamp string, event_type string, session_id string, note_id string, metadata map<string,string>")
    assert signals.export_rows(df).collect()[0].line == '1,1,t,"a,b","s""q",,"{""a"":""1"",""b"":""2""}"'


def test_search_finds_the_note_first(spark):
    docs = spark.createDataFrame([(1, "Cell Membrane\nthe cell membrane regulates"), (2, "cell walls"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "cell membrane"), (8, "???")], "query_id long, query string")
    hits = search.bm25(queries, docs).collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in hits] == [(7, 1, 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("kitten", "kitchen"), ("abc", "abc"), ("", "x"), ("Long text here", "different!")], "a string, b string")
    rows = df.select(fn.edit_class(F.col("a"), F.col("b")).alias("e"), fn.common_prefix(F.col("a"), F.col("b")).alias("p"), fn.max_overlap(F.col("a"), F.col("b")).alias("o")).collect()
    assert [r.e for r in rows] == ["heavilyEdited", None, "heavilyEdited", "heavilyEdited"]
    assert [r.p for r in rows] == [3, 3, 0, 0] and rows[1].o == 1.0 and rows[2].o == 0.0


def test_streams_equal_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=17 * i), i % 4, ["a", "b"][i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    stream = streaming.read_events(spark, str(tmp_path), "events.parquet")
    got = {(r.w.start, r.event_type): (r.n, r.value) for r in streaming.drain(streaming.windowed_counts(stream)).collect()}
    want = {(r.w.start, r.event_type): (r.n, r.value) for r in df.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).collect()}
    assert got == want
    sessions = streaming.drain(streaming.study_sessions(stream, "60 minutes")).groupBy("user_id").count().collect()
    assert {r.user_id: r["count"] for r in sessions} == dict.fromkeys(range(4), 50)


def test_chains_of_any_length(spark):
    schema = "edge_id int, source_id long, target_id long, relation string, confidence double"
    line = [(i, i, i + 1, "REQUIRES", 1.0) for i in range(19)]
    detour = [(30, 0, 40, "REQUIRES", 1.0), (31, 40, 2, "REQUIRES", 1.0), (32, 0, 19, "REQUIRES", 1.0)]
    cycle = [(50, 100, 101, "REQUIRES", 1.0), (51, 101, 102, "REQUIRES", 1.0), (52, 102, 101, "REQUIRES", 1.0)]
    edges = spark.createDataFrame(line + detour + cycle, schema)
    targets = spark.createDataFrame([(0,), (100,)], "concept_id long")
    got = {(r.target, r.node): r.distance for r in graph.prerequisite_chain(edges, targets).collect()}
    assert got == {**{(0, i): i for i in range(1, 20)}, (0, 40): 1, (100, 101): 1, (100, 102): 2}


def test_names_of_many_words(spark):
    text = "one two three four five six seven eights nine"
    sentences = spark.createDataFrame([(1, 0, f"so {text}"), (2, 0, "one two three four five six other"), (3, 0, f"{text} and {text}")], "doc_id long, pos int, sentence string")
    named = spark.createDataFrame([(7, "One two three four five six seven eight"), (8, "five six"), (9, text + " ten")], "concept_id long, name string")
    got = {(r.doc_id, r.concept_id, r["at"]) for r in concept_rules.mentions(sentences, named).collect()}
    assert got == {(1, 7, 1), (1, 8, 5), (2, 8, 4), (3, 7, 0), (3, 8, 4)}


def test_cosine_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    rng = random.Random(5)
    v = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(400)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in search.cosine_top(df.where("vec_id % 10 = 0"), df, 3).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(q, k + 1): i for q in range(0, 400, 10) for k, i in enumerate(sorted((i for i in v if i != q), key=lambda i: -cos(v[q], v[i]))[:3])}
    assert got == want


def test_evaluation_runs_and_event_files(spark, tmp_path):
    from studyloom.sources import notes

    path = str(tmp_path / "runs")
    rows = lambda run, at, n: spark.createDataFrame([(run, at, i, 0.5) for i in range(n)], "run_id string, run_at string, note_id long, score double")
    notes.write_eval_run(rows("a", "2024-01-01", 3), path)
    notes.write_eval_run(rows("b", "2024-01-02", 2), path)
    notes.write_eval_run(rows("a", "2024-01-03", 1), path)
    found = notes.recent_runs(spark.read.parquet(path), 2).collect()
    assert [(r.run_id, str(r.run_at)[:10], r.n_notes) for r in found] == [("a", "2024-01-03", 1), ("b", "2024-01-02", 2)]
    events = spark.sql("select 1 as id, timestamp'2024-01-05 10:00:00' as ts")
    notes.export_events_json(events, str(tmp_path / "events"))
    assert spark.read.text(str(tmp_path / "events")).first()[0] == '{"id":1,"ts":"2024-01-05T10:00:00Z"}'


def test_fnv1a_and_hashed_embedding(spark):
    import math

    import xxhash
    from pyspark.sql import functions as F

    from studyloom.operators import canonical, retrieval

    got = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string").select(canonical.fnv1a(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", "cbf29ce484222325"]
    text = "One two, two three"
    want = [0.0] * 16
    words = ["one", "two", "two", "three"]
    for term, weight in [(w, 1.0) for w in words] + [(f"{a} {b}", 0.75) for a, b in zip(words, words[1:], strict=False)]:
        h = xxhash.xxh64(term.encode(), seed=42).intdigest()
        want[(h - (1 << 64) if h >> 63 else h) % 16] += weight
    norm = math.sqrt(sum(x * x for x in want))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.embedding for r in retrieval.hashed_embedding(docs, 16).collect()}
    assert all(abs(a - b / norm) < 1e-6 for a, b in zip(rows[1], want, strict=True)) and (rows[2] is None or not any(rows[2]))


def test_normalized_text(spark):
    from pyspark.sql import functions as F

    from studyloom.operators import structure

    cases = {
        "Cell   membranes\r\n\r\n\r\n  regulate    transport\u2026": "Cell membranes\n\nregulate transport...",
        "\u201cNeural\u201d \ufb01bers \u2013 and\u00a0non breaking .": '"Neural" fibers - and non breaking.',
        "a  b\n```\nx   =  1\n```\n c ,d": "a b\n```\nx   =  1\n```\nc,d",
        "a\n ```py\n\tx\ty “q”\n```\nb\tc “q” inline ``` x  y\n\n\nz": 'a\n```py\nx    y “q”\n```\nb c "q" inline ``` x y\n\nz',
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", structure.normalize_text(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_new_concepts_get_ids_of_their_own(spark):
    from studyloom.operators.canonical import canonicalize

    def ids(canon, new):
        known = spark.createDataFrame([(c, n, []) for c, n in canon], "canonical_id string, name string, aliases array<string>")
        rows = canonicalize(spark.createDataFrame([(i, n, a) for i, (n, a) in enumerate(new)], "concept_id long, name string, aliases array<string>"), known).collect()
        assert len(rows) == len(new)
        return [r.canonical_id for r in sorted(rows)]

    # "x!y" and "X-Y" are one new concept; "x y 2" is another, and has its own id
    assert ids([("x", "x"), ("x-2", "other")], [("x!y", []), ("X-Y", []), ("x y 2", [])]) == ["x-y", "x-y", "x-y-2"]
    assert ids([("a-b", "one"), ("a-b-2", "two")], [("A b", []), ("A b", [])]) == ["a-b-3", "a-b-3"]
    long = "w" * 60
    assert ids([("w" * 48 + "-3", "z")], [(long, []), (long + "v", []), (long + "u", []), (f"{long[:48]} 2", [])]) == ["w" * 48, "w" * 48 + "-2", "w" * 48 + "-4", "w" * 48 + "-5"]
    assert ids([], [("!!!", []), ("?", None), ("concept", [])]) == ["concept", "concept", "concept-2"]
    assert ids([("k", "name"), ("j", "name")], [("NAME", []), ("other", ["Name "])]) == ["j", "j"]


def test_aliases_are_names(spark):
    from studyloom.operators.extraction import aliases, definitions, evidence

    said = ["CNN models are fast", "CNN is a kind of network", "A convolutional neural network (CNN) sees", "İİİ İstanbul is a city", "nothing"]
    sentences = spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "doc_id long, pos int, sentence string")
    concepts = spark.createDataFrame([(1, "convolutional neural network", "Convolutional neural network"), (1, "iii istanbul", "İİİ İstanbul"), (1, "absent thing", "Absent thing")], "doc_id long, key string, term string")
    concepts = concepts.selectExpr("doc_id", "case when key = 'iii istanbul' then trim(regexp_replace(lower(term), '[^\\\\p{L}\\\\p{N}]+', ' ')) else key end as key", "term")
    known = aliases(concepts, sentences)
    key = [r.key for r in concepts.collect()][1]
    found = {(r.key, r.nth): r.pos for r in evidence(concepts, sentences, 2, known).collect()}
    assert found["convolutional neural network", 1] == 0 and found["convolutional neural network", 2] == 1 and found["absent thing", 1] is None
    text = {r.key: (r.definition, r.explicit) for r in definitions(concepts, sentences, known).collect()}
    assert text["convolutional neural network"][1] and text["absent thing"] == ("Absent thing", False) and text[key] == ("a city", True)


def test_paths_of_equal_ends_and_their_edges(spark):
    from studyloom.operators.graph import shortest_paths

    edges = spark.createDataFrame([(1, "a", "b", "r", 1.0), (2, "b", "a", "r", 1.0), (3, "b", "c", "r", 1.0), (4, "a", "d", "r", 1.0)], "edge_id long, source_id string, target_id string, relation string, confidence double")
    pairs = spark.createDataFrame([("a", "a"), ("a", "c"), ("d", "c"), ("a", "z"), (None, "a")], "source string, target string")
    got = {(r.source, r.target): (r.path, r.edges, r.length) for r in shortest_paths(edges, pairs).collect()}
    assert got == {("a", "a"): (["a"], [], 0), ("a", "c"): (["a", "b", "c"], [1, 3], 2), ("d", "c"): (["d", "a", "b", "c"], [4, 1, 3], 3)}


def test_unreviewed_records_count_from_their_update(spark):
    import datetime

    from studyloom.operators.learner import retention

    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(0.9, 0.9, 0, 0, None, at), (0.9, 0.9, 0, 0, at, None)], "mastery double, confidence double, review_count int, mistake_count int, last_reviewed timestamp, updated_at timestamp")
    one, two = retention(df, "2024-02-01").collect()
    assert one.due == two.due and one.due is not None and one.retention == two.retention
