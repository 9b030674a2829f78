"""Readers and writers of notes on small files."""

import csv
import datetime
import io
import json

from pyspark.sql import types as T

from studyloom.operators import structure
from studyloom.operators.signals import export_events_csv
from studyloom.sources import notes


def test_nested_folders(spark, tmp_path):
    payload = {"folders": [{"id": "f1", "title": "One", "notes": [{"id": "n1", "title": "a", "content": "x\ny"}, {"id": "n2", "title": "b", "content": ""}]}, {"id": "f2", "title": "Two", "notes": []}, {"id": "f3", "title": "Three"}]}
    (tmp_path / "a.json").write_text(json.dumps(payload, indent=2))
    folders, rows = notes.import_folders_json(spark, str(tmp_path))
    assert sorted(map(tuple, folders.collect())) == [("f1", "One", 0), ("f2", "Two", 1), ("f3", "Three", 2)]
    assert sorted(map(tuple, rows.collect())) == [("f1", "n1", "a", "x\ny", 0), ("f1", "n2", "b", "", 1)]


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "cell-theory_intro.md").write_text("# Cells\nall")
    (tmp_path / "other.txt").write_text("no")
    (tmp_path / "empty.md").write_text("")
    rows = {r.title: r for r in notes.read_markdown_dir(spark, str(tmp_path)).collect()}
    one = rows["Cell Theory Intro"]
    assert one.text == "# Cells\nall" and one.keywords == ["cell", "theory", "intro"] and len(one.id) == 64 and set(rows) <= {"Cell Theory Intro", "Empty"}


def test_front_matter(spark):
    texts = ["---\nid: n1\ntitle: A: b\nid: again\nplain line\n---\nbody\n---\nmore", "no front", "---\nnever closed", None]
    rows = notes.parse_front_matter(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert rows[0].front == {"id": "n1", "title": "A: b"} and rows[0].body == "body\n---\nmore"
    assert [r.body for r in rows[1:]] == texts[1:] and not rows[1].front and not rows[2].front


def test_transcript(spark):
    text = "[00:05] Ada: Hello: all\nnoise\n[61:00] Bob Lee:  \n[1:2] bad: x"
    rows = notes.parse_transcript(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 5, "Ada", "Hello: all"), (1, 2, 3660, "Bob Lee", "")]


def test_ground_truth(spark, tmp_path):
    truth = {"concepts": ["ATP"], "relationships": [{"source": "ATP", "relationship": "REQUIRES", "target": "O2"}], "facts": ["f"], "other": 1}
    (tmp_path / "a.json").write_text(json.dumps(truth, indent=1))
    row = notes.read_ground_truth(spark, str(tmp_path)).first()
    assert row.concepts == ["ATP"] and row.relationships[0].relationship == "REQUIRES" and row.facts == ["f"] and len(row) == 3


def test_schema_grows_by_columns(spark):
    schema = T._parse_datatype_string("id long, title string, added double")
    df = notes.align_schema(spark.createDataFrame([("x", "7", True)], "title string, id string, extra boolean"), schema)
    assert df.dtypes == [("id", "bigint"), ("title", "string"), ("added", "double"), ("extra", "boolean")] and tuple(df.first()) == (7, "x", None, True)
    assert notes.align_schema(df, schema).columns == df.columns


def test_chunk_boundaries(spark):
    def chunks(blocks, target):
        df = spark.createDataFrame([(1, i, f"b{i}", k, n) for i, (k, n) in enumerate(blocks)], "doc_id long, start_line int, block_id string, kind string, tokens long")
        return [(r.chunk, r.hard) for r in structure.chunk_boundaries(df, target).orderBy("block_id").collect()]

    assert chunks([("paragraph", 4), ("paragraph", 4), ("paragraph", 4), ("heading", 1), ("paragraph", 4)], 9) == [(0, False), (0, False), (1, False), (2, True), (2, False)]
    assert chunks([("heading", 1), ("paragraph", 80)], 9) == [(0, False), (1, False)]  # the first block opens nothing, a large one stands alone
    assert chunks([("paragraph", 80)], 9) == [(0, False)]


def test_unchanged_documents_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "doc_id long, content_hash string")
    done = spark.createDataFrame([("b",), ("b",), ("z",)], "content_hash string")
    assert sorted(r.doc_id for r in structure.changed_only(docs, done).collect()) == [1, 4]


def test_events_as_a_csv_file(spark, tmp_path):
    rows = [("1", 1, datetime.datetime(2024, 1, 5, 10), 'say "hi", you', "s", None, {"b": "1", "a": "x,y"}), ("2", 1, None, "plain", "", "line\nbreak", {})]
    df = spark.createDataFrame(rows, "id string, schema_version int, timestamp timestamp, event_type string, session_id string, note_id string, metadata map<string,string>")
    export_events_csv(df.repartition(2), str(tmp_path / "out"))
    parts = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert parts and all(p.startswith("id,schemaVersion,timestamp,eventType,sessionID,noteID,metadata\n") for p in parts)
    found = sorted(r for p in parts for r in list(csv.reader(io.StringIO(p)))[1:])
    assert found == [["1", "1", "2024-01-05T10:00:00Z", 'say "hi", you', "s", "", '{"a":"x,y","b":"1"}'], ["2", "1", "", "plain", "", "line\nbreak", "{}"]]
    assert any('1,1,2024-01-05T10:00:00Z,"say ""hi"", you",s,,' in p for p in parts) and any("2,1,,plain,," in p for p in parts)
