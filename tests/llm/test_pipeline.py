import corpus_pipeline
from studyloom.llm._store import keep


def test_stages_catch_what_they_should(spark, tmp_path):
    rows, labels = [], []
    for d in range(160):
        text = "\n".join(" ".join(f"w{(d * 7919 + i * (31 + j)) % 997}" for i in range(30)) for j in range(4))
        if d % 8 == 1:
            text += " vile nasty trash"
        rows.append((d, text, "en", f"s{d % 3}", len(text)))
        labels.append((d, 1, int(d % 8 == 1)))
    copy, lines = rows[10][1], rows[12][1].split("\n")
    for k in (1, 3):  # too far apart for a run of equal lines
        words = lines[k].split()
        words[15] = "other"
        lines[k] = " ".join(words)
    near = "\n".join(lines)
    item = " ".join(f"quiz{i}" for i in range(15))
    rows += [(200, copy, "en", "s0", len(copy)), (201, near, "en", "s0", len(near)), (202, f"own words here\n{rows[16][1]} and {item} here", "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    at = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        at = keep(stage(spark, at, d))
        assert at.columns == docs.columns
        seen.append({r.doc_id for r in at.collect()})
    assert not any(x % 8 == 1 for x in seen[0] if x < 160) and len(seen[0]) >= 130
    assert not {10, 200} <= seen[1] and not {12, 201} <= seen[2] and 202 not in seen[3]
    assert {x for x in seen[0] if x < 160} - seen[3] <= {10, 12, 16}
    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.collect()} == seen[3]


def test_odd_and_empty_tables(spark, tmp_path):
    odd = "doc_id long, text string, lang string, source string, n_chars long, rest int, runs string, label string, signature long, left int, rank int"
    words = lambda s, n: " ".join(f"{s}{i * 7 % 101}x{i}" for i in range(n))
    texts = [(d, words(f"d{d}w", 60)) for d in range(12)]
    texts += [(None, words("none", 60)), (None, None), (20, None), (21, ""), (22, " \n\t"), (3, texts[3][1]), (4, words("other", 60)), (23, words("long", 30_000)), (24, texts[5][1]), (24, texts[5][1])]
    rows = [(d, t, "en", "s", len(t or ""), 1, "r", "l", 2, 3, 4) for d, t in texts]
    for name, docs, labels in (("odd", rows, [(d, 1, 0) for d in range(6)]), ("empty", [], []), ("bare", rows[:2], [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, odd).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, words("quiz", 12))], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
        at = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            at = keep(stage(spark, at, folder))
            assert at.schema.names == [c.split()[0] for c in odd.split(", ")]
        left = at.collect()
        packed = corpus_pipeline.packed(spark, at, folder).collect()
        assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(r.doc_id) for r in left)
        if name != "odd":
            assert len(left) == len(docs)
            continue
        got = [(r.doc_id, r.text) for r in left]
        assert all((r.rest, r.runs, r.label, r.signature, r.left, r.rank) == (1, "r", "l", 2, 3, 4) for r in left)
        # a copy of a smaller id loses all its lines; an id's other text stays, and so do rows without an id
        assert not [t for d, t in got if d == 24] and {t for d, t in got if d == 4} <= {texts[4][1], words("other", 60)}
        assert sum(d is None for d, _ in got) == 2 and (20, None) in got and (23, words("long", 30_000)) in got and got.count((3, texts[3][1])) == 2
