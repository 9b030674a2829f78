import random

from studyloom.llm.line_dedup import dedup_lines, repeated_runs

SCHEMA = "doc_id long, text string, words long"


def words_of(line):
    bare = line.strip(" ")
    return max(1, len(bare) - len(bare.replace(" ", "")) + 1)


def brute(docs, least):
    """Lines in a run of enough words that occurs earlier as well."""
    lines = {d: t.split("\n") for d, t in docs if t is not None}
    seen, gone = {}, {d: set() for d in lines}
    for d in sorted(lines):
        for i in range(len(lines[d])):
            for j in range(i + 1, len(lines[d]) + 1):
                seen.setdefault(tuple(lines[d][i:j]), (d, i))
    for d in lines:
        for i in range(len(lines[d])):
            for j in range(i + 1, len(lines[d]) + 1):
                run = lines[d][i:j]
                if sum(map(words_of, run)) >= least and seen[tuple(run)] < (d, i):
                    gone[d] |= set(range(i, j))
    return {d: "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) for d in lines}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["", "a", "b c", "d e f", "g h i j k", " l  m", "n"]
    docs = [(d, "\n".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for d in range(40)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "a\n" * 20)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], SCHEMA)
    for least in (1, 4, 9):
        got = {r.doc_id: r.text for r in dedup_lines(df, least).collect()}
        assert got == brute(docs, least)


def test_edges(spark):
    long_line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long_line, 7), (2, None, 8), (3, "", 9), (None, long_line, 10), (5, f"x\n{long_line}\ny", 11), (5, f"x\n{long_line}\ny", 11)]
    out = dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "words"]
    assert sorted(out.collect(), key=str) == sorted([(1, long_line, 7), (2, None, 8), (3, "", 9), (None, long_line, 10), (5, "x\ny", 11), (5, "x\ny", 11)], key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_lines(empty).count() == 0 and repeated_runs(empty).count() == 0


def test_rows_that_repeat_an_id(spark):
    text = "\n".join(f"line {i} " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(6))
    other = "\n".join(f"other {i} " + " ".join(f"v{i}x{j}" for j in range(20)) for i in range(7))
    rows = [(1, text, 1), (2, text, 2), (2, other, 3), (3, other, 4), (3, other, 5), (4, None, 6), (4, text, 7)]
    got = sorted((r.doc_id, r.words, r.text) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    # 2 is its smaller text, a copy of 1; its other row is no source, so that 3 is the first with that text; 4 is its null
    assert got == [(1, 1, text), (2, 2, ""), (2, 3, other), (3, 4, other), (3, 5, other), (4, 6, None), (4, 7, text)]
