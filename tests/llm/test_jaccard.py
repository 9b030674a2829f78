import random
import re

import pytest

from studyloom.llm import jaccard
from studyloom.llm.jaccard import drop_similar, similar_components

SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("KLMNop")
    docs, d = [], 0
    for size in (1, 2, 4, 9, 30, 70, 150, 400):
        base = [word() for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, size // 30])):
                copy[rng.randrange(size)] = word()
            docs.append((d, rng.choice([" ", "\n", "\t"]).join(copy)))
            base, d = (copy if rng.random() < 0.5 else base), d + 1
    rng.shuffle(docs)
    return [*docs, (900, None), (901, " \n"), (902, ""), (903, "\x00a b c")]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_matches_brute_force(spark, monkeypatch, k, percent):
    docs = corpus(k)
    monkeypatch.setattr(jaccard, "FLUSH_ENTRIES", 500)
    monkeypatch.setattr(jaccard, "BUCKET_ENTRIES", 300)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard, "VERIFY_ROWS", 3)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df, k, percent).collect()}
    assert got == brute(docs, k, percent)


def test_drop_similar_and_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(3, text, "a"), (5, text.upper(), "b"), (4, None, "c"), (6, None, "d"), (None, text, "e"), (3, text, "a")], SCHEMA)
    kept = drop_similar(df)
    assert kept.columns == df.columns
    assert sorted(r.n_shingles for r in kept.collect()) == ["a", "a", "c", "d", "e"]
    assert similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_repeat_an_id(spark):
    long, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, long), (2, other), (2, long), (3, other), (4, long), (4, None), (5, long)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df, 5, 80).collect()}
    # 2 is its smaller text, which is that of 3; 4 is its null
    assert got == {1: (36, 1), 2: (36, 2), 3: (36, 2), 4: (0, 4), 5: (36, 1)}
    assert sorted(r.doc_id for r in drop_similar(df, 5, 80).collect()) == [1, 2, 2, 4, 4]


def test_drop_similar_keeps_other_texts_of_an_id(spark):
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, text, "p"), (2, text, "q"), (2, other, "r"), (2, text, "s"), (None, text, "t")]
    kept = drop_similar(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.n_shingles for r in kept.collect()) == ["p", "r", "t"]


def test_sketches_of_different_sizes_dismiss_pairs(spark):
    """Sets of about 1,100 and 1,200 shingles have sketches of 512 and 1,024 bytes; half of each is the other's."""
    text = lambda n: " ".join(f"w{i}" if i < 600 else f"{n} {i}" for i in range(n - 300 if n > 600 else n))
    df = spark.createDataFrame([(1, text(1165)), (2, text(1230))], "doc_id long, text string")
    sets = jaccard.set_table(df, 5, 80).cache()
    rows = {r.doc_id: r for r in sets.collect()}
    assert len(rows[1].sketch) < len(rows[2].sketch) and rows[1].n > 0.8 * rows[2].n
    assert jaccard.likely(spark.createDataFrame([(1, 1, 2)], "key long, a long, b long"), sets, 80).count() == 0
