"""Hard negatives and vector codes against plain loops."""

import math
import random

import numpy as np
import pytest

from studyloom.llm import hard_negatives as hn
from studyloom.llm.vector_codes import Balls, compress, squared

SCHEMA = "id long, label int, vector array<double>, rank string, shard int, row string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, "a", 1, "b", "c") for i, label, v in rows], SCHEMA)


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, anchors, k, n, low, high):
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and sound(v):
            x = (label, [math.floor(256 * c) for c in v])
            best[i] = min(best.get(i, x), x)
    out = []
    for a in anchors:
        if a not in best:
            continue
        label, q = best[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, (other, v) in best.items() if i != a and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s] if (low, high) == (30, 90) else []
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit[:n], 1)]
    return sorted(out)


ODD = [(900, 1, None), (901, 1, [1.0, None]), (902, 1, [math.nan, 1.0]), (903, None, [0.5] * 8), (None, 1, [0.5] * 8), (904, 1, [math.inf] * 8), (905, 2, [0.0] * 8), (906, 2, [0.0] * 8), (907, 1, []), (908, 1, [0.3, 0.2]), (909, 2, [0.3, 0.1]), (910, 1, [0.3, 0.3])]


@pytest.mark.parametrize("clustered", [False, True])
def test_hard_negatives(spark, monkeypatch, clustered):
    rng = random.Random(4)
    monkeypatch.setattr(hn, "SHARD_ROWS", 40)
    monkeypatch.setattr(hn, "BUCKET_ROWS", 8)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = []
    for i in range(150):
        label, scale = rng.randrange(3), rng.choice([0.05, 0.3, 1.0])
        c = centres[label if rng.random() < 0.7 else rng.randrange(3)] if clustered else [0.0] * 8
        rows.append((i, label, [scale * (x + rng.gauss(0, 0.3)) for x in c]))
    rows += [(200 + i, i % 3, rows[0][2]) for i in range(20)] + [(5, 0, rows[9][2]), (5, 0, rows[9][2])] + ODD
    df = frame(spark, rows)
    anchors = [i for i, *_ in rows if i is not None and i % 10 == 0 or i in (905, 907, 908)]
    got = hn.hard_negatives(df, df.where("id % 10 = 0 or id in (905, 907, 908)"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, sorted(set(anchors)), 5, 10, 30, 90)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    empty = frame(spark, [])
    assert hn.hard_negatives(empty, empty).count() == 0


def test_coordinate_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (400, 16))
    x[:, 0] += 500 * (np.arange(400) % 4 == 0)
    ids, labels = np.arange(400), np.zeros(400, int)
    b = hn.Shard(ids, labels, x).buckets[0]
    q = b.x[b.ids == 0][0]
    unit = q / np.linalg.norm(q)
    found = b.candidates(unit, np.argsort(-np.abs(unit))[:4], 0.9)
    near = np.flatnonzero(b.x @ q >= 0.9 * np.linalg.norm(q) * b.longest)
    assert set(near) <= set(found.tolist()) and len(found) < 200


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if sound(v) and len(v) == 8]
    cut = lambda v: [v[p * 8 // parts : (p + 1) * 8 // parts] for p in range(parts)]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(r[2])[p] for r in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(c, books[p][e]), e)) for p, c in enumerate(cut(v))] for _, _, v in kept]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [cut(r[2])[p] for r, c in zip(kept, codes, strict=True) if c[p] == e]
                    if mine:
                        books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((str(i), str(label), c, sum(far(x, books[p][c[p]]) for p, x in enumerate(cut(v)))) for (i, label, v), c in zip(kept, codes, strict=True)), books


def test_vector_codes(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, rng.choice([0, 1, None]), [x + rng.gauss(0, rng.choice([0.01, 0.2])) for x in rng.choice(centres)]) for i in range(120)]
    rows += [(300 + i, 1, rows[0][2]) for i in range(30)] + [(7, 2, rows[0][2]), (7, 2, rows[0][2])] + ODD
    df = frame(spark, rows)
    for entries in (1, 12, 300):
        got, books = compress(df, 4, entries, 3)
        want, plain_books = plain_codes(rows, 4, entries, 3)
        assert sorted((str(r.id), str(r.label), r.codes, r.error) for r in got.collect()) == want
        assert books.tolist() == plain_books
    assert compress(frame(spark, []))[0].count() == 0
    assert compress(df.where("vector is null"))[0].count() == 0
    with pytest.raises(Exception, match="scaled components"):
        compress(frame(spark, [(1, 1, [1e300] * 4)]))


def test_balls_agree_with_a_full_search_from_any_start():
    rng = np.random.default_rng(1)
    for scale in (3, 200, 1 << 25):
        entries = rng.integers(-scale, scale, (40, 4))
        entries[7] = entries[3]  # equal entries: the lower index
        x = np.concatenate([rng.integers(-scale, scale, (500, 4)), entries])
        balls = Balls(entries)
        code, far = balls.assign(x)
        assert (far == squared(x, entries).min(1)).all()
        again, far2 = balls.reassign(x, rng.integers(0, 40, len(x)))
        assert (again == code).all() and (far2 == far).all()
        assert (balls.reassign(x, code)[0] == code).all()
