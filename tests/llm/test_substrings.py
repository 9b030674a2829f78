import hashlib
import random

import numpy as np

from studyloom.llm import substrings
from studyloom.llm.substrings import bounded_prefixes, dedup_substrings, removal_digest, suffix_order

SCHEMA = "doc_id long, text string, starts string, n_bytes long"


def brute(docs, length):
    seen, out = {}, {}
    for d, text in sorted((d, t or "") for d, t in docs):
        b = text.encode()
        gone = np.zeros(len(b) + 1, int)
        windows = [b[i : i + length] for i in range(len(b) - length + 1)]
        for i, w in enumerate(windows):
            if seen.get(w, d) < d:
                gone[i] += 1
                gone[i + length] -= 1
        for w in windows:
            seen.setdefault(w, d)
        gone = np.cumsum(gone[: len(b)]) > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(12, 60))) for _ in range(8)]
    docs = [(d, " ".join(rng.choice([*passages, word(), word()]) for _ in range(rng.randint(0, 9)))) for d in range(60)]
    return [*docs, (70, None), (71, ""), (72, "x" * 49), (73, "x" * 50), (74, "x" * 400), (75, docs[5][1]), (76, docs[5][1])]


def test_matches_brute_force(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in docs], SCHEMA)
    want = brute(docs, 50)
    assert {r.doc_id: tuple(r)[1:] for r in removal_digest(df).collect()} == want
    for name, value in (("HOT_LEAST", 2), ("HOT_SHARE", 0), ("SHARD_BYTES", 2000), ("BUCKET_ENTRIES", 100), ("FLUSH", 60), ("PIECE", 300)):
        monkeypatch.setattr(substrings, name, value)
    assert {r.doc_id: tuple(r)[1:] for r in removal_digest(df.repartition(3)).collect()} == want


def test_interface_and_edges(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    df = spark.createDataFrame([(1, text, "", 1), (2, "tail " + text, "", 1), (None, text, "", 1), (1, text, "", 1)], SCHEMA)
    rows = {(r.doc_id, bytes(r.kept)): [tuple(x) for x in r.removed] for r in dedup_substrings(df).collect()}
    assert rows[2, b"tail "] == [(5, 5 + len(text))] and rows[1, text.encode()] == []
    assert removal_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_different_texts_under_one_id(spark):
    passage, other = "".join(chr(97 + i % 26) + str(i) for i in range(40)), "".join(chr(65 + i % 26) + str(i * i) for i in range(40))
    rows = [(1, passage), (2, "zz " + passage), (2, other), (3, other), (3, other), (4, "yy" + other)]
    df = spark.createDataFrame([(d, t, "", 1) for d, t in rows], SCHEMA)
    got = sorted((r.doc_id, bytes(r.kept)) for r in dedup_substrings(df).collect())
    # document 2 is its smaller text, "other"; its row with the passage stays whole
    assert got == sorted([(1, passage.encode()), (2, b"zz " + passage.encode()), (2, other.encode()), (3, b""), (3, b""), (4, b"yy")])


def test_bounded_prefixes():
    rng = np.random.default_rng(1)
    text = np.full(300 + 72, 0xFF, np.uint8)
    text[:299] = rng.integers(97, 99, 299)
    order, place = suffix_order(text, 300, 12)
    found = bounded_prefixes(text, order, 12, 0xFF)
    assert (place[order] == np.arange(300)).all()
    raw = text[:300].tobytes()
    for i in range(1, 300):
        a, b = raw[order[i - 1] :], raw[order[i] :]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        if 0xFF not in a[: n + 1]:
            assert found[i] == (n if n < 12 else -1)


def _segments(texts, length=50):
    """All segments of texts of documents 0, 1, ..., as one shard gets them."""
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    a = substrings.Anchors(data, offsets, length)
    return substrings.Segments(a.hash.astype(np.int64), data, a.start, a.n + length - 1, a.text, a.start - offsets[a.text])


def test_only_segments_that_may_meet_reach_the_transform(monkeypatch):
    """Texts that share no more than an anchor cost no transform, however many; those that share a passage do."""
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    common, passage, seen = noise(30), noise(70), []
    whole = substrings.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", lambda data, *a: seen.append(len(data)) or whole(data, *a))
    apart = [noise(60) + common + noise(60) for _ in range(200)]
    assert [len(x) for x in substrings.common_windows(_segments(apart), 50)] == [0, 0, 0] and not seen
    texts = [*apart, noise(90) + passage + noise(90), noise(90) + passage + noise(90)]
    doc, start, size = substrings.common_windows(_segments(texts), 50)
    assert sum(seen) < 1000 and set(doc) == {201}
    assert all(90 <= a and a + n <= 160 for a, n in zip(start, size, strict=True))


def test_segments_left_out_of_the_transform_share_nothing(monkeypatch):
    rng, meeting = random.Random(11), substrings.meeting
    for length, alphabet in ((50, "ab "), (50, "abcdefgh"), (21, "abc"), (20, "ab"), (64, "abcd")):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, 70))) for _ in range(12)]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(30)]
        covered = []
        for chosen in (meeting, lambda s, _: np.arange(len(s.size))):
            monkeypatch.setattr(substrings, "meeting", chosen)
            spans = substrings.common_windows(_segments(texts, length), length)
            covered.append({(d, a + i) for d, a, n in zip(*spans, strict=True) for i in range(n)})
    assert covered[0] == covered[1] and bool(covered[0]) == (length > 20)  # of 20 bytes, a segment is a window


def test_shards_follow_what_is_shared(spark, monkeypatch):
    """Text that nothing shares makes no shards."""
    rng, asked = random.Random(13), []
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = noise(300)
    docs = [(d, noise(200_000) + (passage if d % 20 == 0 else "")) for d in range(40)]
    df = spark.createDataFrame([(d, t, "", 1) for d, t in docs], SCHEMA).coalesce(1)
    spans = substrings.covered_spans
    monkeypatch.setattr(substrings, "covered_spans", lambda docs, common, shards, length: asked.append(shards) or spans(docs, common, shards, length))
    removed = {r.doc_id: r.n_removed for r in removal_digest(df).collect()}
    assert asked == [1] and {d: n for d, n in removed.items() if n} == {20: 300}
