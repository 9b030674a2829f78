"""The packing plan against exhaustive packing, and what share of it configurations make."""

import random

import numpy as np

from studyloom.llm.packing import best_knapsack, plan_blocks


def counted(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def sound(blocks, counts, capacity):
    """Every piece once, nothing over the capacity; the number of sequences."""
    seen = [set() for _ in range(capacity + 1)]
    for b in blocks:
        assert b.n > 0 and b.room == capacity - sum(x for x, _ in b.parts) >= 0 and b.planned <= len(b.parts)
        for length, rank in b.parts:
            ranks = set(range(rank, rank + b.n))
            assert not ranks & seen[length]
            seen[length] |= ranks
    assert [len(s) for s in seen] == counts.tolist() and all(s == set(range(len(s))) for s in seen)
    return sum(b.n for b in blocks)


def fewest(lengths, capacity):
    """Exhaustively: each piece, longest first, into each sequence that has room, or a new one."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_small_cases_against_all_packings():
    rng, over = random.Random(31), 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 33])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = counted(lengths, capacity)
        n, least = sound(plan_blocks(counts, capacity), counts, capacity), fewest(lengths, capacity)
        assert least <= n <= least + 1
        over += n - least
    assert over <= 12


def test_configurations_make_the_plan():
    for parts, least in (({1024: 200, 900: 200, 574: 400}, 300), ({1000: 300, 600: 300, 448: 300}, 300)):
        counts = np.zeros(2049, np.int64)
        for length, n in parts.items():
            counts[length] = n
        blocks = plan_blocks(counts, 2048)
        assert sound(blocks, counts, 2048) == least and sum(b.n * b.planned for b in blocks) == counts.sum()
    rng = np.random.default_rng(5)
    counts = counted(np.clip(rng.lognormal(6.2, 0.9, 20_000).astype(int), 1, 2048), 2048)
    blocks = plan_blocks(counts, 2048)
    bound = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert sound(blocks, counts, 2048) <= bound * 1.002
    assert sum(b.n * b.planned for b in blocks if b.planned > 1) >= 0.9 * counts[410:2048].sum()
    assert plan_blocks(np.zeros(2049, np.int64), 2048) == []


def test_knapsack_of_four():
    rng = np.random.default_rng(2)
    for _ in range(50):
        m, capacity = int(rng.integers(1, 7)), int(rng.integers(20, 60))
        sizes = np.sort(rng.choice(np.arange(capacity // 5 + 1, capacity + 1), min(m, capacity - capacity // 5), replace=False))[::-1]
        values = rng.random(len(sizes)) - 0.1
        value, counts = best_knapsack(sizes, values, capacity)
        assert (counts * sizes).sum() <= capacity and counts.sum() <= 4 and abs((counts * np.maximum(values, 0)).sum() - value) < 1e-9
        best = {0: 0.0}
        for _ in range(4):
            best = {w + a: max(v for x, v in ((w2 + b2, t + u) for w2, t in best.items() for b2, u in [(0, 0.0), *zip(sizes.tolist(), values, strict=True)]) if x == w + a) for w in best for a in [0, *sizes.tolist()] if w + a <= capacity}
        assert abs(value - max(best.values())) < 1e-9
