from collections import Counter, defaultdict

import pytest
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from docdelta.llm import source_mix as sm


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 8), min_size=1, max_size=8), st.integers(0, 400))
def test_fill_is_within_bounds(counts, budget):
    got = sm.fill(counts, budget)
    assert all(0 <= got.get(k, 0) <= n for k, n in counts.items())
    total = sum(k * n for k, n in got.items())
    assert total <= budget
    if min(counts) == 1 and counts[1] >= max(counts):
        assert total == min(budget, sum(k * n for k, n in counts.items()))


def test_fill_meets_a_reachable_rest_exactly():
    assert sum(k * n for k, n in sm.fill({7: 3, 11: 2, 13: 1}, 31).items()) == 31
    assert sum(k * n for k, n in sm.fill({5: 1000, 7: 1000}, 6001).items()) == 6001


def water(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by sharing the excess again until none is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, money = {}, set(names), share * sum(sizes.values())
    while free:
        level = money / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            money -= target[s]
        free -= over
    return target


ROWS = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", "é", None, "tiny"][0 if i % 3 == 0 else i % 4 if i % 50 else 4]) for i in range(1500)]


@pytest.mark.parametrize("rows", [ROWS, [(*r, "s" if r[0] else None) for r in AWKWARD], [(1, "", "a"), (2, None, "b")]])
def test_mix(spark, rows):
    got = sm.mix(documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes, counts = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    goal = water(sizes)
    source_of = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
        taken[s] += r.taken
        counts[s] = max(counts[s], r.size)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(1, counts[s])
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, sm.mix(documents(spark, rows[::-1])).collect()), key=repr)


def test_empty_table(spark):
    assert sm.mix(documents(spark, [])).collect() == []
