import numpy as np
from helpers import AWKWARD, LONG, documents

from docdelta.llm import near_dedup as nd
from docdelta.llm.graph import components


def sets(text, n):
    w = (text or "").encode().lower().split()
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, n, percent=80):
    s = [sets(t, n) for _, t in rows]
    name = list(range(len(rows)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(s[i] & s[j])
            if s[i] and s[j] and 100 * shared >= percent * (len(s[i]) + len(s[j]) - shared):
                name[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((doc, len(s[i]), c, doc == c))
    return sorted(out, key=repr)


def run(spark, rows, n, percent=80):
    return sorted(map(tuple, nd.near_duplicates(documents(spark, rows), n, percent).collect()), key=repr)


def variants():
    """Chains and stars of texts that differ in a few words, some at just 0.8 and just under."""
    rng, rows = np.random.default_rng(5), []
    for g in range(40):
        size = int(rng.integers(2, 120))
        base = [f"g{g}w{x}" for x in rng.integers(0, 500, size)]
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows) * 7 % 1009, " ".join(base)))
            for at in rng.integers(0, size, int(rng.integers(0, 1 + size // 15))):
                base[at] = f"new{rng.integers(0, 10**6)}"
    rows += [(3000 + i, "a b c d " + ("e" if i else "f")) for i in range(2)]  # 3 of 5 pairs
    rows += [(3100 + i, "p q r s t u v w x y " + z) for i, z in enumerate(("z", "zz"))]
    return rows


def test_against_brute_force(spark):
    rows = [*AWKWARD, *variants(), (5000, LONG), (None, "two words"), (5001, "Two\tWORDS")]
    for n in (2, 5):
        assert run(spark, rows, n) == brute(rows, n)


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    base = [f"w{i}" for i in range(40)]
    rows = [*variants()[:60], *((4000 + i, " ".join([*base[:i], f"x{i % 7}", f"y{i}", *base[i + 1 + i % 5 :]])) for i in range(36))]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_exactly_at_the_threshold(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, "k l m n"), (4, "k l m n o p")]  # 4 of 5 pairs; 3 of 5
    assert {r[0]: r[2] for r in run(spark, rows, 2)} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 50], f"x{i}", *base[i % 50 :]])) for i in range(700)]
    got = run(spark, rows, 2)
    assert {r[2] for r in got} == {0} and sum(r[3] for r in got) == 1


def test_estimate_is_near_the_index():
    rng = np.random.default_rng(2)
    for shared, own in ((900, 100), (500, 250), (0, 500), (50, 3)):
        pool = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
        a, b = pool[: shared + own], np.concatenate([pool[:shared], pool[2000 : 2000 + own]])
        ra, rb = (nd.registers(nd.least_values(x))[None] for x in (a, b))
        got = nd.estimate(ra, rb, np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - shared / (shared + 2 * own)) < 0.17


def test_empty_tables(spark):
    assert run(spark, [], 2) == []
    assert run(spark, [(1, ""), (2, None)], 2) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 17] + [(50, 40), (41, 50), (60, 60)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 if i < 18 else 18 for i in range(31)}, 40: 40, 41: 40, 50: 40}
