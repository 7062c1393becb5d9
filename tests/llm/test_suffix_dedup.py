import os

import numpy as np
import pytest
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from docdelta.llm import suffix_dedup as sd


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b) * 3), min_size=1, max_size=20), st.sampled_from([0, 4, 8, 64]))
def test_sorting(texts, shallow):
    order, prefixes = sd.deep_shallow_sort(texts, shallow)
    assert sorted(order) == [*range(len(texts))]
    assert [texts[i] for i in order] == sorted(texts)
    assert prefixes[0] == -1
    for i in range(1, len(order)):
        a, b = texts[order[i - 1]], texts[order[i]]
        assert prefixes[i] == sd.common_prefix(a, b) == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute(rows, width=50):
    first, out = {}, []
    data = [(-(2**63) if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            first[k] = min(first.get(k, d), d)
    for (doc, _), (d, b) in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = 1
        spans = int(np.sum(np.diff(np.concatenate([[0], gone])) == 1))
        out.append((doc, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def run(spark, rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in sd.remove_repeats(documents(spark, rows)).collect()), key=repr)


def passages():
    rng, rows = np.random.default_rng(3), []
    shared = ["".join(rng.choice(list("abcde é"), int(n))) for n in (49, 50, 51, 70, 200, 16, 120)]
    for d in range(120):
        own = lambda: "".join(rng.choice(list("xyz 漢w"), int(rng.integers(0, 60))))
        rows.append((d * 13 % 127, own() + "".join(shared[int(i)] + own() for i in rng.integers(0, len(shared), 3))))
    return [*rows, (300, "a" * 500), (301, "a" * 60), (302, "ab" * 100), (303, "a" * 49), (304, rows[0][1]), (305, rows[0][1])]


@pytest.mark.parametrize("block", [150_000, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    rows = [*AWKWARD, *passages()]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [150_000, 3])
def test_hot_anchors(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "HOT", 4)
    rows = [*AWKWARD, *passages()]
    assert run(spark, rows) == brute(rows)


def test_long_texts_in_pieces(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8))
    whole = sd.anchors(data)
    starts = {i: (a, h) for a, h, x, y in zip(*whole, strict=True) for i in range(x, y)}
    monkeypatch.setattr(sd, "PIECE", 700)
    assert {i: (a, h) for a, h, x, y in zip(*sd.anchors(data), strict=True) for i in range(x, y)} == starts


def test_empty_table(spark):
    assert run(spark, []) == []


def test_groups_of_two_need_no_trie(monkeypatch):
    texts = [b"", b"a", b"ab" * 40, b"ab" * 40 + b"c", b"abab\xff", b"b" * 9, b"b" * 9]
    pairs = [[a, b] for a in texts for b in texts]
    want = [(sorted(range(2), key=p.__getitem__), [-1, len(os.path.commonprefix(p))]) for p in pairs]
    monkeypatch.setattr(sd, "BlindTrie", None)
    assert [sd.deep_shallow_sort(p) for p in pairs] == want


@pytest.mark.parametrize("n", [50, 51, 700, (1 << 14) + 100])
def test_anchors_are_the_least_leftmost_grams(n):
    data = bytes(np.random.default_rng(n).integers(97, 100, n).astype(np.uint8)) if n != 700 else b"abc" * 233 + b"x"
    c1, c2, c3, mask = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 2**64 - 1

    def mixed(i):
        h = (int.from_bytes(data[i : i + 8], "little") * c1 & mask) ^ (int.from_bytes(data[i + 8 : i + 16], "little") * c2 & mask)
        h = (h ^ h >> 32) * c3 & mask
        return h ^ h >> 29

    hashes = [mixed(i) for i in range(n - 15)]
    want = [min(range(s, s + 35), key=lambda i: (hashes[i] >> 24, i)) for s in range(n - 49)]
    at, h, first, last = sd.anchors(data)
    assert [a for a, i, j in zip(at.tolist(), first.tolist(), last.tolist(), strict=True) for _ in range(i, j)] == want
    assert h.tolist() == [hashes[a] for a in at.tolist()]
