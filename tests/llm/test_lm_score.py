import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, documents

from docdelta.llm import lm_score as lm


def words(text):
    return (text or "").encode().lower().split()


def brute_base(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        ts = [*words(t), b""]
        out.append((d, held(d), len(ts), sum(counts[x] > 0 for x in ts), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1 << 15, 1 << 18), (8, 20)])
def test_counts_and_base_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(lm, "CODED", sizes[0])
    monkeypatch.setattr(lm, "LISTED", sizes[1])
    rows = [*AWKWARD, *((50 + i, f"The cat {i % 5} sat on the MAT number {i}") for i in range(40))]
    got = lm.lm_scores(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == brute_base(rows)
    assert all(r.score < 0 for r in got)


def test_huffman_codes_are_prefix_free():
    start, length, nodes, bits = lm.huffman([5, 0, 9, 1, 1])
    codes = ["".join(map(str, bits[s : s + n])) for s, n in zip(start, length, strict=True)]
    assert sum(2.0 ** -len(c) for c in codes) == 1 and not any(a != b and a.startswith(b) for a in codes for b in codes)
    assert len(codes[2]) == min(map(len, codes))


def model(codes, rng):
    n = 2 << codes.slot_bits
    counts = [rng.integers(0, 40, n) * rng.integers(0, 2, n) for _ in range(2)]
    return lm.Model(codes.plain, counts, lm.first_weights() + rng.normal(0, 0.1, (lm.GATES, lm.INPUTS)), rng.integers(0, 50, (lm.GATES * lm.REFINED, 2)))


def test_a_token_s_probabilities_add_up_to_one(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BITS", 3)
    codes = lm.Codes([(b"", 4), (b"a", 9), (b"b", 5), (b"c", 2)], 25)
    m, total = model(codes, np.random.default_rng(0)), 0
    for last in range(5):
        ids = np.array([1, 2, last if last < 4 else -1])
        events = codes.events([(ids, [b"a", b"b", b"other"])])
        p = np.bincount(events[0], m.log10(events, np.zeros(len(events[0]), int)))
        total += 10 ** p[2]
    assert total == pytest.approx(1)


def brute_bits(codes, m, ids, words):
    """The model of one document, bit by bit."""
    sig = lambda z: 1 / (1 + math.exp(-min(max(z, -12), 12)))
    _, node, bit, s1, s2 = codes.events([(ids, words)])
    w, step, out = m.weights.copy(), np.zeros_like(m.weights), 0.0
    for i in range(len(bit)):
        if i and i % lm.BLOCK_BITS == 0:
            w, step = w + lm.RATE_WITHIN * step / math.sqrt(lm.BLOCK_BITS), np.zeros_like(w)
        states = [int(m.s0[node[i]]), int(m.s1[s1[i]]), int(m.s2[s2[i]])]
        x = [(s % lm.LEVELS + 0.5 - lm.LEVELS / 2) * lm.STEP for s in states] + [0.3]
        g = states[1] // lm.LEVELS * 4 + states[2] // lm.LEVELS
        z = float(np.dot(w[g], x))
        cell = g * lm.REFINED + min(max(math.floor(z * 2 + lm.REFINED / 2), 0), lm.REFINED - 1)
        q = min(max((m.ones[cell] + lm.TRUST * sig(z)) / m.weight[cell], 1e-5), 1 - 1e-5)
        out += math.log10(q if bit[i] else 1 - q)
        step[g] += (bit[i] - sig(z)) * np.array(x)
    return out


def test_scores_against_brute_force(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BITS", 7)
    codes = lm.Codes([(b"", 4), *((b"w%d" % i, 40 - i) for i in range(30))], 900)
    rng = np.random.default_rng(4)
    m = model(codes, rng)
    found = []
    for n in (0, 5, 60, 1, 33):
        ids = rng.integers(-1, 31, n)
        found.append((np.append(ids, 0), [b"x%d" % i for i in range(n)]))
    events = codes.events(found)
    doc = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])[events[0]]
    got = np.bincount(doc, m.log10(events, doc))
    assert got == pytest.approx([brute_bits(codes, m, ids, words) for ids, words in found], rel=1e-4)


def test_learning_goes_down(monkeypatch):
    monkeypatch.setattr(lm, "BATCH_BITS", 256)
    codes = lm.Codes([(b"", 400), *((b"w%d" % i, 100) for i in range(16))], 2000)
    learner = lm.Learner(codes)
    text = [(np.array([*(1 + (i * 5 + k * 3) % 16 for k in range(40)), 0]), [b"w"] * 40) for i in range(16)]
    for _ in range(30):
        learner.learn(codes.events(text))
    m = lm.Model(codes.plain, learner.counts, learner.weights, learner.seen)
    events = codes.events(text)
    assert m.log10(events, np.repeat(np.arange(16), 41)[events[0]]).mean() > -0.1  # 0.3 for bits of no pattern


def test_held_out_documents_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = lm.lm_scores(docs).where("held_out").agg({"base_score": "sum", "score": "sum", "n_tokens": "sum"}).first().asDict()
    assert got["sum(score)"] > 0.97 * got["sum(base_score)"]  # negative: nearer to 0


def test_empty_tables(spark):
    assert lm.lm_scores(documents(spark, [])).collect() == []
    only = lm.lm_scores(documents(spark, [(next(d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2), "x y")])).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in only] == [(True, 3, 0, 0, 0.0)]


def test_states_of_small_counts_are_looked_up():
    rng = np.random.default_rng(5)
    n = np.concatenate([rng.integers(0, 4, (500, 2)), rng.integers(0, 300, (500, 2)), rng.integers(0, 2**32, (500, 2)), [[255, 256], [256, 255], [255, 255], [0, 2**31]]]).astype(np.uint64)
    want = lm.state(n[:, 0].astype(np.float32), n[:, 1].astype(np.float32))
    assert (lm.state_of(n[:, 0] | n[:, 1] << np.uint64(32)) == want).all()


def test_what_the_mixer_reads_and_its_steps():
    s = np.random.default_rng(6).integers(0, 4 * lm.LEVELS, (3, 400)).astype(np.uint8)
    x, gate = lm.inputs(*s)
    assert np.allclose(x[:3], (s % lm.LEVELS + 0.5 - lm.LEVELS / 2) * lm.STEP) and (x[3] == np.float32(0.3)).all()
    assert (gate == s[1] // lm.LEVELS * (len(lm.SEEN) + 1) + s[2] // lm.LEVELS).all()
    w, error = np.random.default_rng(7).random((lm.GATES, lm.INPUTS)), np.linspace(-1, 1, 400)
    assert np.allclose(lm.dot(w, gate, x), (w[gate] * x.T).sum(axis=1), rtol=1e-5, atol=1e-5)
    want = np.zeros((lm.GATES, lm.INPUTS))
    np.add.at(want, gate, (error * x).T)
    assert np.allclose(lm.slopes(gate, error, x, lm.GATES), want)
