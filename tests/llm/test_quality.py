import zlib

import numpy as np
from helpers import AWKWARD, documents

from docdelta.llm import quality as q

SF = "/root/testdata/sf0.1"


def test_context_sums_by_hand():
    texts = ["one two three two", None, "", "One"]
    want = np.zeros((q.TOKENS, q.DIMS), np.int64)
    for t in texts:
        cores, shapes = q.tokens(t)
        for i in range(len(cores)):
            for j in range(max(0, i - q.AROUND), min(len(cores), i + q.AROUND + 1)):
                if i != j:
                    for mine in (cores[i], shapes[i]):
                        want[mine] += (q._INDEX[cores[j]] + q._INDEX[shapes[j]]).astype(np.int64)
    assert (q.context_sums(texts) == want).all()


def test_shapes():
    assert [q.shape(w) for w in ("the", "The", "THE!!", "x***", "|", "a1-B", "été")] == ["x", "Xx", "X!!", "x***", "|", "x9-X", "x"]


def test_known_words_stay_within_their_bytes():
    words = q._Tokens(2000)
    for i in [*range(60), *range(60)]:
        word = f"Wörd{i % 17}{'x' * (i % 5)}!".encode()
        assert words[word] == q.token(word)
        assert sum(len(w) + q.WORD_BYTES for half in (words, words.old) for w in half) <= 2000
    words.within(10)
    assert not words and not words.old


def test_short_ways_give_the_tokens_of_the_patterns():
    for w in "the The THE tHe X x fox. Fox!? FOX... a..... Ab!!!!!!! été Été ÉTÉ ß x1 Don't ... ,a µ² ǅx 中文 a中 !".split():
        core, form = divmod(q.token(w.encode()), q.SHAPES)
        letters = "".join(c for c in w if c.isalpha()).lower()
        assert (core, form) == (zlib.crc32(letters.encode()) % q.CORES, zlib.crc32(q.shape(w).encode()) % q.SHAPES), w


def test_pooled_features_by_hand():
    vectors = np.random.default_rng(3).normal(size=(q.TOKENS, q.DIMS)).astype(np.float32)
    text = "One two TWO, 22 one!"
    cores, shapes = q.tokens(text)
    mean = [sum(t[i] for i in ids) / 5 for t, ids in ((vectors, cores), (vectors, shapes), (q._INDEX, shapes))]
    want = np.concatenate([*mean, [np.log(6), len(set(cores)) / 5, len(text) / 50, max(list(cores).count(c) for c in cores) / 5]])
    assert np.allclose(q.pooled(text, vectors), want, atol=1e-5)


def test_sums_of_many_tasks_are_those_of_one(spark, monkeypatch):
    monkeypatch.setattr(q, "FAN_IN", 2)
    docs = spark.createDataFrame([(f"word{i % 5} and Other{i % 3} again",) for i in range(60)], "text string")
    assert np.array_equal(q.word_vectors(docs.repartition(9)), q.word_vectors(docs.coalesce(1)))


def test_network_separates_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, q.FEATURES)).astype(np.float32)
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1] - x[:, 2]))
    y = (rng.random(4000) < p).astype(float)
    net = q.fit(x[:3000], y[:3000], np.arange(3000) % 5 == 0)
    s = net.scores(x[3000:])
    assert abs(s.mean() - y[3000:].mean()) < 0.06
    assert q._loss(net.logits(x[3000:]) / net.temperature, y[3000:]) < q._loss(np.full(1000, 0.0), y[3000:])


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = q.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) > 50
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.85
    order = got.score.rank()
    auc = (order[got.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / len(good) / len(bad)
    assert auc > 0.97


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (7, 0), (99, 1), (8, None), (None, 1), (3, 0)], "doc_id long, quality int")
    docs = documents(spark, AWKWARD)
    got = q.quality_scores(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by_text = dict(AWKWARD[:1])
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1 and by_text
    assert q.quality_scores(docs.limit(0), labels).collect() == []
    none = q.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
