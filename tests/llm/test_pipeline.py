import zlib

import corpus_pipeline as cp
from helpers import documents
from test_decontaminate import brute as hits
from test_near_dedup import brute as components
from test_token_store import brute as tokens

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = cp.keep_quality(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r[0] for r in rows(good)}
    held = [(d, q) for d, q in labels.items() if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(d in kept for d, q in held if q == 1)
    one = cp.keep_one_of_near_duplicates(spark, good, SF)
    assert {r[0] for r in rows(one)} == {d for d, _, c, k in components(rows(good), 5) if k}
    clean = cp.drop_contaminated(spark, one, SF)
    bad = {d for d, n, spans, _ in hits(rows(one), items) if spans and 20 * sum(b - a for a, b in spans) >= n}
    assert {r[0] for r in rows(clean)} == {r[0] for r in rows(one)} - bad
    mixed = cp.mix_sources(spark, clean, SF)
    assert mixed.columns == docs.columns and {r[0] for r in rows(mixed)} <= {r[0] for r in rows(clean)}
    assert abs(sum(len((t or "").split()) for _, t in rows(mixed)) / sum(len((t or "").split()) for _, t in rows(clean)) - 1.5) < 0.05
    got = cp.to_token_files(spark, mixed, SF).collect()
    want = tokens(rows(mixed))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((d, n, c) for d, _, n, c in want)


def test_awkward_rows(spark):
    docs = documents(spark, [(1, "a b c"), (None, "d e f g h i"), (2, None), (2, ""), (3, "a b c")]).select(cp.DOCUMENT)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 1, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
