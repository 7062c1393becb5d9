"""Each document with a shared paragraph has a partner, however many documents share it."""

import pytest
from pyspark.sql import functions as F

from docdelta.sources import fixtures

LINE = "a paragraph of more than twenty characters, number {}"


def pairs(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((r.base_id, r.compare_id) for r in fixtures.Entities(spark, str(tmp_path)).pairs.collect())


@pytest.mark.parametrize("block", [4096, 16])
def test_groups_over_the_cap_are_paired_with_their_neighbours(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(fixtures, "BLOCK", block, raising=False)
    copies = [(10 * i, LINE.format(1)) for i in range(25)]
    header = [(10 * i + 1, LINE.format(2) + "\n" + f"a text of its own that nobody shares {i}") for i in range(30)]
    alone = [(5000, LINE.format(3)), (5001, None), (5002, None), (5003, "\n"), (5004, "\n")]
    want = [(10 * i, 10 * i + 10) for i in range(24)] + [(10 * i + 1, 10 * i + 11) for i in range(29)]
    assert pairs(spark, tmp_path, copies + header + alone) == sorted(want)


def test_a_copy_goes_before_a_document_that_shares_as_much(spark, tmp_path):
    one = LINE.format(1)
    assert pairs(spark, tmp_path, [(1, one), (2, one + "\nmore"), (3, one), (4, "short"), (5, "short")]) == [(1, 3), (2, 3), (4, 5)]


def test_few_holders_are_all_paired(spark, tmp_path):
    a, b = LINE.format(1), LINE.format(2)
    assert pairs(spark, tmp_path, [(1, f"{a}\n{b}"), (2, f"{a}\nx"), (3, f"{a}\n{b}\ny")]) == [(1, 3), (2, 3)]


def test_texts_are_read_once_for_pages_and_pairs(spark, monkeypatch):
    """Pairs and facing pages are made from one pass over the texts, and are those of the digests that Spark works out."""
    read, plain = [], fixtures.Entities.table
    monkeypatch.setattr(fixtures.Entities, "table", lambda e, name: read.append(name) or plain(e, name))
    e = fixtures.Entities(spark, "/root/testdata/sf0.001")
    assert e.facing_pages.count() > 0 and e.pairs.count() > 0
    assert read == ["documents"]


def test_digests_stand_for_the_same_texts_in_pages_as_in_keys(spark):
    long = "a paragraph of over twenty characters"
    texts = [long, f"\r\n{long}\r\rshort\n{long}", "é" * 20, "é" * 21, "\n\r\n", "", None, long + " " * 90, "x" * 4000]
    docs = spark.createDataFrame([*enumerate(texts), (0, long)], "doc_id long, text string")
    got = fixtures.pages_of_lines(docs, keys=True).where("page_no = 1")
    found = [{(r.doc_id, d) for r in got.select("doc_id", F.explode("paragraphs").alias("d")).collect() for d in [bytes(r.d)]}, {(r.doc_id, bytes(r.copy)) for r in got.collect()}]
    want = [{(r.doc_id, r.key) for r in fixtures.sharing_keys(docs).collect() if r.key[0] == kind} for kind in "pt"]
    for here, there in zip(found, want, strict=True):
        together = lambda s: sorted(sorted(i for i, k in s if k == key) for key in {k for _, k in s})
        assert together(here) == together(there)
