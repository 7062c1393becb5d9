"""Decisions of the pipeline hold for rows, also where ids are null or repeat."""

import corpus_pipeline as cp
from helpers import documents

SF = "/root/testdata/sf0.001"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
OTHER = "red green blue black white brown pink grey orange purple yellow silver golden violet amber"


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_one_row_of_each_near_duplicate_group_stays(spark):
    rows = [(None, WORDS), (None, WORDS), (None, OTHER), (7, OTHER), (7, OTHER), (7, WORDS + " a b c d e f g h i"), (3, OTHER), (None, None)]
    docs = documents(spark, rows).select(cp.DOCUMENT)
    want = [(None, WORDS), (3, OTHER), (7, WORDS + " a b c d e f g h i"), (None, None)]
    assert left(cp.keep_one_of_near_duplicates(spark, docs, SF)) == sorted(want, key=repr)


def test_a_contaminated_row_takes_no_clean_row_of_its_id_along(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r.text or "").split()) > 13)
    docs = documents(spark, [(None, item), (None, "clean words"), (5, item), (5, "other clean words"), (6, item)]).select(cp.DOCUMENT)
    assert left(cp.drop_contaminated(spark, docs, SF)) == sorted([(None, "clean words"), (5, "other clean words")], key=repr)
