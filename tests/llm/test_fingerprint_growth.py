from helpers import documents
from pyspark.sql import functions as F

from docdelta.llm import fingerprint as fp

CASES = [
    (list(range(5)), list(range(2, 9))),
    ([], [1]),
    ([3], [3]),
    ([], []),
    (list(range(100, 140)), list(range(120, 150))),
    (list(range(400)), list(range(390, 500))),
    (list(range(300)), []),
]


def _arrays(spark):
    return spark.createDataFrame([(a, b, len(set(a) - set(b)), len(set(b) - set(a))) for a, b in CASES], "a array<long>, b array<long>, ours int, theirs int")


def _peeled(width):
    return fp.peel(fp.subtract(fp.sketch_of(F.col("a"), width), fp.sketch_of(F.col("b"), width)), width)


def test_subtracted_sketches_give_the_set_differences(spark):
    got = _arrays(spark).limit(5).select("ours", "theirs", _peeled(80).alias("r")).collect()
    assert all(r.r.ok and (r.r.ours, r.r.theirs) == (r.ours, r.theirs) for r in got)


def test_sketches_grow_until_they_are_peeled(spark):
    side = lambda name, sign: F.transform(name, lambda d: F.struct(F.lit(sign).alias("sign"), d.alias("digest")))
    signed = F.concat(side("a", 1), side("b", -1))
    got = _arrays(spark).select("ours", "theirs", _peeled(fp.PART_CELLS)["ok"].alias("first"), fp.grown(signed).alias("r")).collect()
    assert not all(r.first for r in got)
    assert all(r.r.ok and (r.r.ours, r.r.theirs) == (r.ours, r.theirs) for r in got)


def test_an_insertion_changes_one_sentence(spark):
    text = " ".join(f"Sentence number {i} of a paragraph." for i in range(200))
    rows = [(1, text), (2, text[:40] + "x" + text[40:])]
    got = {r.doc_id: r for r in fp.fingerprints(documents(spark, rows), units=fp.SENTENCES).collect()}
    assert round(got[2].near_next, 9) == round(199 / 201, 9)


def test_no_python_on_the_main_path(spark):
    plan = fp.fingerprints(documents(spark, [(1, "one"), (2, "two")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
