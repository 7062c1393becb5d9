"""No join of op13 is by a broadcast, however small Spark takes a side to be."""

from helpers import documents
from test_spelling import brute, corpus

from docdelta.llm import spelling as sp


def plans(spark, df):
    """The plan of df, as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_are_not_broadcast(spark):
    found = sp.words(documents(spark, corpus(5, "abc")))
    plan = plans(spark, sp.near_words(found))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_words_and_roots_are_not_broadcast(spark):
    rows = corpus(6, "abcd")
    out = sp.variants(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n")
    assert "Broadcast" not in plans(spark, out)
    assert sorted(map(tuple, out.collect())) == brute(rows)
