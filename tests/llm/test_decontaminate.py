import re

import pytest
from helpers import AWKWARD, documents

from docdelta.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=13):
    out = []
    for doc, text in rows:
        w, hit, who = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    if item is not None:
                        who.add(str(item))
        spans = dc.merged([(i, i + 1) for i in hit])
        out.append((doc, len(w), spans, sorted(who)))
    return sorted(out, key=repr)


def run(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(documents(spark, rows), bench).collect()
    return sorted(((r.doc_id, r.n_words, [(s.a, s.b) for s in r.spans], list(r["items"])) for r in got), key=repr)


LONG_ITEM = "It was the best of times, it was the worst of times; it was the age of wisdom, it was the age of foolishness."
ITEMS = [(1, LONG_ITEM), (2, "Two words"), (3, "single"), (4, None), (5, "... !"), (10, "naïve Ünïcödé 漢字漢字"), (11, LONG_ITEM), (None, "line that")]
ROWS = [
    *AWKWARD,
    (40, "Before. " + LONG_ITEM.upper() + " After."),
    (41, " ".join(LONG_ITEM.split()[:13])),
    (42, " ".join(LONG_ITEM.split()[:12])),
    (43, "two-WORDS two words two"),
    (44, "single single"),
    (45, " ".join(LONG_ITEM.split()[5:19]) + " x" * 300),
    (46, " ".join(LONG_ITEM.split()[9:])),
]


def test_against_brute_force(spark):
    assert run(spark, ROWS, ITEMS) == brute(ROWS, ITEMS)


def test_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 3)
    assert run(spark, ROWS, ITEMS) == brute(ROWS, ITEMS)


def test_judged(spark):
    rows = [(1, "two words" + " x" * 38), (2, "two words" + " x" * 39), (3, "")]
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in dc.judged(dc.contamination(documents(spark, rows), bench)).collect()}
    assert got == {1: (2, True), 2: (2, False), 3: (0, False)}


@pytest.mark.parametrize("rows,items", [([], ITEMS), (ROWS, [])])
def test_empty_tables(spark, rows, items):
    assert run(spark, rows, items) == brute(rows, items)
