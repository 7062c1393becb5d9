import hashlib

import pytest
from helpers import AWKWARD, LONG, documents
from pyspark.sql import functions as F

from docdelta.llm import fingerprint as fp


def blocks(text):
    return {p[i : i + fp.BLOCK] for p in text.split("\n") for i in range(0, len(p), fp.BLOCK)}


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    # Rows of equal ids differ in these tests only where their texts don't matter to the order.
    order = sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        t, n = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + n[:m]
        out.append((doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(blocks(t), blocks(edited)), 9), round(like(blocks(t), blocks(n)), 9)))
    return sorted(out, key=repr)


ROWS = [*AWKWARD, *((100 + i, "\n".join(f"paragraph {(i * j) % 37} of some words that repeat here and there {j % 5}" for j in range(i % 40))) for i in range(60)), (400, LONG[:3000]), (401, LONG[:2990] + "end")]


@pytest.mark.parametrize("rows", [ROWS, [(1, "only one")], []])
def test_against_brute_force(spark, rows):
    got = fp.fingerprints(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == brute(rows)
    by_text = {}
    texts = {d: t for d, t in rows}
    for r in got:
        by_text.setdefault(frozenset(blocks(texts[r.doc_id] or "")), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def test_peeling_recovers_each_side(spark):
    cases = [(list(range(5)), list(range(2, 9))), ([], [1]), ([3], [3]), (list(range(100, 140)), list(range(120, 150)))]
    df = spark.createDataFrame([([{"sign": 1, "digest": d} for d in a] + [{"sign": -1, "digest": d} for d in b], len(set(a) - set(b)), len(set(b) - set(a))) for a, b in cases], "signed array<struct<sign: int, digest: bigint>>, ours int, theirs int")
    got = df.select("ours", "theirs", fp.peel(fp.sketch(F.col("signed"), 80), 80).alias("r")).collect()
    assert all(r.r.ok and (r.r.ours, r.r.theirs) == (r.ours, r.theirs) for r in got)
    small = df.select(fp.peel(fp.sketch(F.col("signed"), 2), 2)["ok"].alias("ok")).collect()
    assert not small[3].ok
