import hashlib

import numpy as np
import pytest
from helpers import AWKWARD, documents

from docdelta.llm import line_dedup as ld


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_numbers_each_key_once(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
    ph = ld.PerfectHash.from_bytes(ld.PerfectHash(h1, h2).to_bytes())
    assert sorted(ph.numbers(h1, h2).tolist()) == list(range(n))


def test_perfect_hash_lists_keys_that_never_part():
    h = np.array([5, 5], np.uint64)
    ph = ld.PerfectHash(h, h)  # equal keys never get places of their own
    assert len(ph.rest) == 1 and len(ph.to_bytes()) > 0


def brute(rows, min_chars=20, min_docs=3):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for doc, text in rows:
        for x in (text or "").split("\n"):
            held.setdefault(key(x), set()).add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in ld.dedup_lines(documents(spark, rows)).collect()), key=repr)


def test_against_brute_force(spark):
    rows = [*AWKWARD, (30, "\x0b  A SECOND line that is long enough to COUNT.\r\nÄ" + "x" * 18), (31, "Ä" + "X" * 19), (32, "ä" + "x" * 19), (33, "Ä" + "x" * 19), (34, "Ä" + "x" * 19)]
    assert run(spark, rows) == brute(rows)


def test_one_line_in_most_documents(spark):
    rows = [(i, f"this one line is in every document\nown line number {i} of this document") for i in range(3000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
