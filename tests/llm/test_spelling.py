import random
import re
import zlib
from collections import Counter, defaultdict

from helpers import AWKWARD, documents

from docdelta.llm import spelling as sp


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if words[x] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), c, len(near[w]), words[form[w]] if w in form else None) for w, c in words.items())


def run(spark, rows):
    return sorted(tuple(r) for r in sp.variants(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, letters, words=120):
    """Words of few letters, their edits at every place, and counts that make chains of forms."""
    rng, rows = random.Random(seed), []
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 13))) for _ in range(words)]
    for i, w in enumerate(base):
        for k, times in ((0, 150), (1, 30), (2, 5)):
            rows.append((i * 10 + k, f"{w}. " * times))
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[: max(at - 1, 0)] + rng.choice(letters) + w[at:]])
    return rows


def test_against_brute_force(spark):
    for seed, letters in ((1, "ab"), (2, "aeiou"), (3, "abcdeéßÿ×")):
        rows = corpus(seed, letters)
        assert run(spark, rows) == brute(rows)


def test_lists_follow_the_dictionary(spark, monkeypatch):
    """With nothing frequent all grams are pairs, with everything frequent all are as long as may be: the same words are near."""
    rows = corpus(4, "abc")
    want = brute(rows)
    for bound in (1, 10**9):
        monkeypatch.setattr(sp, "FREQUENT", bound)
        assert run(spark, rows) == want


def test_edits_at_every_place(spark):
    w = "abcdefghij"
    edits = {w[:i] + c + w[i + j :] for i in range(len(w) + 1) for j in (0, 1) for c in ("", "z", "b")} - {w}
    rows = [(1, f"{w} " * 99), (2, " ".join(x for x in edits for _ in range(5)))]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[w][4] == len([x for x in edits if x in got]) and all(r[1] == w and r[2] == w for x, r in got.items() if x != w)
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    text = "Déjàvu déjàvu DÉJÀVU straße straßen naïveté " * 6
    rows = [*AWKWARD, (20, text), (20, text), (None, text), (None, text + "Déjávu " * 40), (21, "x" * 5000 + " "), (22, ("y" * 4000 + "1") * 9)]
    assert run(spark, rows) == brute(rows)


def test_pieces_cut_between_runs(spark, monkeypatch):
    monkeypatch.setattr(sp, "PIECE", 7)
    text = "one twoandthree, four-five sixandseveneightnine 10 é"
    assert [r for p in sp.pieces(text) for r in sp.RUN.findall(p)] == sp.RUN.findall(text) and "".join(sp.pieces(text)) == text


def test_asked_grams_survive_any_edit(spark):
    """Whatever the edit, one of the two grams that a word asks is among the other's, at a place that its list has."""
    rng = random.Random(9)
    counts = defaultdict(int, {a + b: rng.randint(1, 99) for a in "abc" for b in "abc"})
    counts |= {a + b + c: 5 for a in "abc" for b in "ab" for c in "ac"}
    g = sp.Grams(dict(counts))
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(6, 14)))
        i, longest = rng.randrange(len(w)), min(sp.LONGEST, len(w) // 2)
        for other, moved in ((w[:i] + rng.choice("abc") + w[i + 1 :], 0), (w[:i] + w[i + 1 :], 1)):
            lists = {(p, gram) for p, _, gram in g.windows(other, longest)}
            assert other == w or any((p, gram) in lists or (moved and (p - 1, gram) in lists) for p, gram in g.asked(w, longest))


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, ""), (3, "a b c")]) == []
