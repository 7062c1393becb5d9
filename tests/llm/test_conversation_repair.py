import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from docdelta.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, copies long, part int, block int, cost long"
SHAPE = re.compile("(s?(ua)+)?")


def frame(spark, rows):
    """Rows with columns of clashing names; each is there once."""
    return spark.createDataFrame([(*r, 1, 5, 6, 7) for r in rows], SCHEMA)


def bare(text):
    return text.rstrip(" \t\n\x0b\x0c\r")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        t = bare(text)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "" if t[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) over every choice of an edit for each row and of up to two insertions in each gap."""
    what, best = faults(rows), None
    for inserts in product(range(3), repeat=len(rows) + 1):
        if 5 * sum(inserts) > 2 * len(rows):  # to delete every row is cheaper
            continue
        for edits in product(*("D" if f in ("blank", "duplicate") else "DKR" for f in what)):
            cost, audit, lines, n = 5 * sum(inserts), "I" * inserts[0], ["" for _ in range(inserts[0])], 0
            lines = [None] * inserts[0]
            for row, edit, f, more in zip(rows, edits, what, inserts[1:], strict=True):
                cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if f == "truncated" and edit != "D" else 0)
                audit += edit + "I" * more
                lines += ([] if edit == "D" else [(edit, *row)]) + [None] * more
            n = len(lines)
            target = ("s" if n % 2 else "") + "ua" * (n // 2)
            if n % 2 and n < 3 or not SHAPE.fullmatch(target):
                continue
            if any((x is None or x[0] == "R") and t == "s" or x is not None and x[0] == "K" and x[1][:1] != t for x, t in zip(lines, target, strict=True)):
                continue
            if best is None or (cost, audit) < best[:2]:
                names = {"u": "user", "a": "assistant"}
                best = cost, audit, [f"{names[t]}:" if x is None else f"{x[1] if x[0] == 'K' else names[t]}:{x[2]}" for x, t in zip(lines, target, strict=True)]
    return best


def brute(rows, damage):
    groups = {}
    for conv, turn, role, text in rows:
        of = groups.setdefault(conv, [])
        role, text, times = " " if role is None else role, " " if text is None else text, 1
        if damage:
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            times = {0: 0, 3: 2}.get(k, 1)
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            role = "user" if k == 4 else role
        of += [(turn, role, text)] * times
    out = []
    for conv, of in groups.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, what = [t for t, _, _ in of if t is not None], faults([r[1:] for r in of])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(of, of[1:], strict=False))
        cost, audit, lines = cheapest([r[1:] for r in of])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(what.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, damage=False):
    df = frame(spark, rows)
    return sorted(map(tuple, cr.repair_reports(cr.damaged(df) if damage else df).collect()), key=repr)


def conversations(seed, n=60, most=5):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "assistant2"]
    texts = ["Fine.", "No end", "", " \n", None, "Good!\n", "Why?", "Fine.", "é. x", "a"]
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), role, rng.choice(texts) if rng.random() < 0.5 else f"Turn {turn}."))
    return rows


@pytest.mark.parametrize("damage", [False, True])
def test_against_brute_force(spark, damage):
    rows = conversations(1) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (7, 0, "user", "Turn 0."), (7, 0, "user", "Turn 0.")]
    assert run(spark, rows, damage) == brute(rows, damage)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_long_conversations_in_blocks(spark, monkeypatch, size):
    """With tiny blocks every conversation is cut; the derivations are the same."""
    rows = conversations(2, 40, 7)
    want = run(spark, rows, True)
    monkeypatch.setattr(cr, "BLOCK", size)
    assert run(spark, rows, True) == want


def test_one_very_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(5000)] + [(1, 6000 + t, "user", "Again.") for t in range(300)] + [(2, 0, "system", "Be short.")]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[1][1:7] == (1000, 0, 299, 0, 299, 600) and got[1][7] == "K" * 5000 + "D" * 300
    assert got[1][8] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows[:5000]).encode()).hexdigest()
    assert got[2][6:8] == (2, "D")


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Yes."), (2, 0, "user", "cut")]
    got = sorted(map(tuple, cr.repaired_turns(frame(spark, rows)).collect()))
    assert got == [(1, 0, "K", "system", "Be kind."), (1, 1, "R", "user", "Hello."), (1, 2, "K", "assistant", "Yes.")]


def test_agenda_pops_in_order_of_weight():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["ok.", "cut", f"{i}."]), 1) for i in range(rng.randint(0, 6))]
        fresh = [r[:2] not in [q[:2] for q in rows[:i]] for i, r in enumerate(rows)]
        steps, _ = cr.steps_of(rows, fresh)
        assert cr.lightest(steps, cr.ENDS)[cr.START] == cr.lightest(steps, cr.ENDS, None)[cr.START]


def test_blocks_join_up():
    """The best of all ways through two halves is the best of the whole."""
    rng = random.Random(4)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", "cut", "", f"{i}."]), 1) for i in range(8)]
        steps, _ = cr.steps_of(rows, [True] * 8)
        at = rng.randrange(9)
        left = {t: cr.lightest(steps[:at], [t], None)[cr.START] for t in range(4) if cr.START in cr.lightest(steps[:at], [t], None)}
        right = cr.lightest(steps[at:], cr.ENDS, None)
        joined = min((c + right[t][0], a + right[t][1]) for t, (c, a) in left.items() if t in right)
        assert joined == cr.lightest(steps, cr.ENDS)[cr.START]


def test_empty_and_dropped(spark):
    assert run(spark, []) == []
    dropped = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "Hi.")], True) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y " * 1_000_000 + "!")]
    assert run(spark, rows)[0][6:8] == (0, "KK")
