"""Repair of conversations to the shape system? (user assistant)+, or nothing, at the least cost.

A repair is a derivation. Its items are `rest(i, s)`: the rows from i on, once the turns before them have
brought the shape to state s (start, after system, after user, after assistant). Edits are weighted
deductions: from rest(i + 1, t) and an edit of row i that leads from s to t follows rest(i, s); from
rest(i, t) and an inserted turn follows rest(i, s). Knuth's agenda pops the lightest item first; a popped item
is final, and the goal is rest(0, start). A weight is (cost, rows used, audit), where an audit has the initials
of all edits in order: every deduction makes cost or rows used larger, and putting an edit before two audits
keeps their order, so the functions are superior and monotone.

Faults of rows: blank (no character but white space), duplicate (role and text seen before in the
conversation), truncated (last such character no `.`, `!` or `?`). Keep costs 0, Rerole to user or assistant 1,
Delete 2, Insert of an empty turn 5, a truncated row that stays 5 more; blank and duplicate rows must go. Of
repairs of equal cost the one of the least audit in ASCII order is taken.

Conversations of up to BLOCK rows are repaired one by one in sorted partitions. Longer ones, whatever their
size, are cut into blocks wherever their rows lie; each block has the lightest derivations from each state to
each other (two audits of a block with equal cost are never prefixes of each other, so these may be joined
up), and a pass over the blocks picks those of the whole. Only the digest reads such a conversation in one task,
block by block, since SHA-256 can't be split.

Rows go by turn, nulls first; rows of one turn by role and text. Null roles and texts are one space, a null
conv_id is a conversation of its own. Equal rows are kept apart as copies. A conversation without rows has cost 0
and an empty audit. An empty table gives no rows. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm.common import NO_ID, bounded_batches, groups, partitions, slices, stored, table
from docdelta.llm.spelling import CRC_TABLE, crc32_sql

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of a role's initial; what isn't here is illegal.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
#: The role that an edit gives in a state.
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
TURN = {"user": "u", "assistant": "a"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block, and bytes of its texts.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
SPACES = " \t\n\x0b\x0c\r"

Edit = tuple[int, str, int, int]  # cost, initials, state before, state after


# ---- derivations


def fault(text: str) -> str:
    """Of a row whose role and text are new."""
    bare = text.rstrip(SPACES)
    return "blank" if not bare else "" if bare[-1] in ".!?" else "truncated"


def edits(role: str, what: str) -> list[Edit]:
    """Every edit of a row."""
    out = [(DELETE, "D", s, s) for s in range(4)]
    if what in ("", "truncated"):
        more = TRUNCATED if what else 0
        out += [(more, "K", s, t) for (s, initial), t in NEXT.items() if initial == role[:1]]
        out += [(more + REROLE, "R", s, NEXT[s, TURN[r]]) for s, r in ROLE.items()]
    return out


def lightest(steps: list[list[Edit]], ends: Iterable[int], goal: int | None = START) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the lightest derivation of rest(0, s), by s: until that of the goal is final, or all are."""
    n = len(steps)
    agenda = [((0, 0, ""), n, s) for s in ends]
    done: set[tuple[int, int]] = set()
    first: dict[int, tuple[int, str]] = {}
    while agenda:
        (cost, used, audit), i, state = heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == 0:
            first[state] = cost, audit
            if state == goal:
                break
        for s, role in ROLE.items():
            if NEXT[s, TURN[role]] == state:
                heappush(agenda, ((cost + INSERT, used, "I" + audit), i, s))
        if i:
            for more, initials, s, t in steps[i - 1]:
                if t == state:
                    heappush(agenda, ((cost + more, used + 1, initials + audit), i - 1, s))
    return first


def applied(rows: list[tuple[str, str, int]], audit: str, state: int) -> tuple[list[tuple[str, str, str]], int]:
    """((edit, role, text) of every turn that an audit leaves, state after it). rows: role, text, copies."""
    out, at = [], iter([(role, text) for role, text, copies in rows for _ in range(copies)])
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit != "D":
            role = role if edit == "K" else ROLE[state]
            state = NEXT[state, role[:1]]
            out.append((edit, role, text))
    return out, state


def steps_of(rows: list[tuple[str, str, int]], fresh: list[bool]) -> tuple[list[list[Edit]], dict[str, int]]:
    """Edits of each row, copies after the first as one deletion, and the number of rows with each fault."""
    steps, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for (role, text, copies), new in zip(rows, fresh, strict=True):
        what = fault(text)
        alone = new and what != "blank" and copies > 0
        if alone:
            steps.append(edits(role, what))
            if what:
                faults[what] += 1
        rest = copies - alone
        if rest:
            faults["blank" if what == "blank" else "duplicate"] += rest
            steps.append([(DELETE * rest, "D" * rest, s, s) for s in range(4)])
    return steps, faults


# ---- rows


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with no null but in turn; rows of 0 copies name their conversation alone."""
    c = conversations
    copies = c["copies"] if "copies" in c.columns else F.lit(1)
    rows = c.select(F.coalesce(c["conv_id"].cast("long"), F.lit(NO_ID)).alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit(" ")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit(" ")).alias("text"), copies.cast("long").alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _with_fresh(rows: DataFrame) -> DataFrame:
    """Whether the first copy of a row is the conversation's first of its role and text; aggregated, so that no frequent text meets in one task."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.where("copies > 0").groupBy("conv_id", "role", F.md5("text").alias("digest")).agg(F.min(place).alias("first"))
    both = rows.withColumn("digest", F.md5("text")).join(first, ["conv_id", "role", "digest"], "left")
    return both.withColumn("fresh", F.coalesce(place.eqNullSafe(F.col("first")), F.lit(False))).drop("digest", "first")


ORDER = ["conv_id", "part", "block", "turn", "role", "text"]
ROWS = "conv_id bigint, turn bigint, role string, text string, copies bigint, fresh boolean, part int, block int"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted, with the number of their block in this task."""
    part, block, last, held, size = TaskContext.get().partitionId(), 0, None, 0, 0
    for batch in batches:
        numbers = []
        for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if conv != last or held == BLOCK or size > BLOCK_BYTES:
                block, last, held, size = block + 1, conv, 0, 0
            held, size = held + 1, size + len(text)
            numbers.append(block)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int32())], [*batch.schema.names, "part", "block"])


def _block(table_: pa.Table) -> tuple[list[tuple[str, str, int]], list[bool]]:
    role, text, copies = (table_.column(c).to_pylist() for c in ("role", "text", "copies"))
    return list(zip(role, text, copies, strict=True)), table_.column("fresh").to_pylist()


MATRIX = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
MATRIX_SQL = "conv_id bigint, part int, block int, entry int, exit int, cost bigint, audit string"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lightest derivation of each block from each state to each other."""
    for block in groups((x for b in batches for x in slices(b)), ["conv_id", "part", "block"]):
        steps, _ = steps_of(*_block(block))
        key = [block.column(c)[0].as_py() for c in ("conv_id", "part", "block")]
        rows = [(*key, s, t, *weight) for t in range(4) for s, weight in lightest(steps, [t], None).items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MATRIX, strict=True)], schema=MATRIX)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The derivation of each block that is part of its conversation's lightest; of a block only its 16 audits are held at once."""

    def conversation(best: dict[int, tuple]) -> pa.RecordBatch:
        *_, trail = min(best[s] for s in ENDS if s in best)
        out = []
        while trail:
            trail, row = trail
            out.append(row)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), MATRIX, strict=True)], schema=MATRIX)

    last, best = None, {}
    for block in groups(batches, ["conv_id", "part", "block"]):
        rows = list(zip(*(block.column(f.name).to_pylist() for f in MATRIX), strict=True))
        if rows[0][0] != last:
            if best:
                yield conversation(best)
            last, best = rows[0][0], {START: (0, "", ())}
        new: dict[int, tuple] = {}
        for row in rows:
            if row[3] in best:
                cost, audit, trail = best[row[3]]
                weight = cost + row[5], audit + row[6]
                if row[4] not in new or weight < new[row[4]][:2]:
                    new[row[4]] = (*weight, (trail, row))
        best = new
    if best:
        yield conversation(best)


REPORT = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
REPORT_SQL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
REPAIRED_SQL = "conv_id bigint, place bigint, edit string, role string, text string"


class _Conversation:
    """What is known of a conversation while its blocks go by."""

    def __init__(self, conv_id: int):
        self.conv_id, self.state, self.cost, self.audit, self.illegal, self.last, self.place = conv_id, START, 0, [], 0, None, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.turn = None
        self.turns, self.hash = 0, hashlib.sha256()

    def block(self, rows: list, fresh: list, turns: list, cost: int | None, audit: str | None) -> list[tuple]:
        """The repaired turns of the next block; its derivation is given, or found here where it is the only one."""
        steps, faults = steps_of(rows, fresh)
        if audit is None:
            cost, audit = lightest(steps, ENDS)[START]
        self.cost += cost
        self.audit.append(audit)
        for k, n in faults.items():
            self.faults[k] += n
        for (role, _, copies), turn in zip(rows, turns, strict=True):
            if copies:
                self.illegal += copies - 1 + (self.last is not None and self.last + role[:1] not in LEGAL)
                self.last = role[:1]
                if turn is not None:
                    self.turns += turn != self.turn
                    self.low = turn if self.low is None else self.low
                    self.high = self.turn = turn
        out, self.state = applied(rows, audit, self.state)
        for _, role, text in out:
            self.hash.update(("\n" * (self.place > 0) + f"{role}:{text}").encode())
            self.place += 1
        return [(self.conv_id, self.place - len(out) + i, *turn) for i, turn in enumerate(out)]

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _pass(turns: bool, given: bool):
    """A mapInArrow function over sorted rows: the repaired turns of conversations, or a report of each."""
    schema = REPAIRED if turns else REPORT

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for block in groups((x for b in batches for x in slices(b)), ["conv_id", "part", "block"]):
            conv_id = block.column("conv_id")[0].as_py()
            if at is None or conv_id != at.conv_id:
                if at is not None and not turns:
                    held.append(at.report())
                at = _Conversation(conv_id)
            way = [block.column(c)[0].as_py() for c in ("cost", "audit")] if given else [None, None]
            repaired = at.block(*_block(block), block.column("turn").to_pylist(), *way)
            held += repaired if turns else []
            if len(held) > 1000:
                yield out(held)
                held = []
        if at is not None and not turns:
            held.append(at.report())
        if held:
            yield out(held)

    return run


def _repair(conversations: DataFrame, turns: bool) -> DataFrame:
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows = stored(_with_fresh(_turns(conversations)), "turns")
    schema = REPAIRED_SQL if turns else REPORT_SQL
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    large = stored(sizes.where((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("conv_id"), "long-conversations")
    one = F.lit(0).alias("part"), F.lit(0).alias("block")
    short = rows.join(large, "conv_id", "left_anti").select("*", *one)
    out = short.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_pass(turns, False), schema)
    if large.limit(1).count():
        long = rows.join(large, "conv_id", "left_semi")
        dealt = long.repartitionByRange(partitions(spark), "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
        blocks = stored(dealt.select("conv_id", "turn", "role", "text", "copies", "fresh").mapInArrow(_numbered, ROWS), "blocks")
        key = ["conv_id", "part", "block"]
        matrices = blocks.repartition(*key).sortWithinPartitions(*ORDER).mapInArrow(_matrices, MATRIX_SQL)
        chosen = stored(matrices.repartition("conv_id").sortWithinPartitions(*key).mapInArrow(_chosen, MATRIX_SQL), "chosen")
        ways = blocks.join(chosen.select(*key, "cost", "audit"), key)
        out = out.unionByName(ways.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_pass(turns, True), schema))
    return out.withColumn("conv_id", F.when(F.col("conv_id") != NO_ID, F.col("conv_id")))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every repaired conversation, places from 0."""
    return _repair(conversations, True)


def repair_reports(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps in its turns, rows by fault, illegal neighbours, cost and audit of the repair, SHA-256 of its `role:text` lines.

    conversations: conv_id, turn, role, text, and perhaps copies (of a row; 0: it isn't there).
    """
    return _repair(conversations, False)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn: dropped (as 0 copies), emptied, cut, repeated, given the user's role."""
    c = conversations
    name = lambda col: F.coalesce(c[col].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(kind == 4, "user").otherwise(name("role"))
    return c.select(c["conv_id"], c["turn"], role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_reports(damaged(table(spark, sf_dir, "conversations")))


_SPACE = r"[\x20\x09-\x0D]"


def _more(weight: str, cost: int | str, edit: str) -> str:
    """A weight, the cost in nine digits and then the audit, after one more edit."""
    return f"(lpad(cast(cast({weight}[1:9] as bigint) + {cost} as varchar), 9, '0') || '{edit}' || {weight}[10:])"


def _inserted(weights: list[str]) -> list[str]:
    """Weights by state, where up to one turn may be put in before."""
    return [f"least({w}, {_more(weights[NEXT[s, TURN[ROLE[s]]]], INSERT, 'I')})" for s, w in enumerate(weights)]


def _edited(weights: list[str]) -> list[str]:
    """Weights by state before a row of initial `i`, fault `f`."""
    out = []
    for s, w in enumerate(weights):
        here = [_more(w, DELETE, "D")]
        late = f"case when f = 'truncated' then {TRUNCATED} else 0 end"
        here += [f"case when i = '{i}' and f in ('', 'truncated') then {_more(weights[t], late, 'K')} end" for (p, i), t in NEXT.items() if p == s]
        here += [f"case when f in ('', 'truncated') then {_more(weights[NEXT[s, TURN[ROLE[s]]]], f'{REROLE} + {late}', 'R')} end"]
        out.append(f"least({', '.join(here)})")
    return out


_W = [f"w{s}" for s in range(4)]
_named = lambda exprs: ", ".join(f"{e} as {w}" for e, w in zip(exprs, _W, strict=True))
_CLOSED = f"(select * replace ({_named(_inserted(_W))}) from (select * replace ({_named(_inserted(_W))}) from {{}}))"

SQL = rf"""
with recursive {CRC_TABLE},
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' '))")} % 20 as k from conversations, t),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from c, unnest(case k when 0 then [] when 3 then [1, 2] else [1] end) as u(copy)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p, lag(role[1:1]) over (partition by conv_id order by turn nulls first, role, text) as before from d),
r as (select conv_id, turn, role, text, p, role[1:1] as i, before is not null and before || role[1:1] not in ('su', 'ua', 'au') as illegal,
    case when not regexp_matches(text, '[^ 	-
]') then 'blank' when row_number() over (partition by conv_id, role, text order by p) > 1 then 'duplicate' when regexp_matches(text, '[.!?]{_SPACE}*$') then '' else 'truncated' end as f from o),
n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 'blank') as blank, count(*) filter (f = 'duplicate') as duplicate, count(*) filter (f = 'truncated') as truncated, count(*) filter (illegal) as illegal from r group by conv_id),
best as (select * from {_CLOSED.format("(select conv_id, n as pos, '000000000' as w0, '900000000' as w1, '900000000' as w2, '000000000' as w3 from n)")}
    union all select * from {_CLOSED.format("(select b.conv_id, b.pos - 1 as pos, " + _named(_edited(_W)) + " from best b join r on r.conv_id is not distinct from b.conv_id and r.p = b.pos)")}),
way as (select conv_id, cast(w0[1:9] as bigint) as cost, w0[10:] as audit from best where pos = 0),
told as (select conv_id, audit, 0::bigint as place, 0::bigint as used, {START} as s, [] :: varchar[] as turns from way
    union all select w.conv_id, w.audit, w.place + 1, case when e = 'I' then w.used else w.used + 1 end,
        case when e = 'D' then w.s when e = 'K' and r.i = 's' then {SYSTEM} when w.s = {USER} then {ASSISTANT} else {USER} end,
        case e when 'D' then w.turns when 'K' then list_append(w.turns, r.role || ':' || r.text) else list_append(w.turns, case when w.s = {USER} then 'assistant:' else 'user:' end || case when e = 'I' then '' else r.text end) end
    from (select *, audit[place + 1:place + 1] as e from told where place < length(audit)) w left join r on r.conv_id is not distinct from w.conv_id and r.p = w.used + 1),
done as (select conv_id, sha256(array_to_string(turns, chr(10))) as repaired_sha256 from told where place = length(audit)),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from every e left join n on n.conv_id is not distinct from e.conv_id left join way on way.conv_id is not distinct from e.conv_id left join done on done.conv_id is not distinct from e.conv_id
"""
