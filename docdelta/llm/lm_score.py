"""Scoring texts by online logistic context mixing.

Tokens are words in lower case and one end for each document. A frequent token is coded by the bits
of its Huffman code, any other by those of an escape and then by its share of the rare tokens. Each
bit is predicted in its place of the code tree under three contexts: none, the token before, and the
two before; words without a code of their own are contexts by their hash. Without context the counts
of zeros and ones follow from the tokens' counts; a longer context's predictor is a pair of counts in
a hashed table whose slots follow the number of training tokens.

What the predictors say is mixed in the logistic domain, by weights that the gate (how much the two
longer contexts have seen) selects. Learning is online: a task goes through its documents in batches
of bits, predicts each batch from what it has counted so far, takes a step of its weights against the
error, adds to a refinement table how often the bit came true at each level of the mixed prediction,
and only then counts the batch. The tasks' tables are added up FAN_IN at a time, their weights
averaged by bits. Scoring goes on learning: within a document the weights take a step after every
BLOCK_BITS bits, so each bit's probability comes from earlier bits alone.

Three passes go over the texts: token counts (a shuffle that grows with the input), learning (a table
from each task), and scores. The most frequent tokens go to the tasks in a list of fixed length; counts
of all others are joined to the documents that hold them.

Null and empty texts are one end. Rows with equal ids are separate rows; a null id belongs to the
training part. Without training documents every bit has probability 0.5. An empty table gives no
rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm.common import crc_mod, id_and_text, slices, stored, table

#: Tokens with codes of their own; tokens whose counts every task has.
CODED, LISTED = 1 << 16, 1 << 16
#: A context's table has a slot for every TOKENS_A_SLOT training tokens, in powers of two between these (log2).
TOKENS_A_SLOT, LEAST_BITS, MOST_BITS = 2, 12, 21
END = b""
#: A predictor's logit, in LEVELS steps of STEP; ranges of its count.
LEVELS, STEP, SEEN = 32, 0.45, (1, 3, 10)
GATES = (len(SEEN) + 1) ** 2
_TRUE = np.ones(1, bool)
INPUTS = 4
#: Levels of the mixed prediction in the refinement table, and how many bits of its own outweigh the mix.
REFINED, TRUST = 48, 40.0
BATCH_BITS, BLOCK_BITS = 1 << 16, 1024
#: Curvature that a step reckons with besides what its bits show.
CAUTION = 200.0
RATE, RATE_WITHIN = 0.3, 0.1
PARTS, FAN_IN = 32, 16
#: Bytes of text whose bits are held at once, if no single text is longer: some 50 MB.
PIECE = 300_000
LOW = np.uint64(2**32 - 1)


# ---- codes


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length) of each symbol's code, and (node, bit) at each place. Two symbols at least."""
    n = len(counts)
    heap = [(c + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit, nxt = {}, {}, n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], bit[i], parent[j], bit[j] = nxt, 0, nxt, 1
        heapq.heappush(heap, (a + b, nxt))
        nxt += 1
    nodes, bits, start, length = [], [], [], []
    for i in range(n):
        path = []
        while i in parent:
            path.append((parent[i] - n, bit[i]))
            i = parent[i]
        start.append(len(nodes))
        length.append(len(path))
        nodes += [p for p, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    return np.array(start, np.int64), np.array(length, np.int64), np.array(nodes, np.uint32), np.array(bits, np.uint8)


class Codes:
    """The listed tokens in order of their counts, END first, and the code of the first CODED of them."""

    def __init__(self, listed: list[tuple[bytes, int]], total: int):
        self.ids = {t: i for i, (t, _) in enumerate(listed)}
        self.counts = np.array([c for _, c in listed], np.int64)
        self.escape = min(CODED, len(listed))
        self.slot_bits = min(max((total // TOKENS_A_SLOT).bit_length(), LEAST_BITS), MOST_BITS)
        of = [*self.counts[: self.escape].tolist(), total - int(self.counts[: self.escape].sum())]
        self.start, self.length, self.nodes, self.bits = huffman(of)
        #: Zeros and ones at each node, from the tokens' counts: what the predictor without context has seen.
        self.plain = np.bincount(self.nodes.astype(np.int64) * 2 + self.bits, np.repeat(of, self.length), 2 * len(of)).reshape(-1, 2)

    def tokens(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """Places in the list, -1 for tokens that aren't in it; and the words."""
        words = (text or "").encode().lower().split()
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        return np.append(ids, 0), words

    def events(self, found: list[tuple[np.ndarray, list[bytes]]]) -> tuple[np.ndarray, ...]:
        """For each bit of the documents' codes: its token's number, node, bit, and the two hashed slots."""
        n = [len(x) for x, _ in found]
        every = np.concatenate([x for x, _ in found])
        code = np.where((every < 0) | (every >= self.escape), self.escape, every)
        # As a context a word without a code is its hash, past all codes.
        named = code + 3
        far = np.flatnonzero(every < 0)
        starts = np.repeat(np.cumsum([0, *n[:-1]]), n)
        doc = np.repeat(np.arange(len(n)), n)
        named[far] = [xxhash.xxh32_intdigest(found[d][1][at]) | 1 << 31 for d, at in zip(doc[far].tolist(), (far - starts[far]).tolist(), strict=True)]
        first = np.zeros(len(code), bool)
        ends = np.cumsum(n)
        first[0] = True
        first[ends[:-1]] = True
        before = np.where(first, 1, np.concatenate([[0], named[:-1]]))
        second = np.where(first, 2, np.concatenate([[0], before[:-1]]))
        h1 = (before + 1).astype(np.uint32) * np.uint32(0x9E3779B1)
        h2 = (h1 ^ (h1 >> np.uint32(15))) * np.uint32(0x85EBCA77) + (second + 1).astype(np.uint32) * np.uint32(0xC2B2AE3D)
        length = self.length.take(code)
        token = np.repeat(np.arange(len(code), dtype=np.int32), length)
        at = np.repeat(self.start.take(code) - (np.cumsum(length) - length), length)
        at += np.arange(len(token))
        node, bit = self.nodes.take(at), self.bits.take(at)
        mixed = node * np.uint32(0x27D4EB2F)

        def slots(h: np.ndarray, last: int) -> np.ndarray:
            s = h.take(token)
            s ^= mixed
            s *= np.uint32(0x165667B1)
            s ^= s >> np.uint32(13)
            s *= np.uint32(last)
            s >>= np.uint32(32 - self.slot_bits)
            return s

        return token, node, bit, slots(h1, 0x2C1B3C6D), slots(h2, 0x297A2D39)


# ---- predictors, mixing


def level(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Quantised logit of a pair of counts."""
    return np.clip(np.floor(np.log((n1 + 0.3) / (n0 + 0.3)) / STEP + LEVELS / 2), 0, LEVELS - 1).astype(np.uint8)


def state(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = n0 + n1
    seen = sum((n >= least).view(np.uint8) for least in SEEN)
    return seen * np.uint8(LEVELS) + level(n0, n1)


#: The logit that a state stands for; its range of the count is state // LEVELS.
_LOGIT = ((np.arange((len(SEEN) + 1) * LEVELS) % LEVELS + 0.5 - LEVELS / 2) * STEP).astype(np.float32)
#: States of all pairs of counts under 256, ones times 256 and zeros; the bits of a pair that are set if it is none of them.
_SMALL = state(np.tile(np.arange(256, dtype=np.float32), 256), np.repeat(np.arange(256, dtype=np.float32), 256))
_LARGE, _BOTH = np.uint64(0xFFFFFF00_FFFFFF00), np.uint64(0xFFFF)


def state_of(pairs: np.ndarray) -> np.ndarray:
    """state of pairs of counts in one number each, zeros low, ones high: looked up where they are small, as most are."""
    out = _SMALL.take((pairs >> np.uint64(24) | pairs) & _BOTH, mode="clip")
    far = np.flatnonzero(pairs & _LARGE)
    some = pairs.take(far)
    out[far] = state((some & LOW).astype(np.float32), (some >> np.uint64(32)).astype(np.float32))
    return out


def inputs(s0: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the mixer reads, (INPUTS, bits), and the gate."""
    x = np.empty((INPUTS, len(s0)), np.float32)
    for i, s in enumerate((s0, s1, s2)):
        _LOGIT.take(s, out=x[i], mode="clip")
    x[3] = 0.3
    return x, (s1 // np.uint8(LEVELS) * np.uint8(len(SEEN) + 1) + s2 // np.uint8(LEVELS)).astype(np.intp)


def dot(weights: np.ndarray, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each bit's row of weights (n, INPUTS) times its inputs, column by column."""
    by_input = np.ascontiguousarray(weights.T)
    z = by_input[0].take(rows)
    z *= x[0]
    for i in range(1, INPUTS):
        w = by_input[i].take(rows)
        w *= x[i]
        z += w
    return z


def slopes(rows: np.ndarray, error: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """The sums of error times input by row, (size, INPUTS)."""
    return np.stack([np.bincount(rows, error * x[i], size) for i in range(INPUTS)], axis=1)


def squash(z: np.ndarray) -> np.ndarray:
    p = np.clip(z, -12, 12)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1
    return np.divide(1, p, out=p)


def refined_cell(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
    cell = np.clip(z * 2 + REFINED / 2, 0, REFINED - 1).astype(np.intp)
    cell += gate * REFINED
    return cell


def refine(p: np.ndarray, cell: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """p of a one, drawn toward what came true in its cell: ones and all bits seen there with TRUST bits for p."""
    return np.clip((ones.take(cell) + np.float32(TRUST) * p) / weight.take(cell), np.float32(1e-5), np.float32(1 - 1e-5))


def first_weights() -> np.ndarray:
    return np.tile(np.array([0.8, 0.2, 0.2, 0.0]), (GATES, 1))


class Learner:
    """One task's tables and weights."""

    def __init__(self, codes: Codes):
        self.s0 = level(codes.plain[:, 0], codes.plain[:, 1])
        self.pairs = [np.zeros(1 << codes.slot_bits, np.uint64) for _ in range(2)]  # zeros low, ones high
        self.weights = first_weights()
        self.seen, self.bits = np.zeros((GATES * REFINED, 2), np.int64), 0

    def learn(self, events: tuple[np.ndarray, ...]) -> None:
        """Predict, correct, refine, then count, a batch of bits at a time."""
        _, node, bit, s1, s2 = events
        for a in range(0, len(bit), BATCH_BITS):
            b, places = bit[a : a + BATCH_BITS], [s[a : a + BATCH_BITS].astype(np.intp) for s in (s1, s2)]
            pairs = [t.take(q) for t, q in zip(self.pairs, places, strict=True)]
            x, gate = inputs(self.s0.take(node[a : a + BATCH_BITS]), *map(state_of, pairs))
            z = dot(self.weights.astype(np.float32), gate, x)
            p = squash(z)
            # A step along each weight by its own curvature, as every eighth bit shows it.
            error, some = b.astype(np.float32) - p, slice(None, None, 8)
            slope = slopes(gate, error, x, GATES)
            bend = 8 * np.stack([np.bincount(gate[some], (p * (1 - p))[some] * x[i, some] ** 2, GATES) for i in range(INPUTS)], axis=1)
            self.weights += RATE * slope / (bend + CAUTION)
            self.seen += np.bincount(refined_cell(z, gate) * 2 + b, minlength=2 * len(self.seen)).reshape(-1, 2)
            self.bits += len(b)
            one = np.uint64(1) << (b.astype(np.uint64) * np.uint64(32))
            for t, q in zip(self.pairs, places, strict=True):
                np.add.at(t, q, one)

    @property
    def counts(self) -> list[np.ndarray]:
        return [t.view(np.uint32) for t in self.pairs]


class Model:
    """What scoring needs: states of the predictors, weights, and the refinement table."""

    def __init__(self, plain: np.ndarray, counts: list[np.ndarray], weights: np.ndarray, seen: np.ndarray):
        self.s0 = level(plain[:, 0], plain[:, 1])
        self.s1, self.s2 = (state(c[:, 0], c[:, 1]) for c in (x.reshape(-1, 2).astype(np.float32) for x in counts))
        self.weights = weights.astype(np.float32)
        self.ones, self.weight = seen[:, 1].astype(np.float32), (seen.sum(axis=1) + TRUST).astype(np.float32)

    def log10(self, events: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
        """log10 of each bit's probability; doc: the number of each bit's document, ascending."""
        n = np.bincount(doc)
        block = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) // BLOCK_BITS
        order = np.argsort(block.astype(np.uint16) if block.max(initial=0) < 1 << 16 else block, kind="stable")
        _, node, bit, s1, s2 = events
        s0, s1, s2 = (of.take(v).take(order) for of, v in ((self.s0, node), (self.s1, s1), (self.s2, s2)))
        bit, doc = bit.take(order), doc.astype(np.int32).take(order)
        ends = np.cumsum(np.bincount(block)).tolist()
        weights = np.repeat(self.weights[None], len(n), axis=0)
        logs = np.empty(len(doc))
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            x, gate = inputs(*(s[a:b] for s in (s0, s1, s2)))
            # The documents that still go on, numbered anew.
            of = doc[a:b]
            starts = np.flatnonzero(np.concatenate([_TRUE, of[1:] != of[:-1]]))
            some = of[starts]
            key = np.repeat(np.arange(0, len(some) * GATES, GATES), np.diff(starts, append=b - a)) + gate
            own = weights[some]
            z = dot(own.reshape(-1, INPUTS), key, x)
            p = squash(z)
            q = refine(p, refined_cell(z, gate), self.ones, self.weight)
            logs[a:b] = np.log(np.where(bit[a:b], q, np.float32(1) - q))
            error, size = bit[a:b].astype(np.float32) - p, len(some) * GATES
            step = slopes(key, error, x, size)
            weights[some] = own + (RATE_WITHIN / np.sqrt(BLOCK_BITS) * step).reshape(own.shape)
        out = np.empty(len(doc))
        out[order] = logs * (1 / np.log(10))
        return out


# ---- Spark


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all rows; END once for each. Counts of a few batches are added up before they are shuffled."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update((text or "").encode().lower().split())
                counts[END] += 1
                if len(counts) > 500_000:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return docs.select("text").mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


TABLE = "part int, source bigint, bits bigint, packed binary, extra binary"


def learned(train: DataFrame, codes) -> Model:
    """The model from all training documents; codes: broadcast. Each task sends its tables in PARTS slices."""
    slots = 1 << codes.value.slot_bits

    def run(batches):
        learner = Learner(codes.value)
        for batch in batches:
            for piece in slices(batch, most=PIECE):
                learner.learn(codes.value.events([codes.value.tokens(t) for t in piece.column("text").to_pylist()]))
        if not learner.bits:
            return
        counts = np.concatenate(learner.counts)
        extra = np.concatenate([(learner.weights * learner.bits).reshape(-1), learner.seen.reshape(-1).astype(float)]).tobytes()
        source = TaskContext.get().partitionId()
        for part, piece in enumerate(np.array_split(counts, PARTS)):
            row = (part, source, learner.bits, zstandard.ZstdCompressor(level=1).compress(piece.astype(np.int64 if piece.max(initial=0) > 2**31 else np.uint32).tobytes()), extra if part == 0 else None)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "source", "bits", "packed", "extra"])

    sizes = [len(x) for x in np.array_split(np.zeros(4 * slots, np.uint8), PARTS)]

    def numbers(part: int, packed: bytes) -> np.ndarray:
        data = zstandard.ZstdDecompressor().decompress(packed)
        return np.frombuffer(data, np.int64 if len(data) == 8 * sizes[part] else np.uint32)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        total = np.zeros(sizes[part], np.int64)
        for x in pdf["packed"]:
            total += numbers(part, x)
        extra = sum(np.frombuffer(x, np.float64) for x in pdf["extra"]).tobytes() if part == 0 else None
        packed = zstandard.ZstdCompressor(level=1).compress(total.astype(np.int64 if total.max(initial=0) > 2**31 else np.uint32).tobytes())
        return pd.DataFrame({"part": pd.array([part], "int32"), "source": [int(pdf["source"].iloc[0]) // FAN_IN], "bits": [int(pdf["bits"].sum())], "packed": [packed], "extra": [extra]})

    tables = stored(train.select("text").mapInArrow(run, TABLE), "lm-tables")
    last = tables.agg(F.max("source")).first()[0]
    while last:  # until one table is left of each part; a group holds FAN_IN slices
        tables = stored(tables.groupBy("part", F.floor(F.col("source") / FAN_IN).alias("next")).applyInPandas(add, TABLE), "lm-tables")
        last //= FAN_IN
    counts, extra, bits = np.zeros(0, np.int64), None, 0
    for r in tables.orderBy("part").collect():  # PARTS rows, whatever the input
        counts = np.concatenate([counts, numbers(r.part, bytes(r.packed))])
        if r.part == 0:
            extra, bits = np.frombuffer(bytes(r.extra), np.float64), r.bits
    if extra is None:
        return Model(codes.value.plain, [np.zeros(2 * slots)] * 2, first_weights(), np.zeros((GATES * REFINED, 2)))
    n = GATES * INPUTS
    return Model(codes.value.plain, [counts[: 2 * slots], counts[2 * slots :]], (extra[:n] / bits).reshape(GATES, INPUTS), extra[n:].reshape(-1, 2))


SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_listed", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rest", pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())])))])
SCORED_DDL = "doc_id bigint, n_tokens bigint, n_bytes bigint, n_listed bigint, base double, model double, rest array<struct<token: binary, n: bigint>>"


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False))
    train = rows.where(~held_out)
    counts = stored(token_counts(train), "token-counts")
    total, kinds = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    # A list of fixed length, to the driver and to every task.
    top = counts.where(F.col("token") != F.lit(END)).orderBy(F.desc("n"), "token").limit(LISTED - 1).toArrow()
    ends = counts.where(F.col("token") == F.lit(END)).first()
    listed = [(END, ends.n if ends else 0), *zip(top.column("token").to_pylist(), top.column("n").to_pylist(), strict=True)]
    codes = spark.sparkContext.broadcast(Codes(listed, total))
    model = spark.sparkContext.broadcast(learned(train, codes))
    smooth = float(total + kinds + 1)
    coded = codes.value.escape
    rare = float(total - int(codes.value.counts[:coded].sum()) + max(kinds - coded, 0) + 1)

    def run(batches):
        c, m = codes.value, model.value
        base_of = np.append(np.log10((c.counts + 1) / smooth), 0.0)
        rare_of = np.append(np.where(np.arange(len(c.counts)) < coded, 0.0, np.log10((c.counts + 1) / rare)), 0.0)
        known_of = np.append(c.counts > 0, False)
        for batch in batches:
            for piece in slices(batch, most=PIECE):
                found = [c.tokens(t) for t in piece.column("text").to_pylist()]
                events = c.events(found)
                token = events[0]
                doc = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])[token]
                bits = m.log10(events, doc)
                of_token = np.bincount(token, bits, sum(len(x) for x, _ in found))
                starts = np.cumsum([0, *(len(x) for x, _ in found)])
                out: dict[str, list] = {f.name: [] for f in SCORED}
                out["doc_id"] = piece.column("doc_id")
                rest: list[Counter] = []
                for (ids, words), text, a, b in zip(found, piece.column("text").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    out["n_tokens"].append(len(ids))
                    out["n_bytes"].append(len((text or "").encode()))
                    out["n_listed"].append(int(known_of[ids].sum()))
                    out["base"].append(float(base_of[ids].sum()))
                    out["model"].append(float(of_token[a:b].sum() + rare_of[ids].sum()))
                    rest.append(Counter(words[i] for i in np.flatnonzero(ids[:-1] < 0).tolist()))
                flat = pa.StructArray.from_arrays([pa.array([t for c in rest for t in c], pa.binary()), pa.array([n for c in rest for n in c.values()], pa.int64())], names=["token", "n"])
                out["rest"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rest)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in SCORED], schema=SCORED)

    scored = stored(rows.mapInArrow(run, SCORED_DDL).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rest = scored.select("row", F.explode("rest").alias("t")).select("row", "t.token", F.col("t.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rest = rest.join(counts, "token", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((c + 1) / smooth)).alias("more_base"), F.sum(F.col("times") * F.log10((c + 1) / rare)).alias("more_model"))
    zero = F.lit(0.0)
    out = scored.join(rest, "row", "left").select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_listed") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", zero)).alias("score"),
        "n_bytes",
    )
    return out.withColumn("bits_per_byte", F.try_divide(-F.col("score") * F.lit(float(np.log2(10))), F.col("n_bytes"))).drop("n_bytes")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
