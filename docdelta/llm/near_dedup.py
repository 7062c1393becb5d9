"""Near-duplicate documents by HyperMinHash.

A document is its set of word shingles. Documents of equal sets are one class from the start. A
class has a register for each of 128 hash functions: the least hash value's number of leading zeros
and the ten bits after its first one. Four registers make a band; classes that agree in a band are
candidates. Registers estimate the Jaccard index, corrected for registers that agree by chance;
candidates well under the threshold go, and the others are verified on their full sets.

No list of pairs is made. Each band names as its leader the class that shares most bands with others,
as the copied original of a family does; a leader's cell is every class of the bands it leads, so two
classes that share a band share a cell. A cell is compared where its sets lie, in blocks of bounded
size, and only links that join what is not joined yet leave the block. A cell of one block is done
with that. In larger cells each block also holds the leader, so that most members are joined through
it; those that aren't then meet all blocks of the cell, again block by block.

With 32 bands of 4, a pair at the threshold of 0.8 shares no band with a probability under 1e-7.
The estimate drops a pair only 0.17 under the threshold, near five standard deviations.

Null and empty texts and texts without words have no shingles and are linked with nothing. Rows with
equal ids are separate rows. A null id is never a component's name while there is another; rows of
a component without any id have a null name and are all kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm.common import bounded_batches, by_batch, by_piece, give_back, groups, id_and_text, perhaps_among, slices, stored, table
from docdelta.llm.graph import components

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
SLACK = 0.17
#: A block of a cell: classes, and shingles of them all, on average.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = (np.random.default_rng(20240601).integers(0, 2**63, REGISTERS, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


# ---- sets and registers


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words are one shingle, none are none."""
    words = (text or "").encode().lower().split()  # of bytes: changes A-Z alone, splits at [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least value under each hash function; long sets go in pieces."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _FACTORS).min(axis=0))
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the MANTISSA bits after the first one, in 16 bits."""
    x, zeros = least.copy(), np.zeros(least.shape, np.uint64)
    for s in (32, 16, 8, 4, 2, 1):
        low = x < np.uint64(1 << (64 - s))
        x[low] <<= np.uint64(s)
        zeros[low] += np.uint64(s)
    return (zeros << np.uint64(MANTISSA) | (x >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


def chance_of_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that a register of unrelated sets of a and b shingles agrees.

    The least of n uniform values has density n (1 - x)^(n - 1). With k leading zeros a register
    spans 2^-(MANTISSA + k + 1), so agreement has that times the integral of both densities' product.
    """
    s, total = a + b - 1.0, 0.0
    for k in range(48):
        low, high = 2.0 ** -(k + 1), 2.0**-k
        total = total + 2.0 ** -(MANTISSA + k + 1) * (np.power(1 - low, s) - np.power(1 - high, s))
    return a * b / s * total


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard index from registers (a row for each pair), corrected for agreement by chance."""
    chance = chance_of_equal(na.astype(float), nb.astype(float))
    return ((ra == rb).mean(axis=1) - chance) / (1 - chance)


# ---- blocks

#: Which of some classes may be near one class: registers of them and of it, their sizes and its size, percent.
Close = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def close_by_estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return estimate(ra, rb, na, nb) >= percent / 100 - SLACK


def joins(regs: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray] | None, component: np.ndarray, first: np.ndarray, percent: int, close: Close = close_by_estimate) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join components within a block, and which classes have a likely partner of another component.

    first: which classes are compared with all others of the block; between two others nothing is
    asked. Without sets nothing is verified and no link is made.
    """
    component = component.copy()
    likely = np.zeros(len(sizes), bool)
    links: list[tuple[int, int]] = []
    if sets is not None:
        ends = np.cumsum([len(x) for x in sets])
        shingles, dense = np.unique(np.concatenate(sets), return_inverse=True)
        starts = ends - sizes
        held = np.zeros(len(shingles), bool)
    order = np.flatnonzero(first)
    done = np.zeros(len(sizes), bool)
    for u in order:
        done[u] = True
        some = np.flatnonzero((component != component[u]) & ~done & (100 * np.minimum(sizes, sizes[u]) >= percent * np.maximum(sizes, sizes[u])))
        if not len(some):
            continue
        some = some[close(regs[some], regs[u][None], sizes[some], sizes[u], percent)]
        if not len(some):
            continue
        likely[u] = True
        likely[some] = True
        if sets is None:
            continue
        mine = dense[starts[u] : ends[u]]
        held[mine] = True
        places = np.concatenate([dense[starts[v] : ends[v]] for v in some])
        lengths = sizes[some]
        shared = np.add.reduceat(held[places], np.cumsum(lengths) - lengths, dtype=np.int64)
        held[mine] = False
        for v in some[100 * shared >= percent * (sizes[u] + lengths - shared)]:
            if component[u] != component[v]:
                links.append((int(u), int(v)))
                component[component == component[v]] = component[u]
    return links, likely


# ---- Spark

SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("registers", pa.binary())])


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """Per row: doc_id, n_shingles, node (hash of the whole set, null without shingles), registers."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        sets = [shingle_hashes(t, n) for t in batch.column("text").to_pylist()]
        regs = registers(np.array([least_values(s) for s in sets]).reshape(len(sets), REGISTERS))
        some = [len(s) > 0 for s in sets]
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": [len(s) for s in sets],
            "node": [xxhash.xxh3_128_digest(s.tobytes()) if x else None for s, x in zip(sets, some, strict=True)],
            "registers": [r.tobytes() if x else None for r, x in zip(regs, some, strict=True)],
        }

    return docs.mapInArrow(by_piece(run, SIGNED), "doc_id bigint, n_shingles bigint, node binary, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(band, class): the class's 32 band keys."""
    schema = pa.schema([("band", pa.int64()), ("class", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        regs = np.array([np.frombuffer(r, np.uint16) for r in batch.column("registers").to_pylist()]).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for i in range(ROWS):
            key = (key ^ regs[:, :, i]) * _MIX
            key = key ^ (key >> np.uint64(31))
        return {"band": key.reshape(-1).view(np.int64), "class": np.repeat(batch.column("class").to_numpy(), BANDS)}

    return classes.select("class", "registers").mapInArrow(by_batch(run, schema), "band bigint, class bigint")


def cells(classes: DataFrame, keys: Callable[[DataFrame], DataFrame] = _bands) -> DataFrame:
    """(leader, class, n_shingles, parts): the members of each cell, its leader among them, and its number of blocks."""
    bands = keys(classes)
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(bands.join(shared, "band"), "bands")
    central = members.groupBy("class").agg(F.sum("n").alias("central"))
    leaders = members.join(central, "class").groupBy("band").agg(F.max(F.struct("central", "class"))["class"].alias("leader"))
    found = members.join(leaders, "band").select("leader", "class").distinct().join(classes.select("class", "n_shingles"), "class")
    found = stored(found, "cells")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    return found.join(found.groupBy("leader").agg(parts.alias("parts")), "leader")


SIDE = "cell bigint, a int, b int, class bigint, n_shingles bigint, component bigint, first boolean"


def _part(seed: int, parts: Column) -> Column:
    return F.pmod(F.xxhash64("class", F.lit(seed)), parts).cast("int")


def _each(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def first_blocks(found: DataFrame) -> DataFrame:
    """Blocks of every cell: each member in one of them, the leader in all; all are compared with all."""
    cell = F.col("leader").alias("cell")
    rest = F.col("class").alias("component"), F.lit(True).alias("first")
    leaders = found.where("class = leader").select(cell, _each(F.col("parts")).alias("a"), F.lit(0).alias("b"), "class", "n_shingles", *rest)
    return leaders.unionByName(found.where("class <> leader").select(cell, _part(1, F.col("parts")).alias("a"), F.lit(0).alias("b"), "class", "n_shingles", *rest))


def later_blocks(found: DataFrame, component: DataFrame) -> DataFrame:
    """For cells of several blocks: members that aren't joined with their leader, against all blocks of their cell."""
    name = component.withColumnRenamed("node", "class")
    large = found.where("parts > 1").join(name, "class", "left").withColumn("component", F.coalesce("component", "class"))
    led = large.where("class = leader").select("leader", F.col("component").alias("led"))
    large = stored(large.join(led, "leader"), "large-cells")
    open_ = large.where("component <> led")
    size = open_.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("open_parts"))
    cell = F.col("leader").alias("cell")
    asked = open_.join(size, "leader").select(cell, _part(2, F.col("open_parts")).alias("a"), _each(F.col("parts")).alias("b"), "class", "n_shingles", "component", F.lit(True).alias("first"))
    others = large.join(size, "leader").select(cell, _each(F.col("open_parts")).alias("a"), _part(1, F.col("parts")).alias("b"), "class", "n_shingles", "component", F.lit(False).alias("first"))
    return asked.unionByName(others)


def _arrays(batch: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]


def _registers(batch: pa.Table) -> np.ndarray:
    """A row of registers for each row; an array of arrays where they differ in length."""
    rows = _arrays(batch, "registers", np.uint16)
    if len({len(r) for r in rows}) == 1:
        return np.array(rows)
    out = np.empty(len(rows), object)
    for i, r in enumerate(rows):
        out[i] = r
    return out


def _likely(blocks: DataFrame, classes: DataFrame, percent: int, close: Close) -> DataFrame:
    """The rows of blocks, with registers, that have a likely partner there."""
    df = blocks.join(classes.select("class", "registers"), "class").select("cell", "a", "b", "class", "n_shingles", "component", "first", "registers")

    def run(batches):
        for block in groups(batches, ["cell", "a", "b"]):
            if block.num_rows > 1:
                column = lambda c: block.column(c).to_numpy(zero_copy_only=False)
                _, keep = joins(_registers(block), column("n_shingles"), None, column("component"), column("first"), percent, close)
                yield from block.filter(pa.array(keep)).combine_chunks().to_batches()

    return df.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", F.desc("first")).mapInArrow(run, f"{SIDE}, registers binary")


def _linked(blocks: DataFrame, sets: DataFrame, percent: int, close: Close) -> DataFrame:
    """(a, b): links between the classes of each block that join all of them which links of the block join."""
    df = blocks.join(sets, "class").select("cell", "a", "b", "class", "n_shingles", "component", "first", "registers", "shingles")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for block in groups((x for b in batches for x in slices(b, "shingles", 16_000_000)), ["cell", "a", "b"]):
            # The leader, or what is asked, comes first; classes that stand on both sides count once.
            _, at = np.unique(block.column("class").to_numpy(), return_index=True)
            block = block.take(pa.array(np.sort(at)))
            column = lambda c: block.column(c).to_numpy(zero_copy_only=False)
            found, _ = joins(_registers(block), column("n_shingles"), _arrays(block, "shingles", np.uint64), column("component"), column("first"), percent, close)
            if found:
                pairs = column("class")[np.array(found)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)
        block = None
        give_back()

    order = ["cell", "a", "b", F.desc("first"), F.desc(F.col("class") == F.col("cell"))]
    return df.repartition("cell", "a", "b").sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class, shingles) of the classes wanted: (class, doc_id, node), from the texts of documents with their ids."""
    schema = pa.schema([("class", pa.int64()), ("found", pa.bool_()), ("shingles", pa.binary())])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        every = [shingle_hashes(t, n).tobytes() for t in batch.column("text").to_pylist()]
        return {"class": batch.column("class"), "found": [xxhash.xxh3_128_digest(s) == x for s, x in zip(every, batch.column("node").to_pylist(), strict=True)], "shingles": every}

    # By id, then by the set's own hash: rows with equal ids may hold other texts.
    wanted = stored(wanted, "wanted")
    docs = perhaps_among(docs, wanted, "doc_id")
    full = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.doc_id)).select("class", "node", "text").mapInArrow(by_piece(run, schema), "class bigint, found boolean, shingles binary")
    return full.where("found").select("class", "shingles").dropDuplicates(["class"])


def class_links(classes: DataFrame, docs: DataFrame, n: int, percent: int, keys: Callable[[DataFrame], DataFrame] = _bands, close: Close = close_by_estimate) -> DataFrame:
    """(node, component) of the classes that have links; classes: (class, node, doc_id, n_shingles, registers).

    keys gives (band, class): classes that share a key are candidates. close says which of them to verify.
    """
    found = stored(cells(classes, keys), "cells")

    def links(blocks: DataFrame) -> DataFrame:
        likely = stored(_likely(blocks, classes, percent, close), "likely")
        wanted = classes.join(likely.select("class").distinct(), "class").select("class", "doc_id", "node")
        return stored(_linked(likely, shingle_sets(docs, wanted, n), percent, close), "links")

    every = links(first_blocks(found))
    component = stored(components(every), "components")
    if found.where("parts > 1").limit(1).count():
        every = every.unionByName(links(later_blocks(found, component)))
        component = stored(components(every), "components")
    return component


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    signed = stored(signatures(rows, shingle), "signatures")
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    component = class_links(classes, rows, shingle, percent).withColumnRenamed("node", "class")

    return by_document(signed, classes, component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def by_document(signed: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row signed; component: (class, component) of linked classes."""
    named = classes.select("class", "node", "doc_id").join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = named.join(least, "component").select("node", "component_id", F.lit(True).alias("named"))
    out = signed.select("doc_id", "n_shingles", "node").join(names, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as k
      from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as m from w union select r.doc_id, e.b from r join e on e.a = r.m)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(m) as component_id, w.doc_id = min(m) as kept
from w left join n using (doc_id) join r using (doc_id) group by w.doc_id, n.n
"""
