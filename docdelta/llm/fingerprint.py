"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches.

A document is the set of digests of its paragraph blocks: paragraphs, cut where they are longer than
BLOCK characters. With such cuts an insertion changes the later blocks of its paragraph; with
`units=SENTENCES` it changes the sentence that it touches alone. A sketch has cells in three rows; a
digest goes to one cell of each row, where it counts one and is added by exclusive or, with a check
value. The cells of two versions subtract, and what both hold is gone. A cell left
with one digest shows it, and taking that out of its other cells shows more: peeling recovers the
digests that differ, by side.

The fingerprint is the sketch of smallest size, as text. Likeness comes from subtracting two
fingerprints: the digests recovered and the sizes of the two sets give the shared digests as a part of
all. Where too much differs for peeling to end, larger sketches of both documents take their place.
They have as many parts as the two sets call for, a digest's part follows from its value, and a part
that still can't be peeled is built again with twice the cells until it can: there is no other way out.

Everything here is DataFrame functions: no Python runs on the executors. Texts are shuffled once, by
document; the next document sends its digests and the characters that the edited text takes.

Null and empty texts have no blocks, an empty sketch, and likeness 1 to each other, 0 to others. Rows
with equal ids follow each other by the hash of their texts; equal rows have each other as next. A
null id comes last in descending order. A single row is its own next document. An empty table gives
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docdelta.llm.common import NO_ID, id_and_text, partitions, stored, table

BLOCK = 64
#: Patterns of what is hashed: cuts of paragraphs, or sentences with their marks, themselves cut where very long.
CUTS = f"[^\\n]{{1,{BLOCK}}}"
SENTENCES = "[^\\n.!?。！？]{1,256}[.!?。！？]*|[.!?。！？]+"
#: Cells of a fingerprint's row; of a row of each part of a larger sketch; digests of both sides in a part, on average.
CELLS, PART_CELLS, LOAD = 10, 3, 3
#: Rounds of peeling before a sketch counts as stuck; doublings of a part, more than any part can need.
ROUNDS, DOUBLINGS = 12, 24


def digests(text: Column, units: str = CUTS) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(units), F.lit(0)), lambda b: F.xxhash64(b)))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, however often `use` names it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that later expressions read, where withColumn would have each of them compute it anew."""
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(77))


def _cell(digest: Column, row: int, width: Column) -> Column:
    """The digest's cell in a row; each size of sketch places digests anew."""
    return (F.pmod(F.xxhash64(digest, F.lit(row), width), width) + row * width).cast("int")


def _add(cells: Column, placed: Column, sign: int) -> Column:
    """Cells with every placed digest (n, k, c, at) added sign times."""

    def with_its_own(x: Column, i: Column) -> Column:
        def added(a: Column, s: Column) -> Column:
            return F.struct((a["n"] + sign * s["n"]).alias("n"), a["k"].bitwiseXOR(s["k"]).alias("k"), a["c"].bitwiseXOR(s["c"]).alias("c"))

        return F.aggregate(placed, x, lambda a, s: F.when((s["at0"] == i) | (s["at1"] == i) | (s["at2"] == i), added(a, s)).otherwise(a))

    return F.transform(cells, with_its_own)


def _placed(signed: Column, width: Column) -> Column:
    """Each (sign, digest) with its check value and cells."""
    return F.transform(signed, lambda s: F.struct(s["sign"].alias("n"), s["digest"].alias("k"), _check(s["digest"]).alias("c"), *(_cell(s["digest"], r, width).alias(f"at{r}") for r in range(3))))


def sketch(signed: Column, width: Column | int) -> Column:
    """Cells (n, k, c) of an array of (sign, digest): count, digests and check values by exclusive or."""
    width = F.lit(width)
    empty = F.array_repeat(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c")), (3 * width).cast("int"))
    return _let(_placed(signed, width), lambda placed: _add(empty, placed, 1))


def sketch_of(values: Column, width: Column | int) -> Column:
    return sketch(F.transform(values, lambda d: F.struct(F.lit(1).alias("sign"), d.alias("digest"))), width)


def subtract(cells: Column, others: Column) -> Column:
    return F.zip_with(cells, others, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, width: Column | int) -> Column:
    """(ours, theirs, ok): how many digests the subtracted cells give up by side, and whether nothing is left."""
    width = F.lit(width)
    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<sign: int, digest: bigint>>").alias("found"), F.lit(False).alias("over"))

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"])))
        new = F.array_distinct(F.transform(pure, lambda x: F.struct(x["n"].alias("sign"), x["k"].alias("digest"))))

        def take_out(new: Column) -> Column:
            after = _let(_placed(new, width), lambda placed: _add(state["cells"], placed, -1))
            more = F.struct(after.alias("cells"), F.concat(state["found"], new).alias("found"), F.lit(False).alias("over"))
            return F.when(F.size(new) > 0, more).otherwise(F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("over")))

        return F.when(state["over"], state).otherwise(_let(new, take_out))

    def end(state: Column) -> Column:
        side = lambda n: F.size(F.filter(state["found"], lambda s: s["sign"] == n))
        left = F.exists(state["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
        return F.struct(side(1).alias("ours"), side(-1).alias("theirs"), (~left).alias("ok"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, end)


def grown(signed: Column) -> Column:
    """peel's result for (sign, digest) of both sides, from sketches that double until peeling ends.

    Digests of the other side count minus one, so that a sketch is that of one side less that of the other.
    """
    stuck = F.struct(F.lit(0).alias("ours"), F.lit(0).alias("theirs"), F.lit(False).alias("ok"))

    def attempt(state: Column, i: Column) -> Column:
        peeled = _let(F.pow(F.lit(2), i).cast("int") * PART_CELLS, lambda width: peel(sketch(signed, width), width))
        return F.when(state["ok"], state).otherwise(peeled)

    return F.aggregate(F.sequence(F.lit(0), F.lit(DOUBLINGS)), stuck, attempt)


def _hex(cells: Column) -> Column:
    """A sketch as text: 4, 16 and 16 hex digits for each cell."""
    digits = lambda c, n: F.substring(F.lpad(F.hex(c), 16, "0"), 17 - n, n)
    return F.array_join(F.transform(cells, lambda x: F.concat(digits(x["n"].cast("long"), 4), digits(x["k"], 16), digits(x["c"], 16))), "")


def next_documents(rows: DataFrame) -> DataFrame:
    """(doc, tag, n, ndoc, ntag, copies): for every row the next in descending order; rows: (doc, tag, n).

    Rows are sorted in ranges; the next of a range's last row is the first of the range after it.
    Only the ranges' first rows, one each, come together in one window.
    """
    parts = partitions(rows.sparkSession)
    ranges = rows.repartitionByRange(parts, F.desc("doc"), F.desc("tag")).withColumn("part", F.spark_partition_id())
    ranges = stored(ranges, "document-order")
    heads = ranges.groupBy("part").agg(F.max(F.struct("doc", "tag")).alias("head"))
    over = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    within = Window.partitionBy("part").orderBy(F.desc("doc"), F.desc("tag"))
    linked = ranges.withColumn("next", F.lead(F.struct("doc", "tag")).over(within)).join(heads, "part").withColumn("next", F.coalesce("next", "after"))
    linked = linked.select("doc", "tag", "n", F.col("next.doc").alias("ndoc"), F.col("next.tag").alias("ntag"))
    return stored(linked.groupBy("doc", "tag", "n", "ndoc", "ntag").agg(F.count("*").cast("int").alias("copies")), "next-documents")


def likeness(a: Column, b: Column, ours: Column, theirs: Column) -> Column:
    """Shared digests as a part of all; a, b: sizes of the sets."""
    shared = F.greatest(a - ours, F.lit(0))
    return F.when(a + b == 0, F.lit(1.0)).otherwise(shared.cast("double") / (b + a - shared))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = CUTS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the numbers of digests that differ."""
    rows = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    links = next_documents(rows.select("doc", "tag", F.length("text").alias("n")))
    if links.where("copies > 1 or (doc = ndoc and tag = ntag)").limit(1).count():
        rows = rows.dropDuplicates(["doc", "tag"])
    third = F.floor(F.col("n") / 3).cast("int")

    # What a row's next document sends: its first characters and its digests.
    sent = rows.join(links.select(F.col("ndoc").alias("doc"), F.col("ntag").alias("tag"), F.col("doc").alias("to_doc"), F.col("tag").alias("to_tag"), third.alias("m")), ["doc", "tag"])
    sent = sent.select(F.col("to_doc").alias("doc"), F.col("to_tag").alias("tag"), F.col("doc").alias("from_doc"), F.col("tag").alias("from_tag"), F.substring("text", F.lit(1), F.col("m")).alias("head"), digests(F.col("text"), units).alias("next"))
    pairs = rows.join(links, ["doc", "tag"]).withColumn("m", third).join(sent, ["doc", "tag"]).where("(ndoc ^ from_doc) = 0 and (ntag ^ from_tag) = 0")
    pairs = pairs.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("m")), "head"))
    pairs = pairs.select("doc", "tag", "ndoc", "ntag", "n", "copies", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), F.col("text").alias("own"), F.col("edited_text").alias("edited"), "next")
    pairs = _held(_held(pairs, "own", digests(F.col("own"), units)), "edited", digests(F.col("edited"), units))
    for values in ("own", "edited", "next"):
        pairs = _held(pairs, f"{values}_cells", sketch_of(F.col(values), CELLS))
    for other in ("edited", "next"):
        pairs = _held(pairs, f"by_{other}", peel(subtract(F.col("own_cells"), F.col(f"{other}_cells")), CELLS))

    # One row of facts for each document, and the digests of those sketches that have to be larger.
    size = {c: F.size(c) for c in ("own", "edited", "next")}
    facts = F.struct("n", "copies", "edited_sha256", _hex(F.col("own_cells")).alias("fingerprint"), _hex(F.col("edited_cells")).alias("edited_fingerprint"), *(size[c].alias(f"{c}_size") for c in size), "by_edited", "by_next")
    no_facts = F.when(F.lit(False), facts)
    element = lambda kind, g, sign, digest, f: F.struct(F.lit(kind).alias("kind"), g.cast("long").alias("g"), F.lit(sign).alias("sign"), digest.alias("digest"), f.alias("facts"))

    def side(kind: str, values: str, sign: int) -> Column:
        parts = F.ceil((size["own"] + size[kind]) / LOAD)
        dealt = F.transform(F.col(values), lambda d: element(kind, F.pmod(F.xxhash64(d, F.lit(5)), parts), sign, d, no_facts))
        return F.when(F.col(f"by_{kind}.ok"), F.slice(dealt, 1, 0)).otherwise(dealt)

    every = F.concat(F.array(element("facts", F.lit(0), 0, F.lit(None).cast("long"), facts)), *(side(kind, values, sign) for kind in ("edited", "next") for values, sign in (("own", 1), (kind, -1))))
    key = ["doc", "tag", "ndoc", "ntag"]
    cells = pairs.select(*key, F.explode(every).alias("s")).select(*key, "s.*")
    tables = cells.groupBy(*key, "kind", "g").agg(F.collect_list(F.struct("sign", "digest")).alias("signed"), F.first("facts", True).alias("facts"))
    nothing = F.struct(F.lit(0).alias("ours"), F.lit(0).alias("theirs"), F.lit(True).alias("ok"))
    tables = _held(tables, "r", F.when(F.col("kind") == "facts", nothing).otherwise(grown(F.col("signed"))))

    total = lambda kind, name: F.sum(F.when(F.col("kind") == kind, F.col(f"r.{name}")).otherwise(0))
    out = tables.groupBy(*key).agg(F.first("facts", True).alias("f"), *(total(k, s).alias(f"{k}_{s}") for k in ("edited", "next") for s in ("ours", "theirs")))
    differ = lambda kind, s: F.when(F.col(f"f.by_{kind}.ok"), F.col(f"f.by_{kind}.{s}")).otherwise(F.col(f"{kind}_{s}")).cast("long")
    out = out.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        F.col("f.n").cast("long").alias("n_chars"),
        "f.edited_sha256",
        "f.fingerprint",
        "f.edited_fingerprint",
        *(likeness(F.col("f.own_size"), F.col(f"f.{k}_size"), differ(k, "ours"), differ(k, "theirs")).alias(f"near_{k}") for k in ("edited", "next")),
        differ("edited", "ours").alias("n_only_own"),
        differ("edited", "theirs").alias("n_only_edited"),
        F.col("f.copies").alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
