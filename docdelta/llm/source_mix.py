"""Mixing sources to target weights by fitting each source's budget as a subset sum.

A source's documents are counted by exact size in words. The whole passes that fit in the source's
target are taken of every document. Of what is left, an even share of the documents of each size is
taken first; bounded-knapsack dynamic programming over the counts that remain then chooses how many
more of each size fill the rest of the budget as nearly as they can. Which documents of a size are
taken is settled by a seeded hash of their ids, so reruns agree.

Sizes, not documents, reach the dynamic programming: a source has as many rows there as it has
different sizes. The order of the documents of one size comes from counts by bucket of their hash
and an order within each bucket, so one size of a third of all documents is no large group.

Null texts have size 0, and size 0 takes 0 words. A null source is a source, ordered last. Rows with
equal ids are separate rows. A table without words has targets of 0. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docdelta.llm.common import stored, table

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2, 20240501
#: Buckets of a size's hash order.
BUCKETS = 1024


def words_in(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), a row for each source.

    Sharing the excess again and again by weight ends where every source has level * weight or its
    own bound, the level being the one that spends everything. The sources that stop at their bound
    are those of least bound for their weight, so running sums in that order find the level.
    Windows over all sources read a row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.lit([float(x) for x in weights])
    d = sizes.withColumn("weight", F.element_at(w, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    d = d.withColumn("bound", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("bound") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    d = d.withColumn("budget", share * F.sum("source_size").over(whole))
    d = d.withColumn("level", (F.col("budget") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source whose bound isn't below the level sets it for itself and all after it.
    d = d.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    return d.select("source", "source_size", "weight", F.coalesce(F.least("bound", F.col("level") * F.col("weight")), "bound").alias("target"))


def fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each size to take so that their sum comes as near to budget from below as it can.

    counts: how many there are of each size over 0. Even shares first, leaving a few times the
    largest size open; what rounding leaves beyond that goes to whole documents, largest first;
    bounded-knapsack dynamic programming over bit sets of reachable sums does the rest.
    """
    total = sum(k * n for k, n in counts.items())
    if budget >= total:
        return dict(counts)
    room = 4 * max(counts)
    taken = {k: n * max(0, budget - room) // total for k, n in counts.items()}
    rest = budget - sum(k * n for k, n in taken.items())
    for k in sorted(counts, reverse=True):
        if rest > room and (more := min(counts[k] - taken[k], (rest - room) // k)):
            taken[k] += more
            rest -= more * k
    if rest <= 0:
        return taken
    mask, sums, steps = (1 << rest + 1) - 1, 1, []
    by = np.zeros(rest + 1, np.int32)  # the step that first reached a sum
    for k in sorted(counts):
        n, part = min(counts[k] - taken[k], rest // k), 1
        while n > 0 and not sums >> rest & 1:
            part = min(part, n)
            if new := sums << k * part & mask & ~sums:
                bits = np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8)
                by[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: rest + 1])] = len(steps)
                steps.append((k, part))
                sums |= new
            n, part = n - part, part * 2
        if sums >> rest & 1:
            break
    at = sums.bit_length() - 1
    while at:
        k, part = steps[by[at]]
        taken[k] += part
        at -= k * part
    return taken


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one source, (source, size, n, source_size, target), with `passes` over every document and `extra` documents of each size."""
    target, whole = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    passes = min(int(target // whole), MOST) if whole else 0
    counts = {int(k): int(n) for k, n in zip(pdf["size"], pdf["n"], strict=True) if k > 0}
    extra = fill(counts, round(target - passes * whole)) if whole and passes < MOST else {}
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "passes": passes, "extra": [extra.get(int(k), 0) for k in pdf["size"]]})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies, taken (= size * copies).

    keep_text adds the row's struct of all input columns as `row`.
    """
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), words_in(docs[text_col]).alias("size"))
    if not keep_text:
        rows = stored(rows.select("doc_id", "source", "size"), "mix-sizes")
    rows = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sizes = rows.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sizes.select("source", "source_size")).withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-targets")
    counts = rows.groupBy("source_key", "size").agg(F.count("*").alias("n")).join(goals.select("source_key", "source_size", "target"), "source_key")
    plan = counts.withColumnRenamed("source_key", "source").groupBy("source").applyInPandas(_fit, "source string, size bigint, passes int, extra bigint").withColumnRenamed("source", "source_key")
    plan = stored(plan, "mix-plan")

    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    key = ["source_key", "size", "bucket"]
    before = Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    buckets = buckets.join(plan, ["source_key", "size"]).select(*key, "passes", (F.col("extra") - F.col("before")).alias("room"))
    within = Window.partitionBy(*key).orderBy("h", "doc_id")
    chosen = rows.join(buckets, key).withColumn("copies", F.col("passes") + F.when(F.row_number().over(within) <= F.col("room"), 1).otherwise(0))
    out = chosen.join(goals.select("source_key", "source_size", "target"), "source_key")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies"), (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if keep_text else []))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
