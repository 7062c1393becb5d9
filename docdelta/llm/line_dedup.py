"""Dropping repeated lines by probing a sharded minimal perfect hash.

Every line of enough characters has a key (the line stripped and lower-cased) and the key a 128-bit
hash. The distinct hashes are dealt over shards; each shard has a minimal perfect hash over its own,
which numbers them 0 to n-1 and so needs no keys: at that number stand a 32-bit fingerprint, the
count of documents that hold the line, and the largest of their ids. Documents send the hashes of
their lines, not the lines, to the shards, and get back the ones to drop.

A shard that gets more probes than others (a line in a third of all documents) is copied, and the
probes are dealt over the copies: the sum of a shard's counts is the number of probes it will get.

Null and empty texts are one empty line. Rows with equal ids count as one document and each keeps
its own lines; a null id counts as an id below all others. An empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm.common import NO_ID, SPACES, by_batch, id_and_text, partitions, stored, table

MIN_CHARS, MIN_DOCS = 20, 3
KEYS_A_SHARD = 100_000
#: Bits of a level for each key that is left; levels before the rest is listed as it is.
GAMMA, LEVELS = 1.7, 24


# ---- minimal perfect hash: keys that are alone at their place on a level stay there, others go on


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 ^ (h2 + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) % np.uint64(size)


class PerfectHash:
    """Numbers n different pairs of 64-bit hashes 0 to n-1; any other pair gets some number too."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.bits: list[np.ndarray] = []
        for level in range(LEVELS):
            if not len(h1):
                break
            size = int(len(h1) * GAMMA) + 1
            at = _place(h1, h2, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.bits.append(alone)
            stay = ~alone[at]
            h1, h2 = h1[stay], h2[stay]
        self.rest = {pair: i for i, pair in enumerate(zip(h1.tolist(), h2.tolist(), strict=True))}
        self._count()

    def _count(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum([int(b.sum()) for b in self.bits])]).astype(np.int64)
        self.ranks = [np.cumsum(b) - b for b in self.bits]

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The pairs' numbers; -1 for a pair that is certainly not one of the n."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, bits in enumerate(self.bits):
            at = _place(h1[left], h2[left], level, len(bits))
            here = bits[at]
            out[left[here]] = self.starts[level] + self.ranks[level][at[here]]
            left = left[~here]
        for i in left:
            out[i] = self.starts[-1] + k if (k := self.rest.get((int(h1[i]), int(h2[i])))) is not None else -1
        return out

    def to_bytes(self) -> bytes:
        out = [struct.pack("<I", len(self.bits))]
        for b in self.bits:
            out += [struct.pack("<Q", len(b)), np.packbits(b).tobytes()]
        return b"".join(out + [struct.pack("<QQ", *pair) for pair in self.rest])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        self, at = cls.__new__(cls), 4
        self.bits = []
        for _ in range(struct.unpack_from("<I", data)[0]):
            (n,) = struct.unpack_from("<Q", data, at)
            size = (n + 7) // 8
            self.bits.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 8), count=n).astype(bool))
            at += 8 + size
        self.rest = {pair: i for i, pair in enumerate(struct.iter_unpack("<QQ", data[at:]))}
        self._count()
        return self


# ---- lines




def line_hash(line: str, min_chars: int) -> tuple[int, int] | None:
    """The key's 128-bit hash as two signed integers; None if the key is short."""
    key = line.strip(SPACES)
    if len(key) < min_chars:
        return None
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key.encode().lower()))  # bytes.lower() changes A-Z alone


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, h1, h2): the different keys of each row."""
    schema = pa.schema([("doc", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"doc": [], "h1": [], "h2": []}
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = {line_hash(x, min_chars) for x in (text or "").split("\n")} - {None}
            out["doc"] += [doc] * len(found)
            out["h1"] += [h[0] for h in found]
            out["h2"] += [h[1] for h in found]
        return out

    return docs.mapInArrow(by_batch(run, schema), "doc bigint, h1 bigint, h2 bigint")


# ---- index


def _u64(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(np.uint64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = _u64(pdf["h1"]), _u64(pdf["h2"])
    index = PerfectHash(h1, h2)
    order = np.argsort(index.numbers(h1, h2))
    prints, counts, largest = (h2[order] >> np.uint64(32)).astype("<u4"), pdf["n_docs"].to_numpy("<i8")[order], pdf["largest"].to_numpy("<i8")[order]
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "probes": [int(counts.sum())], "hash": [index.to_bytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "largest": [largest.tobytes()]})


INDEX = "shard bigint, probes bigint, hash binary, prints binary, counts binary, largest binary"


def line_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """The shards' perfect hashes and arrays over all distinct line hashes, and the number of shards."""
    spark = lines.sparkSession
    counts = stored(lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("largest")), "line-counts")
    shards = max(partitions(spark), -(-counts.count() // KEYS_A_SHARD))
    return stored(counts.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(_build, INDEX), "line-index"), shards


def _probe(min_docs: int):
    def run(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(shard):
            return pd.DataFrame({"doc": [], "h1": [], "h2": []}).astype("int64")
        s = shard.iloc[0]
        h1, h2 = _u64(asked["h1"]), _u64(asked["h2"])
        at = PerfectHash.from_bytes(s["hash"]).numbers(h1, h2)
        known = (at >= 0) & (np.frombuffer(s["prints"], "<u4")[at] == (h2 >> np.uint64(32)).astype("<u4"))
        drop = known & (np.frombuffer(s["counts"], "<i8")[at] >= min_docs) & (np.frombuffer(s["largest"], "<i8")[at] != asked["doc"].to_numpy())
        return asked.loc[drop, ["doc", "h1", "h2"]]

    return run


def lines_to_drop(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, h1, h2) of lines that min_docs documents hold, but for the largest of them. docs: (doc, text)."""
    index, shards = line_index(line_hashes(docs, min_chars))
    mean = index.agg(F.avg("probes")).first()[0] or 0.0
    copies = F.ceil(F.col("probes") / F.lit(max(1000.0, 2 * mean))).cast("int")
    index = index.withColumn("copies", F.greatest(copies, F.lit(1)))
    asked = line_hashes(docs, min_chars).withColumn("shard", F.pmod("h1", F.lit(shards))).join(index.select("shard", "copies"), "shard")
    asked = asked.select("shard", F.pmod(F.xxhash64("doc"), "copies").cast("int").alias("copy"), "doc", "h1", "h2")
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return asked.groupBy("shard", "copy").cogroup(index.groupBy("shard", "copy")).applyInPandas(_probe(min_docs), "doc bigint, h1 bigint, h2 bigint")


OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_text."""
    rows = id_and_text(docs, id_col, text_col).withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    drop = lines_to_drop(rows.select("doc", "text"), min_chars, min_docs)
    drop = drop.select("doc", F.struct("h1", "h2").alias("h")).groupBy("doc").agg(F.collect_set("h").alias("drop"))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in OUT}
        for doc, text, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "drop")), strict=True):
            lines = (text or "").split("\n")
            kept = lines
            if gone:
                hashes = {(h["h1"], h["h2"]) for h in gone}
                kept = [x for x in lines if line_hash(x, min_chars) not in hashes]
            for name, value in zip(out, (doc, len(lines), len(lines) - len(kept), "\n".join(kept)), strict=True):
                out[name].append(value)
        return out

    return rows.join(drop, "doc", "left").select("doc_id", "text", "drop").mapInArrow(by_batch(run, OUT), "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, i, a[i] as line,
         translate(trim(a[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, a, unnest(generate_series(1, len(a))) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents))),
held as (select k, max(doc_id) as largest from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3)
select l.doc_id, count(*) as n_lines,
       count(*) filter (where h.k is not null and l.doc_id <> h.largest) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where h.k is null or l.doc_id = h.largest), '')) as kept_sha256
from lines l left join held h on l.k = h.k group by l.doc_id
"""
