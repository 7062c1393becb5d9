"""Benchmark contamination by a prefix-filtered set join.

A window is a run of consecutive item words (13, or a whole shorter item). The set of its word
shingles must be in a document whole for the window to occur, so one shingle, the rarest by the
number of documents that hold it, is prefix enough: the window joins the documents that hold that
shingle. The shingle's place within the window gives the window's place in the document; it must not
begin before the document or end after it (the positional and length bounds). What remains is
verified word by word.

The benchmark is the query side and goes to the tasks in blocks of a fixed number of windows, each
against all documents; blocks beyond the first cost another pass. Counts of shingles are taken over
all documents and shuffled by shingle.

Null and empty texts and texts without words have no windows and no hits. Items with equal ids count
once in n_items, with all their windows; a null item id is never listed. Rows of documents with
equal ids are separate rows. An empty benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm.common import by_batch, id_and_text, stored, table

WINDOW, SHINGLE = 13, 5
#: Windows of the benchmark in one block: with their words, some 100 MB at most in a task.
BLOCK = 200_000

#: A-Z to lower case; every other byte that is no word character ([^\x00-\x2F\x3A-\x60\x7B-\x7F]) to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def _shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive word numbers; ids of unknown words (-1) spoil theirs, marked 0."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = (ids.astype(np.int64) + 2).view(np.uint64)
    h = np.full(n, 0x51_7C_C1_B7, np.uint64)
    for i in range(k):
        h = (h ^ x[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    h[bad[k:] > bad[: n]] = 0
    return h


class Windows:
    """The windows of a block of the benchmark, by the key that documents must hold."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found[tuple(ids[i : i + size])].add(item)
        self.windows = [(np.array(w, np.int64), sorted(x for x in who if x is not None)) for w, who in found.items()]
        self.shingle = shingle
        self.keys: dict[int, dict[int, list[tuple[int, int]]]] = {}

    def width(self, w: np.ndarray) -> int:
        return min(self.shingle, len(w))

    def widths(self) -> list[int]:
        return sorted({self.width(w) for w, _ in self.windows})

    def all_shingles(self) -> dict[int, np.ndarray]:
        """The different shingles of the windows, sorted, by their width."""
        return {k: np.unique(np.concatenate([_shingles(w, k) for w, _ in self.windows if self.width(w) == k])) for k in self.widths()}

    def order(self, docs_with: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle; of equals, the smaller hash."""
        keys: dict[int, dict[int, list]] = {k: defaultdict(list) for k in self.widths()}
        for number, (w, _) in enumerate(self.windows):
            k = self.width(w)
            _, h, at = min((docs_with.get((k, int(h)), 0), int(h), i) for i, h in enumerate(_shingles(w, k)))
            keys[k][h].append((number, at))
        self.keys = {k: dict(v) for k, v in keys.items()}
        self.sorted_keys = {k: np.array(sorted(v), np.uint64) for k, v in keys.items()}

    def ids(self, text_words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in text_words), np.int64, len(text_words))

    def occurrences(self, text_words: list[bytes]):
        """(start, number of the window) of each occurrence."""
        ids = self.ids(text_words)
        for k, wanted in self.sorted_keys.items():
            h = _shingles(ids, k)
            at = np.flatnonzero(_among(h, wanted))
            for p in at.tolist():
                for number, offset in self.keys[k][int(h[p])]:
                    w, start = self.windows[number][0], p - offset
                    if start >= 0 and start + len(w) <= len(ids) and np.array_equal(ids[start : start + len(w)], w):
                        yield start, number


def _among(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted) or not len(h):
        return np.zeros(len(h), bool)
    return wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h


def _count_shingles(docs: DataFrame, shared) -> DataFrame:
    """(k, h, n): documents that hold each shingle of the block's windows, added up within each task first."""

    def run(batches):
        block = shared.value
        wanted = block.all_shingles()
        counts = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids = block.ids(words(text))
                for k, v in wanted.items():
                    h = _shingles(ids, k)
                    h = h[_among(h, v)]
                    if len(h):
                        counts[k][np.unique(np.searchsorted(v, h))] += 1
        for k, v in wanted.items():
            some = counts[k] > 0
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(some.sum(), k, np.int32)), "h": pa.array(v[some].view(np.int64)), "n": pa.array(counts[k][some])})

    return docs.select("text").mapInArrow(run, "k int, h bigint, n bigint").groupBy("k", "h").agg(F.sum("n").alias("n"))


def _find(shared):
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        block = shared.value
        out: dict[str, list] = {f.name: [] for f in HITS}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = words(text)
            spans, items = [], set()
            for start, number in block.occurrences(found):
                w, who = block.windows[number]
                spans.append((start, start + len(w)))
                items.update(who)
            out["doc_id"].append(doc)
            out["n_words"].append(len(found))
            out["spans"].append([{"a": a, "b": b} for a, b in merged(spans)])
            out["items"].append(sorted(items))
        return out

    return by_batch(run, HITS)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
HITS_DDL = "doc_id bigint, n_words bigint, spans array<struct<a: bigint, b: bigint>>, items array<string>"


def _blocks(benchmark: DataFrame, window: int, shingle: int):
    """The benchmark's windows, BLOCK at a time; rows are streamed, never all held."""
    items, n = [], 0
    for item, text in benchmark.toLocalIterator():
        items.append((item, text))
        n += max(1, len(words(text)) - window + 1)
        if n >= BLOCK:
            yield Windows(items, window, shingle)
            items, n = [], 0
    yield Windows(items, window, shingle)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, spans of hit words (half-open, merged), items (ids, sorted as strings)."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].cast("string").alias("text"))
    parts = []
    for block in _blocks(items, window, shingle):
        counting = spark.sparkContext.broadcast(block)
        block.order({(r.k, r.h % 2**64): r.n for r in _count_shingles(rows, counting).toLocalIterator()} if block.windows else {})
        parts.append(spark.sparkContext.broadcast(block))
    if len(parts) == 1:
        return rows.mapInArrow(_find(parts[0]), HITS_DDL)
    # Rows have no key of their own; the written table gives them one that each block's pass sees alike.
    keyed = stored(rows.withColumn("row", F.monotonically_increasing_id()), "contamination-rows")
    hits = [keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(_find(p), HITS_DDL) for p in parts]
    every = reduce(DataFrame.unionByName, hits)
    every = every.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join(batch: pa.RecordBatch) -> dict[str, list]:
        spans = [[{"a": a, "b": b} for a, b in merged([(s["a"], s["b"]) for s in x])] for x in batch.column("spans").to_pylist()]
        return {"doc_id": batch.column("doc_id").to_pylist(), "n_words": batch.column("n_words").to_pylist(), "spans": spans, "items": batch.column("items").to_pylist()}

    every = every.mapInArrow(by_batch(join, HITS), HITS_DDL).withColumnRenamed("doc_id", "row")
    return every.join(keyed.select("row", "doc_id"), "row").select("doc_id", "n_words", "spans", "items")


def judged(hits: DataFrame, share: int = 20) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated (at least one word in `share` is hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    d = hits.withColumn("n_hit", n_hit)
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


SQL = r"""
with lowered as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
dw as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lowered),
iw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as k
        from (select item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as i from iw where len(w) > 0)),
grams as (select d.doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k
          from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from dw, (select distinct n from win)) d),
occ as (select doc_id, item_id, g.n, i from grams g join win using (n, k)),
hit as (select doc_id, count(distinct i + j) as n_hit from (select distinct doc_id, i, n from occ) o, unnest(generate_series(0, n - 1)) as u(j) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from occ) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw d left join hit using (doc_id) left join its using (doc_id)
"""
