"""Arriving documents compared with all that came before them.

A corpus is a folder that micro-batches read and extend: `keys/batch=` has, for each digest of a paragraph or text,
the last document that holds it; `lines/batch=` the lines of the documents; results go to a ResultStore. An arriving
document finds its partner by its own digests alone, so a batch reads of the index what its keys ask for and
of the lines those of its partners. Every folder of a batch is written over if the batch is repeated, and
reads end before the batch, so a restart gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docdelta.functions.lineage import stored
from docdelta.operators import matching, text
from docdelta.sources import fixtures
from docdelta.sources.store import ResultStore

#: Every so many batches the index of keys is written whole, and earlier parts are no longer read.
FOLD = 16


class Corpus:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.results = ResultStore(spark, f"{self.path}/results")

    # ---- the index

    def _keys_before(self, batch: int) -> DataFrame | None:
        """(key, doc_id): the last holder of each key before a batch."""
        start = max(0, (batch // FOLD) * FOLD - 1)
        parts = [f"{self.path}/keys/batch={i}" for i in range(start, batch)]
        if not parts:
            return None
        every = self.spark.read.option("basePath", f"{self.path}/keys").parquet(*parts)
        return every.groupBy("key").agg(F.max_by("doc_id", F.struct("batch", "doc_id")).alias("doc_id"))

    def _extend(self, keys: DataFrame, batch: int) -> None:
        last = keys.groupBy("key").agg(F.max("doc_id").alias("doc_id"))
        if batch % FOLD == FOLD - 1 and (before := self._keys_before(batch)) is not None:
            last = last.unionByName(before.join(last, "key", "left_anti"))
        last.write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch}")

    # ---- a batch

    def partners(self, keys: DataFrame, batch: int) -> DataFrame:
        """Pairs of a batch's documents with earlier ones; those of the batch come in order of their ids."""
        links = fixtures.neighbours(keys)
        before = self._keys_before(batch)
        if before is not None:
            first = keys.groupBy("key").agg(F.min("doc_id").alias("compare_id"))
            links = links.unionByName(first.join(before.withColumnRenamed("doc_id", "base_id"), "key").select("key", "base_id", "compare_id"))
        return fixtures.best_before(links)

    def arrive(self, docs: DataFrame, batch: int) -> None:
        """Compare a batch of documents (doc_id, text) and make them part of the corpus."""
        docs = docs.select("doc_id", "text")
        keys = stored(fixtures.sharing_keys(docs), "keys")
        fixtures.lines_on_pages(fixtures.paragraphs(docs)).write.mode("overwrite").parquet(f"{self.path}/lines/batch={batch}")
        self._extend(keys, batch)
        pairs = stored(self.partners(keys, batch), "pairs")
        read = [f"{self.path}/lines/batch={i}" for i in range(batch + 1)]
        every = self.spark.read.option("basePath", f"{self.path}/lines").parquet(*read).drop("batch")
        wanted = pairs.select(F.col("base_id").alias("doc_id")).unionByName(pairs.select(F.col("compare_id").alias("doc_id"))).distinct()
        lines = stored(every.join(wanted, "doc_id", "left_semi"), "lines")
        pages = lines.groupBy("doc_id").agg(F.max("page_no").alias("page_count"))
        found = text.text_differences(text.pair_lines(matching.standard_page_pairs(pairs, pages, lines), pairs, lines))
        self.results.write(found.select("pair_id", "diff_id", "change", "severity"), f"{batch:020d}-batch")

    def follow(self, documents: DataFrame, checkpoint: str) -> StreamingQuery:
        """Have all documents of a stream that are there arrive, and remember how far that was."""
        writer = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.arrive)
        return writer.trigger(availableNow=True).start()
