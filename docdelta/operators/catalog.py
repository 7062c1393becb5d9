"""The catalogue of documents: hashes, reuse, labels, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_hash(docs: DataFrame, content: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", F.md5(F.col(content).cast("binary")))


def canonical(docs: DataFrame) -> DataFrame:
    """(doc_id, canonical_id, reused): one hash, one document, the first. An aggregate and a join, so a hot hash is split."""
    first = docs.groupBy(F.col("content_hash").alias("first_hash")).agg(F.min("doc_id").alias("canonical_id"))
    same = docs["content_hash"].eqNullSafe(first["first_hash"])  # documents without content are copies of each other
    return docs.join(first, same).select("doc_id", "canonical_id", (F.col("doc_id") != F.col("canonical_id")).alias("reused"))


def lookup(docs: DataFrame, wanted: DataFrame, key: str = "content_hash") -> DataFrame:
    return docs.join(wanted.select(key).distinct(), key, "left_semi")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def readable_size(n: Column) -> Column:
    sized = lambda power, unit: F.concat(F.format_string("%.2f", n / float(1024**power)), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, sized(1, " KB")).when(n < 1024**3, sized(2, " MB")).otherwise(sized(3, " GB"))


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def was_reused(uploaded: Column, now: Column) -> Column:
    return uploaded < now - F.expr("interval 1 minute")


def reject_reason(size: Column, name: Column, page: Column, pages: Column) -> Column:
    """Null for a valid request."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty file").when(extension(name) != "pdf", "not a PDF").when((page < 1) | (page > pages), "no such page")


def counts(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents")).crossJoin(jobs.agg(F.count("*").alias("comparisons")))  # two rows of one


def latest_by(d: DataFrame, key: str, order: str) -> DataFrame:
    return d.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("rn = 1").drop("rn")
