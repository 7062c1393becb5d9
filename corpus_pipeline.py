"""From raw documents to token files: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm import decontaminate, near_dedup, quality, source_mix, token_store
from docdelta.llm.common import scratch_path, stored, table

#: Bytes of known words that the classifier's workers keep while later stages run.
CACHED = 4 << 20
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; its labels are those of the folds that it may learn."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), keep_text=True, cache_bytes=CACHED)
    return scored.where("predicted = 1").select("row.*").select(DOCUMENT)


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs and a number `row` for each row, written so that every reader sees the same; ids may repeat or be null."""
    return stored(docs.withColumn("row", F.monotonically_increasing_id()), "keyed-rows", "zstd")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that of smallest id: shingles of five words, similarity 0.8.

    Of rows with that id the first in the table stays; a null id comes after all others. Rows without
    shingles are components of their own.
    """
    keyed = with_row_key(docs)
    component = near_dedup.near_duplicates(keyed, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    kept = component.join(keyed.select("row", "doc_id"), "row").groupBy("component").agg(F.min_by("row", order).alias("row")).select("row")
    return keyed.join(kept, "row", "left_semi").select(DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold too little of the benchmark; each is judged by its own text, whatever its id."""
    keyed = with_row_key(docs)
    hits = decontaminate.judged(decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="row"))
    bad = hits.where("contaminated").select(F.col("doc_id").alias("row"))
    return keyed.join(bad, "row", "left_anti").select(DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = source_mix.mix(docs, keep_text=True).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*").select(DOCUMENT)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document, in the files' order of ids; null and empty texts have the end id alone."""
    return token_store.token_files(docs, keep_words=False)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_store", to_token_files),
]

#: Classifier, sketches, budget fitting and the tokenizer can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
