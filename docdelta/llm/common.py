"""What the operators of this folder share: scratch tables and input columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.functions.lineage import temporary_folder

#: The six characters [\x20\x09-\x0D]: what separates words, and what bytes.split() splits at.
SPACES = " \t\n\x0b\x0c\r"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null id as a grouping key; below every other id.
NO_ID = -(2**63)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the cluster's shared checkpoint folder.

    spark.checkpoint.dir is read from the session. Only where it is unset (tests, a local session)
    a temporary folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = temporary_folder(spark, "spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage and survives lost executors. zstd suits texts."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that count, as (doc_id long, text string); others, whatever their names, go."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def unsized(df: DataFrame) -> DataFrame:
    """df for a join that sorts both sides: Spark sizes what Python tasks or an explode make many of by the rows that went in, and would broadcast it."""
    return df.hint("merge")


#: Bits of a bitmap of ids, in rows of 32,768: 8 MB, whatever the number of ids.
ID_BITS = 1 << 26


def perhaps_among(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is among ids, and perhaps others: fewer rows for a join that is to come.

    A bitmap of fixed size of the ids' hashes is broadcast. With very many ids it is full and every
    row stays, which the join then settles as it does any other.
    """
    bit = F.pmod(F.xxhash64(F.lit("bitmap"), id_col), F.lit(ID_BITS)).cast("long")
    maps = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    place = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bitmap", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    here = F.getbit(byte, (place % 8).cast("int")) == 1
    return rows.withColumn("bit", bit).withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(maps), "bucket").where(here).select(*rows.columns)


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have the session send batches of at most BATCH_BYTES to Python workers; a smaller setting stays.

    The default of 64 MB is held by the executor and the worker of every running task at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "67108864")).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return a worker's free memory to the machine; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def by_batch(one: Callable[[pa.RecordBatch], dict[str, list] | None], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Make a mapInArrow function of one that turns a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := one(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        batch = out = None
        give_back()

    return run


def slices(batch: pa.RecordBatch, texts: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` bytes of text, a row at least."""
    lengths = pc.binary_length(batch.column(texts)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def by_piece(one: Callable[[pa.RecordBatch], dict[str, list] | None], schema: pa.Schema, most: int = 2_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """by_batch over pieces of about `most` bytes of text, so that a worker holds little more than one of them."""
    run = by_batch(one, schema)
    return lambda batches: run(piece for batch in batches for piece in slices(batch, most=most))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, in batches that are sorted by them; only the run at hand is held."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
