"""Reading uploads; a store of results in versions: writing, reading, compacting and purging them."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.functions.lineage import stored


#: Files of more bytes are read in lines and hashed as a stream; those whose names make readers of lines unpack them are read as one value.
WHOLE = 1 << 27
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|lzo|snappy|zst|zstd|xz|passthrough)$"
#: Bytes of a piece of a large file, about; a longer line is one piece.
PIECE = 1 << 20


def ingest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, content_hash, modified) of files."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    values = reader.format("binaryFile").load(path)
    large, packed = F.col("_metadata.file_size") > WHOLE, F.col("_metadata.file_name").rlike(PACKED)
    whole = values.where(F.col("length") <= WHOLE).unionByName(values.where(large & packed)).withColumn("content_hash", F.md5("content")).drop("content")
    lines = reader.option("lineSep", "\n").text(path).where(large & ~packed)
    listed = values.where(large & ~packed).select("path", "length", "modificationTime", F.col("_metadata.file_path").alias("file"))
    files = whole.unionByName(listed.join(_hashed(lines), "file").drop("file"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content_hash", F.col("modificationTime").alias("modified"))


def _hashed(lines: DataFrame) -> DataFrame:
    """(file, content_hash) of large files, from their lines: tasks put lines together, and one takes a file's pieces in order, so none holds a file."""
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("bytes"))
    pieces = rows.mapInArrow(_pieces, "file string, size bigint, start bigint, n bigint, bytes binary")
    return pieces.repartition("file").sortWithinPartitions("file", "start", "n").mapInArrow(_digests, "file string, content_hash string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that follow each other in a block of a file, put together; each ends with \\n."""
    n = 0
    for batch in batches:
        key = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))
        first, firsts, out, held, size = 0, [], [], [], 0
        for i, line in enumerate(batch.column("bytes").to_pylist()):
            if held and (key[i] != key[first] or size >= PIECE):
                out.append(b"".join(held))
                firsts.append(first)
                first, held, size = i, [], 0
            held += [line, b"\n"]
            size += len(line) + 1
        if held:
            out.append(b"".join(held))
            firsts.append(first)
        rows = batch.take(pa.array(firsts, pa.int64()))
        columns = {c: rows.column(c) for c in ("file", "size", "start")}
        yield pa.RecordBatch.from_pydict(columns | {"n": pa.array(range(n, n + len(out)), pa.int64()), "bytes": pa.array(out, pa.binary())})
        n += len(out)


BOM = b"\xef\xbb\xbf"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file: the MD5 of its pieces, which come in order.

    Readers of lines drop a mark of byte order at the start, and don't say whether the last line was ended; the file's size says both.
    """

    def row(file: str, size: int, plain, marked, total: int, last: bytes) -> pa.RecordBatch:
        lacking = size - total
        if lacking not in (-1, 0, len(BOM) - 1, len(BOM)):
            raise RuntimeError(f"{file} has {size} bytes, but {total} were read")
        md5 = plain if lacking <= 0 else marked
        md5.update(last if lacking in (0, len(BOM)) else last[:-1])
        return pa.RecordBatch.from_pydict({"file": [file], "content_hash": [md5.hexdigest()]})

    held: tuple | None = None
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0] != r["file"]:
                yield row(*held)
                held = None
            file, size, plain, marked, total, last = held or (r["file"], r["size"], hashlib.md5(), hashlib.md5(BOM), 0, b"")
            plain.update(last)
            marked.update(last)
            held = file, size, plain, marked, total + len(r["bytes"]), r["bytes"]
    if held:
        yield row(*held)


#: Rows of a version in one bucket, about.
ROWS = 1_000_000


class ResultStore:
    """Results of comparisons under one folder, replaced comparison by comparison.

    A write appends a version: its rows in `data/version=/buckets=/bucket=`, then a row for each of its comparisons in
    `keys/version=`, which is the commit. The newest version that names a comparison has its rows, so replacing one
    writes its own rows and nothing else. Buckets are hashes of the comparison, as many as the version's
    rows ask for; a comparison's rows of a version are in one file. Versions order by their names: of two writers
    of the same comparison the later stays, whole. Readers never see a version before its commit.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "pair_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # ---- folders

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, part: str) -> bool:
        fs, p = self._folder(f"{self.path}/{part}")
        return fs.exists(p)

    def _remove(self, part: str) -> None:
        fs, p = self._folder(f"{self.path}/{part}")
        fs.delete(p, True)

    def _names(self, part: str) -> list[str]:
        """Values of a folder's partition folders."""
        fs, p = self._folder(f"{self.path}/{part}")
        return sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(p) if "=" in s.getPath().getName()) if fs.exists(p) else []

    # ---- what is there

    def versions(self) -> list[str]:
        """Committed versions, oldest first."""
        return [v for v in self._names("keys") if self._exists(f"keys/version={v}/_SUCCESS")]

    def latest(self) -> DataFrame | None:
        """(key, version) of every comparison that is there; None before the first commit."""
        committed = self.versions()
        if not committed:
            return None
        every = self.spark.read.option("basePath", f"{self.path}/keys").parquet(*(f"{self.path}/keys/version={v}" for v in committed))
        newest = every.groupBy(self.key).agg(F.max_by("gone", F.col("version").cast("string")).alias("gone"), F.max(F.col("version").cast("string")).alias("version"))
        return newest.where("not gone").select(self.key, "version")

    def _bucket(self, buckets) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")

    def read(self, ids: DataFrame | None = None) -> DataFrame:
        """Newest rows of all comparisons or of some; the folders of other buckets and versions are pruned."""
        latest = self.latest()
        if latest is None:
            raise FileNotFoundError(f"no results in {self.path}")
        rows = self.spark.read.parquet(f"{self.path}/data").withColumn("version", F.col("version").cast("string"))
        if ids is not None:
            latest = latest.join(ids.select(self.key).distinct(), self.key, "left_semi")
        sizes = rows.select("version", "buckets").distinct()  # from folder names
        wanted = latest.join(sizes, "version").withColumn("bucket", self._bucket(F.col("buckets")))
        return rows.join(wanted, ["version", "buckets", "bucket", self.key], "left_semi").drop("version", "buckets", "bucket")

    # ---- changes

    def write(self, df: DataFrame, version: str | None = None) -> str:
        """Put the rows of some comparisons in the place of what they had. A version given by the caller is replaced, so a batch may be repeated."""
        version = version or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows = stored(df, "results")
        buckets = 1 << max(0, (rows.count() - 1) // ROWS).bit_length()
        at = f"{self.path}/data/version={version}/buckets={buckets}"
        self._remove(f"keys/version={version}")
        self._remove(f"data/version={version}")
        rows.withColumn("bucket", self._bucket(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(at)
        self._commit(rows.select(self.key).distinct(), version, False)
        return version

    def _commit(self, keys: DataFrame, version: str, gone: bool) -> None:
        keys.select(self.key, F.lit(gone).alias("gone")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/keys/version={version}")

    def compact(self) -> str | None:
        """Newest rows as one version; the older ones go. A reader of that moment may have to read again."""
        old = self.versions()
        if len(old) < 2:
            return None
        new = self.write(self.read())
        for v in old:
            self._remove(f"keys/version={v}")
            self._remove(f"data/version={v}")
        return new

    def purge(self, expired: DataFrame) -> DataFrame:
        """Remove some comparisons' rows, old versions' too, by rewriting the files that hold any: (version, bucket, kept) of each."""
        ids = stored(expired.select(self.key).distinct(), "expired")
        rows = self.spark.read.parquet(f"{self.path}/data").withColumn("version", F.col("version").cast("string"))
        place = ["version", "buckets", "bucket"]
        marked = ids.join(rows.select(*place, self.key).distinct(), self.key).select(*place).distinct()
        survivors = stored(rows.join(marked, place, "left_semi").join(ids, self.key, "left_anti"), "survivors")
        counts = survivors.groupBy(*place).agg(F.count("*").alias("kept"))
        touched = stored(marked.join(counts, place, "left").select(*place, F.coalesce("kept", F.lit(0)).alias("kept")), "touched")
        self._commit(ids, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", True)  # readers see them gone before files change
        kept = survivors.repartition(*place).sortWithinPartitions(*place, self.key)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(f"{self.path}/data")
        for r in touched.where("kept = 0").toLocalIterator():  # folders alone, one at a time
            self._remove(f"data/version={r.version}/buckets={r.buckets}/bucket={r.bucket}")
        return touched.select("version", "bucket", "kept")


def write_results(df: DataFrame, path: str, key: str = "pair_id", version: str | None = None) -> None:
    ResultStore(df.sparkSession, path, key).write(df, version)


def read_results(spark: SparkSession, path: str, ids: DataFrame | None = None, key: str = "pair_id") -> DataFrame:
    return ResultStore(spark, path, key).read(ids)


def results_exist(ids: DataFrame, results: DataFrame, key: str = "pair_id") -> DataFrame:
    return ids.select(key).distinct().join(results.select(key).distinct().withColumn("r", F.lit(True)), key, "left").select(key, F.col("r").isNotNull().alias("exists"))


def latest_report(reports: DataFrame) -> DataFrame:
    return reports.groupBy("pair_id").agg(F.max("path").alias("path"))
