"""Files of more bytes than one value may have are hashed as streams."""

import gzip
import hashlib
import random

import pytest

from docdelta.sources import store


@pytest.fixture
def small_blocks(spark, monkeypatch):
    monkeypatch.setattr(store, "WHOLE", 100_000)
    monkeypatch.setattr(store, "PIECE", 5_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def contents():
    r = random.Random(3)
    some = r.randbytes(400_000)
    yield from {"a.bin": some, "b end.bin": some[:250_001] + b"\n", "two.bin": some + b"\n\n", "mark.csv": b"\xef\xbb\xbfx,y\r\n" * 40_000, "mark no end.csv": b"\xef\xbb\xbfx,y\r\n" * 30_000 + b"z"}.items()
    yield from {"ends.txt": b"\n" * 120_000, "cr.txt": b"\r\n\r" * 60_000, "one.txt": b"x" * 300_000, "small.bin": some[:999], "é%20.bin": some[7:]}.items()
    yield from {"packed.gz": gzip.compress(some), "not packed.gz": some[9:], "sub/c.zst": some[5:]}.items()


def test_large_files_are_hashed_whole(spark, tmp_path, small_blocks):
    want = set()
    for name, data in contents():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
        want.add((p.name, len(data), hashlib.md5(data).hexdigest()))
    df = store.ingest(spark, str(tmp_path))
    rows = df.collect()
    assert {(r["name"], r["size"], r["content_hash"]) for r in rows} == want and len(rows) == len(want)
    assert {r["path"] for r in rows} == {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path").collect()}
    assert not [r for r in rows if r["modified"] is None]


def test_no_value_of_a_large_file_is_made(spark, tmp_path, small_blocks):
    """With Spark's own limit for a value below the size of the file, which only a large file meets else."""
    data = bytes(random.Random(4).randbytes(300_000))
    (tmp_path / "a.bin").write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "150000")
    try:
        assert [(r["name"], r["content_hash"]) for r in store.ingest(spark, str(tmp_path)).collect()] == [("a.bin", hashlib.md5(data).hexdigest())]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
