"""The store of results in versions, and reports written line by line."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docdelta.sources import reports, store


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def rows(spark, pairs, tag, each=20):
    return spark.range(pairs.start * each, pairs.stop * each).select(F.floor(F.col("id") / each).alias("pair_id"), F.concat(F.lit(tag), F.col("id").cast("string")).alias("diff_id"))


def tags(df):
    return {r.pair_id: (r.tag, r.n) for r in df.groupBy("pair_id").agg(F.min(F.substring("diff_id", 1, 1)).alias("tag"), F.count("*").alias("n")).collect()}


@pytest.fixture()
def kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 500)
    s = store.ResultStore(spark, str(tmp_path / "results"))
    s.write(rows(spark, range(0, 400), "a"))
    return s


def test_replacing_one_comparison_writes_its_rows_alone(spark, kept):
    before = size(kept.path)
    kept.write(rows(spark, range(7, 8), "b", 5))
    assert size(kept.path) - before < before / 20
    got = tags(kept.read())
    assert got[7] == ("b", 5) and got[6] == ("a", 20) and len(got) == 400
    assert tags(kept.read(spark.createDataFrame([(7,), (9,), (999,)], "pair_id long"))) == {7: ("b", 5), 9: ("a", 20)}


def test_buckets_follow_the_rows(spark, kept):
    version = kept.versions()[0]
    assert kept._names(f"data/version={version}") == ["16"]  # 8,000 rows, 500 a bucket
    small = kept.write(rows(spark, range(3, 4), "b"))
    assert kept._names(f"data/version={small}") == ["1"]


def test_nothing_is_seen_before_its_commit(spark, kept):
    version = kept.write(rows(spark, range(0, 2), "b"))
    (Path(kept.path) / f"keys/version={version}/_SUCCESS").unlink()
    assert tags(kept.read())[0] == ("a", 20)


def test_a_repeated_batch_replaces_itself(spark, kept):
    for _ in range(2):
        kept.write(rows(spark, range(0, 3), "b", 4), "99999999999999999999-batch")
    assert tags(kept.read())[1] == ("b", 4) and len(kept.versions()) == 2


def test_compaction_keeps_the_newest(spark, kept):
    for tag in "bc":
        kept.write(rows(spark, range(0, 200), tag))
    want, before = tags(kept.read()), size(kept.path)
    kept.compact()
    assert tags(kept.read()) == want and len(kept.versions()) == 1 and size(kept.path) < before


def test_purge_rewrites_the_files_that_hold_the_expired(spark, kept):
    files = {p: p.stat().st_mtime_ns for p in Path(kept.path, "data").rglob("*.parquet")}
    touched = kept.purge(spark.createDataFrame([(5,), (5,), (77777,)], "pair_id long")).collect()
    assert len(touched) == 1 and touched[0].kept % 20 == 0
    now = {p: p.stat().st_mtime_ns for p in Path(kept.path, "data").rglob("*.parquet")}
    assert len(set(files.items()) - set(now.items())) == 1  # one file of sixteen
    got = tags(kept.read())
    assert 5 not in got and len(got) == 399
    assert kept.spark.read.parquet(f"{kept.path}/data").where("pair_id = 5").count() == 0


def test_purge_of_a_whole_file(spark, kept):
    kept.write(rows(spark, range(1000, 1001), "b"))
    kept.purge(spark.createDataFrame([(1000,)], "pair_id long"))
    assert 1000 not in tags(kept.read()) and len(tags(kept.read())) == 400
    kept.write(rows(spark, range(1000, 1001), "c"))
    assert tags(kept.read())[1000] == ("c", 20)


def test_no_results_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.read_results(spark, str(tmp_path / "none"))


# ---- reports


def differences(spark, n):
    one = spark.range(n).select(F.lit(1).alias("pair_id"), F.col("id").cast("string").alias("diff_id"), F.lit("text").alias("type"), F.lit("added").alias("change"), F.lit("minor").alias("severity"), (F.floor(F.col("id") / 20) + 1).cast("int").alias("base_page"), (F.floor(F.col("id") / 20) + 1).cast("int").alias("compare_page"), (F.col("id") % 20).cast("int").alias("line_no"), F.lit(None).cast("string").alias("name"), F.lit("a<b & \"c\"").alias("base_text"), F.lit(None).cast("string").alias("compare_text"), F.lit(None).cast("string").alias("base_value"), F.lit(None).cast("string").alias("compare_value"))
    meta = spark.createDataFrame([(1, "m", "metadata", "modified", "minor", None, None, None, "Title", None, None, "x>y", "z")], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema))
    return one.unionByName(meta)


def text_of(path, pair):
    return [line for p in sorted(Path(path, f"pair_id={pair}").glob("part-*")) for line in p.read_text().splitlines()]


def test_long_report_is_written_in_parts(spark, tmp_path):
    n = 200_000
    summary = spark.createDataFrame([(1, n + 1), (2, 0)], "pair_id long, total long")
    d = differences(spark, n)
    reports.write_reports(reports.json_lines(summary, d, ["diff_id", "type", "base_page", "line_no"]), str(tmp_path / "json"), 8, 20_000)
    parts = list(Path(tmp_path, "json", "pair_id=1").glob("part-*"))
    assert len(parts) >= 10 and max(p.stat().st_size for p in parts) < 3_000_000
    whole = json.loads("\n".join(text_of(tmp_path / "json", 1)))
    assert whole["total"] == n + 1 and [x["diff_id"] for x in whole["differences"]][:3] == ["m", "0", "1"] and len(whole["differences"]) == n + 1
    assert json.loads("".join(text_of(tmp_path / "json", 2))) == {"pair_id": 2, "total": 0, "differences": []}


def test_sections_of_a_page(spark, tmp_path):
    summary = spark.createDataFrame([(1, 41)], "pair_id long, total long")
    pages = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, None), (1, None, 4)], "pair_id long, base_page int, compare_page int")
    reports.write_reports(reports.html_lines(summary, pages, differences(spark, 40)), str(tmp_path / "html"), 3)
    lines = text_of(tmp_path / "html", 1)
    assert lines[0].startswith("<!DOCTYPE html>") and "total: 41" in lines[0] and lines[-1] == "</body></html>"
    assert lines[1] == "<p>Key: Title Base Value: x&gt;y Comparison Value: z</p>"
    assert [i for i, x in enumerate(lines) if x.startswith("<h3>")] == [2, 23, 44, 45]
    assert lines[44] == "<h3>Page 3</h3>Page exists only in base document" and "only in comparison" in lines[45]
    assert lines[3] == "<tr><td>text</td><td>added</td><td>minor</td><td></td><td>a&lt;b &amp; &quot;c&quot;</td><td></td></tr>"
