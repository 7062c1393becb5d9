"""Streams over several batches, restarts and late rows, against their batch twins."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from docdelta.operators import matching, text
from docdelta.sources.fixtures import Entities
from docdelta.streaming import arrivals, streams

SF = "/root/testdata/sf0.001"
FOUND = ["pair_id", "diff_id", "change", "severity"]


def twin(e, docs):
    """T7 over the pairs that the documents find in order of their ids."""
    from docdelta.sources import fixtures as f

    lines = f.lines_on_pages(f.paragraphs(docs))
    pairs = f.best_before(f.neighbours(f.sharing_keys(docs)))
    pages = lines.groupBy("doc_id").agg(F.max("page_no").alias("page_count"))
    found = text.text_differences(text.pair_lines(matching.standard_page_pairs(pairs, pages, lines), pairs, lines))
    return sorted(map(tuple, found.select(FOUND).collect()))


@pytest.mark.parametrize("fold", [16, 2])
def test_arriving_documents_equal_the_batch(spark, tmp_path, monkeypatch, fold):
    """Four parts, the stream started anew for each, and one batch repeated as after a crash."""
    monkeypatch.setattr(arrivals, "FOLD", fold)
    e = Entities(spark, SF)
    docs = e.table("documents").select("doc_id", "text").where("doc_id < 120")
    corpus = arrivals.Corpus(spark, str(tmp_path / "corpus"))
    for k in range(4):
        part = docs.where(F.floor(F.col("doc_id") / 30) == k)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        corpus.follow(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    corpus.arrive(part, 3)
    got = sorted(map(tuple, corpus.results.read().select(FOUND).collect()))
    assert got and got == twin(e, docs)


def test_a_batch_reads_what_its_keys_ask_for(spark, tmp_path):
    line = "a paragraph of more than twenty characters {}"
    rows = [(1, line.format(1) + "\nx"), (2, line.format(2)), (3, line.format(1) + "\ny"), (4, line.format(1) + "\nx"), (5, None), (6, "")]
    corpus = arrivals.Corpus(spark, str(tmp_path))
    for i, (a, b) in enumerate([(0, 2), (2, 3), (3, 6)]):
        corpus.arrive(spark.createDataFrame(rows[a:b], "doc_id long, text string"), i)
    last = spark.createDataFrame([(7, line.format(2) + "\nz")], "doc_id long, text string")
    from docdelta.sources.fixtures import sharing_keys

    assert sorted(map(tuple, corpus.partners(sharing_keys(last), 3).collect())) == [(7, 2, 7)]
    got = {r.pair_id for r in corpus.results.read().collect()}
    assert got == {3}  # 3 differs from 1; 4 is a copy of 1, and found it before 3


EVENTS = "job_id long, status string, has_result boolean, ts timestamp"


def test_state_lives_over_batches_and_ends(spark, tmp_path):
    """Four batches, the stream started anew for each: a timer set in one fires in another, a late row changes nothing, old state goes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [
        [(1, "PROCESSING", False, "10:00"), (2, "PROCESSING", False, "10:00"), (3, "PENDING", False, "10:05"), (4, "COMPLETED", True, "10:00")],
        [(1, "COMPLETED", True, "10:10"), (3, "PROCESSING", False, "10:18")],
        [(9, "COMPLETED", True, "10:30")],
        [(2, "COMPLETED", True, "10:01"), (5, "COMPLETED", True, "13:00")],
    ]
    failed, states = [], []
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "job_id long, status string, has_result boolean, t string").select("job_id", "status", "has_result", F.concat(F.lit("2024-01-01 "), "t", F.lit(":00")).cast("timestamp").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        writer = streams.stuck(source, keep=timedelta(hours=2)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        failed.append({r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()})
    assert failed == [set(), {2}, {2}, {2, 3}]  # 2 at 10:15, before its late row; 3, which was heard of again, at 10:33
    assert states[-1] < states[0]  # at 13:00 jobs 1, 4 and 9 are forgotten too


def test_purge_on_a_stream_runs_hourly(spark, tmp_path):
    from docdelta.sources.store import ResultStore

    rows = spark.createDataFrame([(1, "COMPLETED", "2024-01-01"), (2, "FAILED", "2024-01-30 23:00:00"), (3, "PROCESSING", "2024-01-01")], "job_id long, status string, t string")
    jobs = rows.select("job_id", "status", F.col("t").cast("timestamp").alias("updated_at"))
    jobs.write.parquet(str(tmp_path / "in"))
    kept = ResultStore(spark, str(tmp_path / "results"), "job_id")
    kept.write(jobs.select("job_id", "status"))
    q = streams.retention(spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in")), kept, F.expr("timestamp '2024-01-31 00:00:00'"), str(tmp_path / "c"))
    try:
        until = time.time() + 90
        while not q.recentProgress and time.time() < until:  # the first batch; the next is an hour off
            time.sleep(0.5)
        assert q.isActive and q.lastProgress["numInputRows"] == 3
    finally:
        q.stop()
    assert {r.job_id for r in kept.read().collect()} == {2, 3}


def test_jobs_of_a_bucket_share_one_state(spark, tmp_path):
    """All jobs in two buckets, over two batches: as many rows of state as buckets, and the same jobs fail as by their own times."""
    rows = [[(i, "PROCESSING" if i % 2 else "COMPLETED", i % 3 == 0, 60 * (i % 30)) for i in range(200)], [(1, "PENDING", True, 1000), (5, None, None, 1000), (999, "COMPLETED", False, 2400)]]
    for part in rows:
        spark.createDataFrame(part, "job_id long, status string, has_result boolean, s long").select("job_id", "status", "has_result", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streams.stuck(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), buckets=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    first = {i for i, status, done, s in rows[0] if status == "PROCESSING" and not done and s + 900 < 29 * 60}
    late = {i for i, status, done, s in rows[0] if status == "PROCESSING" and not done and s + 900 < 2400}
    got = sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(first | late)
