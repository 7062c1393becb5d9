"""Edges worked out by hand, invariants, and streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from docdelta.operators import catalog, differences, jobs, keyed, layout, matching, summaries, text, visual
from docdelta.sources import store
from docdelta.sources.fixtures import Entities
from docdelta.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def e(spark):
    return Entities(spark, SF)


LINES = "pair_id long, base_page int, compare_page int, line_no int, base_text string, compare_text string"


def lines(spark, *pairs):
    return spark.createDataFrame([(1, 1, 1, i + 1, b, c) for i, (b, c) in enumerate(pairs)], LINES)


def test_text_edges(spark):
    d = lines(spark, ("", ""), ("x" * 50, None), (None, "x" * 51), ("abcde", "abcdX"), ("aaaaaaaaaa", "bbaaaaaaaa"), ("aaaa", "bbaa"), ("aaaa", "bbba"), (None, None))
    got = {r.line_no: (r.change, r.severity) for r in text.text_differences(d.where("base_text is not null or compare_text is not null")).collect()}
    # Two empty lines and a similarity of just 0.8 are no difference; just half of the base is minor.
    assert got == {2: ("deleted", "minor"), 3: ("added", "major"), 6: ("modified", "minor"), 7: ("modified", "major")}


def test_shares_of_just_a_fifth_and_a_half(spark):
    d = spark.createDataFrame([(2, 10), (3, 10), (5, 10), (6, 10)], "distance int, n int").select("distance", text.severity(F.col("distance"), F.col("n")).alias("s"))
    assert {r.distance: r.s for r in d.collect()} == {2: "cosmetic", 3: "minor", 5: "minor", 6: "major"}


def test_boxes(spark):
    d = spark.createDataFrame([("modified", None, None, None, None, 5.0, 6.0, 7.0, 8.0), ("modified", None, None, None, None, None, None, None, None), ("added", 1.0, 1.0, 1.0, 1.0, 5.0, 6.0, 0.0, 8.0)], "change string, base_x double, base_y double, base_width double, base_height double, compare_x double, compare_y double, compare_width double, compare_height double")
    got = [(r.x, r.y, r.width, r.height) for r in text.box_or_default(d).collect()]
    assert got == [(5, 6, 7, 8), (100, 100, 100, 14), (5, 6, 100, 8)]


def test_assignment_is_greedy_and_uses_each_page_once(spark):
    edges = [(1, 1, 1, 0.9), (1, 1, 2, 0.95), (1, 2, 2, 0.95), (1, 2, 1, 0.8), (1, 3, 3, 0.7), (1, 4, 4, 0.69)]
    got = matching.assign(spark.createDataFrame(edges, "pair_id long, base_page int, compare_page int, score double")).collect()
    # Of equal scores the nearer page goes first; 0.7 matches, 0.69 doesn't.
    assert {(r.base_page, r.compare_page) for r in got} == {(2, 2), (1, 1), (3, 3)}


def test_image_edges(spark):
    d = spark.createDataFrame([(0.69,), (0.7,), (0.89,), (0.9,)], "score double").select("score", visual.image_severity(F.lit("modified"), F.col("score")).alias("s"))
    assert {r.score: r.s for r in d.collect()} == {0.69: "major", 0.7: "minor", 0.89: "minor", 0.9: "cosmetic"}
    px = spark.createDataFrame([(k, x, y, (x * 9 + y) % 256, (x * 9 + y) % 256 if k == 0 else 0) for k in (0,) for x in range(9) for y in range(9)] + [(1, x, y, 0, 255) for x in range(9) for y in range(9)], "k int, x int, y int, l1 int, l2 int")
    got = {r.k: r.ssim for r in visual.ssim(px, ["k"]).collect()}
    assert got[0] == 1.0 and got[1] < 0.01


def test_stuck_after_more_than_fifteen_minutes(spark):
    rows = [(1, "PROCESSING", False, "2024-01-30 23:45:00"), (2, "PROCESSING", False, "2024-01-30 23:44:59"), (3, "PENDING", True, "2024-01-30 20:00:00"), (4, "COMPLETED", False, "2024-01-01 00:00:00")]
    d = spark.createDataFrame(rows, "job_id long, status string, has_result boolean, t string").withColumn("updated_at", F.col("t").cast("timestamp"))
    got = {r.job_id: r.status for r in jobs.repair(d, F.expr("timestamp '2024-01-31 00:00:00'")).collect()}
    assert got == {1: "PROCESSING", 2: "FAILED", 3: "COMPLETED", 4: "COMPLETED"}


def test_lines_anchor_at_their_first_element(spark):
    d = spark.createDataFrame([(1, 1, i, "w", float(i), y, 5.0, 10.0) for i, y in enumerate([100.0, 94.0, 91.0, 85.0])], "doc_id long, page_no int, elem_no int, text string, x double, y double, width double, height double")
    got = {r.elem_no: r.line_no for r in layout.group_lines(d).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2}  # 91 is 9 from the anchor at 100, though 3 from its neighbour


def test_keyed_diff_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "k long, v string")
    assert {r.k: r.change for r in keyed.keyed_diff(a, b, ["k"], ["v"]).collect()} == {2: "modified", 3: "deleted", 4: "added"}


def test_labels(spark):
    d = spark.createDataFrame([(1023,), (1024,), (1536 * 1024,)], "n long")
    assert [r[0] for r in d.select(catalog.readable_size(F.col("n"))).collect()] == ["1023 B", "1.00 KB", "1.50 MB"]
    assert [r[0] for r in spark.createDataFrame([(0.95,), (0.5,), (0.01,), (0.0,)], "s double").select(summaries.match_label(F.col("s"))).collect()] == ["Excellent Match", "Possible Match", "Poor Match", "No Match"]
    assert spark.range(1).select(differences.cut(F.lit("a" * 16), 15)).first()[0] == "a" * 15 + "..."


def test_invariants(e):
    d, pages = e.differences, e.page_pairs
    total = d.count()
    by = {r.dimension: r.n for r in summaries.count_by_dimension(d).groupBy("dimension").agg(F.sum("n").alias("n")).collect()}
    assert by == {k: total for k in ("type", "severity", "change", "base_page")}
    assert pages.where("base_page is not null").groupBy("pair_id", "base_page").count().where("count > 1").count() == 0
    changes = lambda p: {r.change: r["count"] for r in text.text_differences(text.pair_lines(pages if p is e.pairs else pages.select("pair_id", F.col("compare_page").alias("base_page"), F.col("base_page").alias("compare_page"), "matched", "score"), p, e.page_lines)).groupBy("change").count().collect()}
    here = changes(e.pairs)
    there = changes(e.pairs.select("pair_id", F.col("compare_id").alias("base_id"), F.col("base_id").alias("compare_id")))
    assert (here["added"], here["deleted"]) == (there["deleted"], there["added"])


def test_results_replace_only_their_own(spark, tmp_path):
    path = str(tmp_path / "results")
    store.write_results(spark.createDataFrame([(i, "old") for i in range(200)], "pair_id long, v string"), path)
    store.write_results(spark.createDataFrame([(7, "new")], "pair_id long, v string"), path)
    got = {r.pair_id: r.v for r in store.read_results(spark, path).collect()}
    assert got == {**{i: "old" for i in range(200)}, 7: "new"}
    assert store.read_results(spark, path, spark.createDataFrame([(7,), (900,)], "pair_id long")).collect()[0].v == "new"


def _drained(spark, df, run, tmp_path, mode="append"):
    # Two files, one a batch: state passes from batch to batch.
    for i, part in enumerate(df.randomSplit([0.5, 0.5], 5)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.drain(run(source), str(tmp_path / "out"), str(tmp_path / "c"), mode)
    return spark.read.parquet(str(tmp_path / "out"))


def test_progress_stream_keeps_the_last_state(spark, e, tmp_path):
    events = e.jobs.select((F.col("job_id") % 50).alias("job_id"), "status", F.col("created_at").alias("ts"))
    got = streams.newest(_drained(spark, events, streams.latest_state, tmp_path, "update"), ["job_id"])
    assert sorted(map(tuple, got.select("job_id", "status", "ts").collect())) == sorted(map(tuple, streams.latest_state(events).collect()))


def test_stuck_stream_equals_repair(spark, e, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = e.jobs.select("job_id", "status", "has_result", F.col("updated_at").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    streams.drain(streams.stuck(source), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = e.jobs.agg(F.max("updated_at").alias("t")).first().t
    wanted = {r.job_id for r in jobs.repair(e.jobs, F.lit(last)).where("message is not null").collect()}
    assert got and got == wanted


def test_closed_windows_and_sessions_equal_their_batches(spark, e, tmp_path):
    sliding = lambda d: streams.tumbling(d, size="2 days", slide="1 day")
    events = e.jobs.select((F.col("job_id") % 50).alias("job_id"), F.col("created_at").alias("ts"))
    for name, df, run, end in (("t", e.metrics, streams.tumbling, 86400), ("w", e.metrics, sliding, 86400), ("s", events, streams.sessions, 3600)):
        df.coalesce(1).write.parquet(str(tmp_path / name / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / name / "in"))
        streams.drain(run(source), str(tmp_path / name / "out"), str(tmp_path / name / "c"))
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / name / "out")).collect()))
        mark = df.agg(F.max("ts").alias("t")).first().t.timestamp() - end
        batch = run(df)
        wanted = sorted(tuple(r) for r in batch.collect() if r["end"].timestamp() <= mark)
        assert got and got == wanted


def test_documents_without_content_stay(spark):
    d = catalog.with_hash(spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "doc_id long, text string"))
    assert {tuple(r) for r in catalog.canonical(d).collect()} == {(1, 1, False), (3, 1, True), (2, 2, False), (4, 2, True)}
