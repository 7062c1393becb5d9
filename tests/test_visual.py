"""Structural similarity by summed areas, against sums over every window; matching of pairs in one pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docdelta.operators import matching, visual

C1, C2 = visual.C1, visual.C2


def pixels(spark, images):
    """images: {page: (array, array)} of height x width."""
    rows = [(p, x, y, int(a[y, x]), int(b[y, x])) for p, (a, b) in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "page int, x int, y int, l1 int, l2 int")


def brute(a, b, stride=1, size=8):
    h, w = a.shape
    spots = [(0, 0, w, h)] if w < size or h < size else [(x, y, size, size) for y in range(0, h - size + 1, stride) for x in range(0, w - size + 1, stride)]
    out = []
    for x, y, n, m in spots:
        p, q = (i[y : y + m, x : x + n].astype(float) for i in (a, b))
        s = ((2 * p.mean() * q.mean() + C1) * (2 * ((p - p.mean()) * (q - q.mean())).mean() + C2)) / ((p.mean() ** 2 + q.mean() ** 2 + C1) * (p.var() + q.var() + C2))
        out.append(1.0 if (p == q).all() else min(1.0, max(0.0, s)))
    return float(np.mean(out))


def image(rng, h, w):
    a = rng.integers(0, 256, (h, w))
    return a, np.clip(a + rng.integers(-60, 60, (h, w)) * (rng.random((h, w)) < 0.5), 0, 255)


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_ssim_of_many_shapes(spark, stride):
    rng = np.random.default_rng(stride)
    shapes = [(8, 8), (8, 30), (31, 8), (16, 16), (40, 57), (7, 30), (30, 7), (1, 1), (3, 5), (9, 9)]
    images = {i: image(rng, *s) for i, s in enumerate(shapes)}
    images |= {90: (np.full((20, 20), 7), np.full((20, 20), 7)), 91: (np.zeros((20, 20), int), np.full((20, 20), 255))}
    got = {r.page: r.ssim for r in visual.ssim(pixels(spark, images), ["page"], stride).collect()}
    assert got == pytest.approx({p: brute(a, b, stride) for p, (a, b) in images.items()}, abs=2e-6)
    assert got[90] == 1.0 and got[91] < 0.001


def test_ssim_of_halves(spark):
    """Pixels that are not whole numbers, as the halved images of coarse scores are."""
    rng = np.random.default_rng(8)
    px = pixels(spark, {1: image(rng, 24, 20)})
    half = px.groupBy("page", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(F.avg("l1").alias("l1"), F.avg("l2").alias("l2"))
    a, b = np.zeros((12, 10)), np.zeros((12, 10))
    for r in half.collect():
        a[r.y, r.x], b[r.y, r.x] = r.l1, r.l2
    assert visual.ssim(half, ["page"]).first().ssim == pytest.approx(brute(a, b), abs=2e-6)


def test_rows_follow_the_pixels(spark):
    """A scanned page: no plan node makes more than a few rows for each pixel, where one row for each window would make 64."""
    w, h = 425, 550
    px = spark.range(w * h).select(F.lit(1).alias("page"), (F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y")).select("*", ((F.col("x") * 7 + F.col("y") * 3) % 256).alias("l1"), ((F.col("x") * 7 + F.col("y") * 5) % 256).alias("l2"))
    df = visual.ssim(px, ["page"], 2)
    df.collect()
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if (m := node.metrics().get("numOutputRows")).isDefined():
            made.append(m.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= 2 * w * h


def test_stride_reaches_the_page_score(spark):
    rng = np.random.default_rng(3)
    a, b = image(rng, 33, 41)
    for stride in (1, 2):
        row = visual.page_score(pixels(spark, {1: (a, b)}), ["page"], 0.0, 1.0, stride).first()
        assert (row.score_kind, row.score) == ("ssim", pytest.approx(brute(a, b, stride), abs=2e-6))


def test_colours(spark):
    px = spark.createDataFrame([(1, 0, 0, 10, 20, 30, 26, 36, 46), (1, 1, 0, 10, 20, 30, 27, 37, 46)], "page int, x int, y int, r1 int, g1 int, b1 int, r2 int, g2 int, b2 int")
    assert visual.sampled_agreement(px, ["page"]).first().quick == 0.5  # 48 and 50 apart


def greedy(edges):
    base, compare, out = set(), set(), []
    for p, b, c, s in sorted(edges, key=lambda e: (-e[3], abs(e[1] - e[2]), e[1], e[2])):
        if (p, b) not in base and (p, c) not in compare:
            base.add((p, b))
            compare.add((p, c))
            out.append((p, b, c, s))
    return sorted(out)


def test_matching_in_one_pass(spark):
    rng = random.Random(5)
    edges = {(p, rng.randint(1, 60), 0): 0 for p in range(30) for _ in range(60)}
    edges = [(p, b, max(1, b + rng.randint(-4, 4)), rng.randint(0, 20) / 20) for p, b, _ in edges]
    edges = sorted({e[:3]: e for e in edges}.values())
    df = spark.createDataFrame(edges, "pair_id long, base_page int, compare_page int, score double")
    got = sorted(map(tuple, matching.assign(df, 0.3).collect()))
    assert got == greedy([e for e in edges if e[3] >= 0.3])
    plan = matching.assign(df, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_long_pair_is_cut_where_no_edge_crosses():
    chunks = [(b, b + d, 0.9 - d / 10) for b in range(1, 4000, 3) for d in (0, 1)]
    assert matching._chunk_matches(chunks)[:2] == [(1, 1, 0.9), (4, 4, 0.9)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(chunks)), *(pa.array(c) for c in zip(*chunks, strict=True))], ["pair_id", "base_page", "compare_page", "score"])
    parts = list(matching._matches(iter([batch.slice(0, 1001), batch.slice(1001)])))
    assert len(parts) == 1333 and all(p.num_rows == 1 for p in parts)


def test_empty(spark):
    none = spark.createDataFrame([], "pair_id long, base_page int, compare_page int, score double")
    assert matching.assign(none).collect() == []
    assert visual.ssim(spark.createDataFrame([], "page int, x int, y int, l1 int, l2 int"), ["page"]).collect() == []


def test_small_images_rule_out_candidates(spark):
    """The same pages stay over the threshold, and the full score is asked for fewer of them."""
    from docdelta.sources.fixtures import Entities

    e = Entities(spark, "/root/testdata/sf0.001")
    pages = [px.select("pair_id", "page_no").distinct() for px in (e.base_px, e.compare_px)]
    every = matching.full(*pages)
    full = {tuple(r[:3]): r.score for r in visual.page_scorer(e.base_px, e.compare_px)(every).collect()}
    for levels in (1, 2):
        got = {tuple(r[:3]): r.score for r in visual.coarse_scorer(e.base_px, e.compare_px, levels=levels)(every).collect()}
        over = lambda d: {k: v for k, v in d.items() if v >= 0.7}
        assert set(got) == set(full) and over(got) == over(full)
        assert sum(got[k] == full[k] for k in full) < len(full) / 2
