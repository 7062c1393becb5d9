"""Options of a comparison, each of which must change what is planned; strategies."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from docdelta.operators import matching, strategies
from docdelta.plans import compare
from docdelta.sources.fixtures import Entities

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def e(spark):
    return Entities(spark, SF)


class Guarded:
    """Entities that note which tables were asked for."""

    def __init__(self, e):
        self.e, self.asked = e, set()

    def __getattr__(self, name):
        self.asked.add(name)
        return getattr(self.e, name)


READS = {"text": "page_lines", "images": "side_px", "fonts": "doc_fonts", "metadata": "doc_info", "styles": "doc_styles"}


@pytest.mark.parametrize("kind", READS)
def test_a_kind_that_is_off_leaves_the_plan(e, kind):
    on = Guarded(e)
    alone = compare.Options(**dict.fromkeys(compare.KINDS, False) | {kind: True})
    compare.differences(on, alone, e.page_pairs)
    assert READS[kind] in on.asked and not on.asked & (set(READS.values()) - {READS[kind]})
    off = Guarded(e)
    others = replace(compare.Options(images=False), **{kind: False})
    compare.differences(off, others, e.page_pairs)
    assert READS[kind] not in off.asked


def kinds(df):
    return {r.type: r.n for r in df.groupBy("type").agg(F.count("*").alias("n")).collect()}


def test_thresholds(e):
    text = compare.Options(images=False, fonts=False, metadata=False, styles=False)
    strict, normal, relaxed = (kinds(compare.differences(e, replace(text, threshold=t)))["text"] for t in ("strict", "normal", "relaxed"))
    assert strict > normal > relaxed > 0


def test_nothing_on_and_forced(e):
    none = compare.Options(**dict.fromkeys(compare.KINDS, False))
    assert compare.differences(e, none).count() == 0
    forced = compare.differences(e, replace(none, force=True))
    assert forced.where("not synthetic").count() == 0 and forced.select("pair_id").distinct().count() == e.page_pairs.where("matched").select("pair_id").distinct().count()
    assert forced.select("diff_id").distinct().count() == forced.count()


def test_smart_matching_follows_moved_pages(spark):
    """A page put in front shifts all others; equal numbers match nothing, content matches all."""
    lines = [(d, p + (d == 2), n, f"page {p} line {n}") for d in (1, 2) for p in range(1, 6) for n in range(1, 4)] + [(2, 1, n, f"new {n}") for n in range(1, 4)]
    page_lines = spark.createDataFrame(lines, "doc_id long, page_no int, line_no int, text string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, base_id long, compare_id long")
    side = lambda d: page_lines.where(f"doc_id = {d}").select(F.lit(1).cast("long").alias("pair_id"), "page_no").distinct()
    by_lines = strategies.Lines(pairs, page_lines)
    found = strategies.match_documents(side(1), side(2), by_lines)
    assert sorted((r.base_page, r.compare_page) for r in found.where("matched").collect()) == [(p, p + 1) for p in range(1, 6)]
    row = found.first()
    assert row.strategy == "content" and row.confidence == pytest.approx(5 / 6)
    plain = strategies.match_documents(side(1), side(2), by_lines, "standard")
    assert plain.where("matched").count() == 0 and plain.first().confidence == 0.0


def test_weighted_and_own_scores(spark, e):
    candidates = e.page_pairs.where("matched").select(matching.KEY).limit(50)
    content, seen = strategies.Lines(e.pairs, e.page_lines), strategies.Pixels(e.side_px("base"), e.side_px("compare"))
    of = lambda s: {tuple(r[:3]): r.score for r in s.score(candidates).collect()}
    v, c, w = of(seen), of(content), of(strategies.Weighted(seen, content, 0.25, 0.75))
    assert w == pytest.approx({k: 0.25 * v[k] + 0.75 * c[k] for k in v}, abs=2e-6) and len(w) == 50

    @F.pandas_udf("double")
    def far(a):
        return 1.0 / (1 + a)

    own = strategies.Own(lambda d: d.withColumn("score", far(F.abs(F.col("base_page") - F.col("compare_page")))), "gap")
    assert set(of(own).values()) == {1.0}
